"""Operator 13 against a tree in plain Python."""

import hashlib
import zlib

import pytest

from tidewindow.llm import merkle, registry
from tidewindow.llm.queries import op13_merkle_manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes):
    return [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def way(nodes, at):
    """The nodes beside the way from a place to the top, and the top."""
    out = []
    while len(nodes) > 1:
        beside = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
        out.append((at % 2, beside))
        nodes, at = up(nodes), at // 2
    return out, nodes[0]


def plain(rows):
    """Sorted results of op13 for (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    tops = [way([x[2] for x in trees[t]], 0)[1] for t in order]
    root = way(tops, 0)[1]
    out = []
    for k, t in enumerate(order):
        high = way(tops, k)[0]
        for i, (_, _, digest, r) in enumerate(trees[t]):
            path = way([x[2] for x in trees[t]], i)[0] + high
            now = digest
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf(*r[:3], r[3] + 1, r[4])
            for left, beside in path:
                now = sha(beside, now) if left else sha(now, beside)
            out.append((r[0], digest, tops[k], root, sha(*(x for _, x in path)), now, now == root))
    return sorted(map(repr, out))


COLUMNS = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"


def found(df):
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.fixture
def folder(spark, tmp_path):
    def put(rows):
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        df.selectExpr("*", "1 AS id", "2 AS leaf", "3 AS tree", "'x' AS path").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return put


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert found(registry.queries()["op13_merkle_manifest"](spark, data)) == plain([tuple(r) for r in docs])


@pytest.mark.parametrize(("step", "sizes"), [(1, (3, 9, 1)), (2, (8, 16, 17, 5, 4)), (2, (1,)), (3, (1, 1)), (8, (33,))])
def test_trees_of_all_shapes(spark, folder, monkeypatch, step, sizes):
    """Trees of one to many records, more trees than a record has children."""
    monkeypatch.setattr(merkle, "STEP", step)
    rows = [(100 * t + i, "s", f"l{t}" if t else None, i, f"text {i}") for t, n in enumerate(sizes) for i in range(n)]
    assert found(op13_merkle_manifest(spark, folder(rows))) == plain(rows)


def test_nulls_copies_and_long_texts(spark, folder, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    rows = [
        (None, None, None, None, None), (None, "", "", 0, ""), (1, "s", "-", 1, "-"), (7, "é", "日", 2**63 - 1, "né 日本 " * 50_000), (7, "é", "日", None, None), (3, "a:b", "en", 5, "\x00"),
        *[(8, "s", "en", 4, "same")] * 40, (-9, "s", "en", 3, "below nought"), (9, None, "EN", 1, "case"), (9, None, "é", 1, "bytes"), (9, None, "z", 1, "bytes"),
    ]
    assert found(op13_merkle_manifest(spark, folder(rows))) == plain(rows)


def test_no_rows(spark, folder):
    assert op13_merkle_manifest(spark, folder([])).collect() == []


def test_ranks_are_the_same_joined_by_a_shuffle(spark, folder, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = [(i, "s", f"l{i % 3}", i, "t") for i in range(50)]
    assert found(op13_merkle_manifest(spark, folder(rows))) == plain(rows)


def test_tampering_is_told_and_nothing_else(spark, data):
    for r in op13_merkle_manifest(spark, data).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
