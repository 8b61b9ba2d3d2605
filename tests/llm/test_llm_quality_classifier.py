"""Operator 12 against plain statistics, a fit in one piece, and held-out labels."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewindow.llm import quality_classifier as qc
from tidewindow.llm import registry
from tidewindow.llm.shared import Scratch

BLANK = " \t\n\x0b\f\r"


def plain(text):
    """The statistics of a text in plain Python."""
    text = text or ""
    raw = text.encode()
    if not raw:
        return [0.0] * len(qc.STATISTICS)
    words = "".join(" " if c in BLANK else c for c in text).split(" ")
    words = [w for w in words if w]
    sizes = [len(w.encode()) for w in words]
    lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    n, body = max(len(words), 1), max(sum(sizes), 1)
    counts = collections.Counter(raw)
    triples = collections.Counter(zip(lower, lower[1:], lower[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    letters = [sum(c.isalpha() if c.isascii() else 1 for c in w) for w in words]
    mean = sum(sizes) / n
    return [
        math.log1p(len(words)), math.log1p(len(text)), math.log1p(len(lines)), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / n), math.log1p(max(sizes, default=0)),
        sum(s <= 3 for s in sizes) / n, sum(x == 0 for x in letters) / n, sum("A" <= w[0] <= "Z" for w in words) / n,
        sum("A" <= c <= "Z" for c in text) / body, sum("0" <= c <= "9" for c in text) / body, sum(33 <= ord(c) < 127 and not c.isalnum() for c in text) / body,
        sum(c in "#*$%&|<>" for c in text) / body, text.count("!") / n, text.count(".") / n, 1 - sum(sizes) / len(raw), sum(c >= 128 for c in raw) / body,
        -sum(c / len(raw) * math.log2(c / len(raw)) for c in counts.values()), len(set(lower)) / n**0.75, max(collections.Counter(lower).values(), default=0) / n,
        sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / n, sum(c for c in triples.values() if c > 1) / n,
        math.log1p(len(words) / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1),
    ]


@pytest.mark.parametrize("text", [None, "", " \n\t ", "a", "###", "Ein Wort.\n\nEin Wort.\n", "né à à à Été 日本 ！ 12 A|B!", "x " * 5000, "\x00\x1f one"])
def test_statistics_of_odd_texts(text):
    assert qc.statistics(text) == pytest.approx(plain(text), abs=1e-9)


def test_statistics_of_the_documents(spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        assert qc.statistics(r["text"]) == pytest.approx(plain(r["text"]), abs=1e-9)


def test_held_out_labels(spark, data):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    ids = [r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    out = registry.queries()["op12_quality_classifier"](spark, data).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(ids)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(labels[r["doc_id"]] == r["predicted"] for r in held) >= 0.97 * len(held)


def test_fit_equals_one_over_all_rows_at_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = qc.label_means(spark.read.parquet(f"{data}/labels.parquet"), F.col("quality"))
    stats = Scratch(spark, "test").save("stats", qc.document_statistics(docs))
    model = qc.fit_classifier(stats, labels, Scratch(spark, "test"))
    y = {r["id"]: r["label"] for r in labels.collect()}
    rows = [r for r in stats.collect() if r["id"] in y]
    every = np.array([r["stats"] for r in stats.collect()])
    assert model.kernel.mean == pytest.approx(every.mean(axis=0)) and model.kernel.deviation == pytest.approx(every.std(axis=0))
    x, target, fold = model.kernel.of(np.array([r["stats"] for r in rows])), np.array([y[r["id"]] for r in rows]), np.array([r["fold"] for r in rows])

    def solved(keep, ridge):
        penalty = np.append(np.full(qc.FEATURES, ridge), 1e-9) * keep.sum()
        return np.linalg.solve(x[keep].T @ x[keep] + np.diag(penalty), x[keep].T @ target[keep])

    losses = {r: sum(((x[fold == f] @ solved(fold != f, r) - target[fold == f]) ** 2).sum() for f in range(qc.FOLDS)) for r in qc.RIDGES}
    assert model.ridge == min(losses, key=losses.get)
    assert x @ model.weights == pytest.approx(x @ solved(np.full(len(x), True), model.ridge), abs=1e-5)
    scores = np.array([x[i] @ solved(fold != fold[i], model.ridge) for i in range(len(x))])
    xs, ys = model.curve
    assert (np.diff(xs) > 0).all() and (np.diff(ys) > 0).all() and scores.min() - 1e-5 <= xs.min() and xs.max() <= scores.max() + 1e-5


def test_isotonic_is_the_nearest_rising_curve():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 7)
        w, v = [rng.randint(1, 4) for _ in range(n)], [rng.randint(0, 4) / 4 for _ in range(n)]
        x, y = qc.isotonic(np.arange(n, dtype=float), np.array(w), np.array(v))
        # the min-max formula of isotonic regression
        mean = lambda i, j: sum(a * b for a, b in zip(w[i : j + 1], v[i : j + 1], strict=True)) / sum(w[i : j + 1])
        best = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        at = np.searchsorted(np.cumsum([sum(1 for b in best if abs(b - u) < 1e-9) for u in y]), np.arange(n), side="right")
        assert [y[a] for a in at] == pytest.approx(best)


def test_nulls_copies_and_clashing_columns(spark):
    good, bad = "the quick brown fox jumps over it. " * 9, "### $$$ %%% ### " * 20
    rows = [(i, good + str(i) if i % 2 else bad + "#" * i, 7) for i in range(60)] + [(100, None, 1), (100, "", 1), (101, good, 1), (101, good, 1), (None, good, 1), (102, bad, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long").selectExpr("*", "1 AS id", "2 AS stats", "3 AS fold", "4 AS predicted", "5 AS label")
    marked = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1), (0, 0), (1, None), (3, 5), (None, 1), (500, 1)], "doc_id long, quality int")
    out = qc.classify(docs, qc.label_means(marked, marked["quality"])).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    of = collections.defaultdict(list)
    for r in out:
        of[r["id"]].append(r["score"])
    assert of[100][0] == of[100][1] and of[101][0] == of[101][1] == of[None][0] > 0.5 > of[102][0]
    assert all((s[0] > 0.5) == (k % 2 == 1) for k, s in of.items() if k is not None and k < 60)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in qc.classify(docs, qc.label_means(none, none["quality"])).collect()] == [0.5, 0.5]
    assert qc.classify(docs.limit(0), qc.label_means(none, none["quality"])).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r["predicted"] for r in qc.classify(docs, qc.label_means(one, one["quality"])).collect()] == [1, 1]
