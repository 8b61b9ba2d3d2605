"""Operator 11 against exact fractions and NumPy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidewindow.llm import registry, whitening
from tidewindow.llm.shared import Scratch


def whole(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def plain(vectors):
    """n, S and the exact covariance over distinct whole vectors."""
    fit = sorted({whole(v) for v in vectors})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(dims)]
    d = [[n * x[i] - sums[i] for i in range(dims)] for x in fit]
    cov = [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in range(dims)] for i in range(dims)]
    return n, sums, cov


def wide(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}")


def test_whole_table_against_fractions(spark, data):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    n, sums, cov = plain(vectors.values())
    values, vecs = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vecs = values[::-1][:16], vecs[:, ::-1][:, :16]
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    out = {}
    for r in registry.queries()["op11_embedding_whitening"](spark, data).collect():
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(out) == set(vectors) and all(set(rows) == set(range(1, 17)) for rows in out.values())
    expected = {k: (np.array(whole(v)) - np.array(sums) / n) @ vecs / np.sqrt(values) for k, v in vectors.items()}
    sign = np.sign([sum(expected[k][c] * out[k][c + 1]["whitened"] for k in out) for c in range(16)])
    for k, rows in out.items():
        deviation = sum((n * x - s) ** 2 for x, s in zip(whole(vectors[k]), sums, strict=True))
        for c in range(16):
            r = rows[c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["whitened"] == pytest.approx(sign[c] * expected[k][c], abs=1e-8)
            assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
    assert max(r["identity_error"] for rows in out.values() for r in rows.values()) < 1e-9


def test_odd_rows_are_left_out_and_copies_count_once(spark):
    good = [[1.0, 2.0], [3.0, 1.0], [0.0, 5.5], [1.0, 2.0]]
    odd = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("-inf")], [1.0, 2.0, 3.0]]
    rows = [(i, v) for i, v in enumerate(good + odd)] + [(0, good[0]), (None, good[1])]
    table = wide(spark, rows).selectExpr("*", "1 AS x", "2 AS id", "3 AS component", "'a' AS n")
    out = whitening.whiten(table).collect()
    assert sorted((-1 if r["id"] is None else r["id"], r["component"]) for r in out) == sorted((i, c) for i in (0, 0, -1, 1, 2, 3) for c in (1, 2))
    assert {r["n"] for r in out} == {3} and out[0]["identity_error"] < 1e-9
    assert len({(r["component"], r["whitened"]) for r in out if r["id"] in (0, 3)}) == 2


@pytest.mark.parametrize("scale", [1e9, 5e15])
def test_sums_of_any_size_are_exact(spark, scale):
    """Values that need three parts each, and values beyond 64 bits."""
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((40, 4)) * scale).tolist()
    x = whitening.whole_vectors(wide(spark, list(enumerate(vectors))))
    capped = [tuple(int(max(min(c, 2.0**61), -(2.0**61))) for c in v) for v in (np.floor(np.array(vectors) * 64))]
    fit = sorted({tuple(c + 1_000_000 for c in v) for v in capped})
    assert sorted(tuple(r["x"]) for r in x.collect()) == fit
    middle = whitening.centre(x.select("x"))
    squares = whitening.square_sums(x.select("x"), middle)
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = [[n * v - s for v, s in zip(r, sums, strict=True)] for r in fit]
    assert (middle.n, list(middle.sums)) == (n, sums)
    for (i, j), s in squares.items():
        assert s == sum((r[i] if i == j else r[i] + r[j]) ** 2 for r in d)
    assert whitening.covariance(squares, n, 4)[0][1] == Fraction(sum(r[0] * r[1] for r in d), n**3)


def test_graded_variances_keep_their_digits(spark):
    """One dimension is ten million times as wide as others."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 5)) * np.array([3e8, 4, 3, 2, 1]) @ np.linalg.qr(rng.standard_normal((5, 5)))[0]
    out = whitening.whiten(wide(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])).toPandas()
    w = out.pivot(index="id", columns="component", values="whitened").to_numpy()
    assert out["identity_error"].iloc[0] < 1e-4
    assert np.abs(w.T @ w / len(w) - np.eye(5)).max() < 1e-4


def test_no_variance_one_row_no_row(spark):
    out = whitening.whiten(wide(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in out] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(wide(spark, [(i, [float(i), 7.0]) for i in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert whitening.whiten(wide(spark, [])).count() == 0
    assert whitening.whiten(wide(spark, [(1, None)])).count() == 0


def test_fit_does_not_depend_on_partitions(spark, data):
    x = whitening.whole_vectors(spark.read.parquet(f"{data}/embeddings.parquet"))
    scratch = Scratch(spark, "test")
    a, b = (whitening.fit_whitening(x.repartition(k), 16, scratch) for k in (1, 7))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.values, b.values) and a.middle == b.middle
