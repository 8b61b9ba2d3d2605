"""Ranks, running counts, medians and neighbour information over groups of any size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewindow.operators import information, learning, scans


def test_ranks_in_order_with_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(None if i % 50 == 0 else rng.choice("aaaaab"), rng.choice([0.5, 1.0, 1.0, 2.0]), i) for i in range(3000)]
    out = scans.ranked(spark.createDataFrame(rows, "g string, v double, id long").repartition(7), ["g"], ["v"]).collect()
    for g in (None, "a", "b"):
        own = sorted((r["rank"], r["v"]) for r in out if r["g"] == g)
        assert [r for r, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    assert sorted(r["id"] for r in out) == list(range(3000))


def test_blocks_share_their_edges(spark):
    rows = spark.range(23).withColumn("rank", F.col("id"))
    out = scans.in_blocks(rows, "rank", 2, 1, 5).collect()
    own = {b: sorted(r["rank"] for r in out if r["block"] == b and not r["copied"]) for b in range(5)}
    edge = {b: sorted(r["rank"] for r in out if r["block"] == b and r["copied"]) for b in range(5)}
    assert own == {b: list(range(5 * b, min(5 * b + 5, 23))) for b in range(5)}
    assert edge == {0: [5], 1: [3, 4, 10], 2: [8, 9, 15], 3: [13, 14, 20], 4: [18, 19]}


@pytest.mark.parametrize("values", [[], [None], [1.5], [1.0, 2.0], [-0.0, 0.0, 0.0], [3.0, -1e300, 2.0, 1e300], [5e-324, -5e-324, 1.0], [1.0] * 7 + [9.0] * 8, [None, float("nan"), float("inf"), 4.0, -7.25]])
def test_medians_of_odd_columns(spark, values):
    known = [v for v in values if v is not None and math.isfinite(v)]
    df = spark.createDataFrame([(v, 1.0) for v in values], "`a.b` double, z double")
    assert scans.medians(df, ["a.b"]) == {"a.b": float(np.median(known)) if known else None}


def test_medians_of_many_columns_at_once(spark):
    rng = np.random.default_rng(2)
    columns = np.stack([rng.standard_normal(1001), rng.integers(-3, 4, 1001) * 1.0, np.exp(rng.standard_normal(1001) * 50), -np.abs(rng.standard_cauchy(1001))], axis=1)
    df = spark.createDataFrame(columns.tolist(), "a double, b double, c double, d double").repartition(6)
    assert list(scans.medians(df, list("abcd")).values()) == np.median(columns, axis=0).tolist()
    even = spark.createDataFrame(columns[:1000].tolist(), "a double, b double, c double, d double").repartition(6)
    assert list(scans.medians(even, list("abcd")).values()) == [even.agg(F.median(c)).first()[0] for c in "abcd"]


def plain_information(values, labels, k=3):
    from statistics import fmean

    def psi(n):
        return sum(1 / i for i in range(1, n)) - 0.57721566490153286061

    kept = [i for i in range(len(values)) if labels[i] is not None and labels.count(labels[i]) > 1]
    n_own = {c: labels.count(c) for c in set(labels)}
    ks, ms = [], []
    for i in kept:
        r = sorted(abs(values[i] - values[j]) for j in kept if j != i and labels[j] == labels[i])
        own = min(k, len(r))
        ks.append(own)
        ms.append(sum(abs(values[i] - values[j]) < r[own - 1] or values[i] == values[j] for j in kept))
    return max(0.0, psi(len(kept)) + fmean(map(psi, ks)) - fmean(psi(n_own[labels[i]]) for i in kept) - fmean(map(psi, ms)))


@pytest.mark.parametrize("block", [4, 50_000])
def test_information_equals_a_plain_count(spark, block):
    rng = random.Random(7)
    labels = [rng.choice(["a", "a", "b", "c", None]) for _ in range(150)] + ["once", "d", "d"]
    columns = {
        "useful": [rng.gauss(ord((c or "e")[0]), 0.7) for c in labels],
        "noise": [rng.random() for _ in labels],
        "ties": [float(rng.randint(0, 4)) for _ in labels],
        "constant": [2.0] * len(labels),
    }
    df = spark.createDataFrame(list(zip(labels, *columns.values(), strict=True)), "label string, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    out = {r["feature"]: r["information"] for r in information.neighbour_information(df, list(columns), block=block).collect()}
    assert out == pytest.approx({c: plain_information(v, labels) for c, v in columns.items()}, abs=1e-9)
    assert out["useful"] > 0.5 > 0.2 > out["noise"]


def test_selector_ranks_by_neighbours(spark):
    rng = random.Random(3)
    rows = [(str(i % 2), (i % 2) * 1.5 + rng.gauss(0, 1), rng.random(), 1.0, None if i % 40 == 0 else (i % 2) * 9 + rng.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "label string, useful double, noise double, constant double, best double")
    chosen = learning.fit_selector(df, ["noise", "useful", "constant", "best"])
    assert chosen.ranking == ["best", "useful", "noise"]
