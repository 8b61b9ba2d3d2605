"""Boosted trees against the same in plain Python, and their early stopping."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewindow.operators import boosting as bo

CLASSES = ("a", "b", "c")
FEATURES = ("u", "v", "w")


def table(spark, n=160, noise=0.2, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        u, v = rng.choice([0.0, 1.0, 2.0, 3.5]), rng.gauss(0, 1)
        y = "a" if u < 1.5 else "b" if v < 0 else "c"
        y = rng.choice(CLASSES) if rng.random() < noise else y
        rows.append((i, i % 4, None if i % 9 == 0 else u, float("nan") if i % 11 == 0 else v, 7.0, y))
    return spark.createDataFrame(rows, "id long, subject int, u double, v double, w double, label string")


def plain(rows, s, held, weighting=True):
    """Cuts, trees as nested tuples and probabilities by loops over rows."""
    columns = {f: [r[f] if r[f] is not None and math.isfinite(r[f]) else None for r in rows] for f in FEATURES}
    values = {}
    for f, own in columns.items():
        known = sorted(v for v in own if v is not None)
        m = len(known)
        values[f] = [v if v is not None else (known[(m - 1) // 2] + known[m // 2]) / 2 for v in own]
    cuts = {}
    for f, own in values.items():
        order = sorted(own)
        marks = {order[max(math.ceil(len(order) * (i + 1) / s.bins) - 1, 0)] for i in range(s.bins - 1)}
        cuts[f] = sorted(m for m in marks if m < order[-1])
    bins = {f: [sum(c < v for c in cuts[f]) for v in values[f]] for f in FEATURES}
    y = [CLASSES.index(r["label"]) for r in rows]
    count = [y.count(c) for c in range(3)]
    weight = [len(y) / (3 * n) if weighting else 1.0 for n in count]
    total = sum(n * w for n, w in zip(count, weight, strict=True))
    scores = [[math.log(n * w / total) for n, w in zip(count, weight, strict=True)] for _ in rows]
    rounds = []
    for _ in range(s.rounds):
        p = [[math.exp(v - max(q)) for v in q] for q in scores]
        p = [[v / sum(q) for v in q] for q in p]
        trees = []
        for c in range(3):
            g = [round(weight[y[i]] * (p[i][c] - (y[i] == c)) * bo.UNIT) for i in range(len(y))]
            h = [round(weight[y[i]] * p[i][c] * (1 - p[i][c]) * bo.UNIT) for i in range(len(y))]
            trees.append(plain_tree([i for i in range(len(y)) if not held[i]], bins, cuts, g, h, s))
        for i in range(len(y)):
            for c in range(3):
                scores[i][c] += fall(trees[c], {f: bins[f][i] for f in FEATURES})
        rounds.append(trees)
    p = [[math.exp(v - max(q)) for v in q] for q in scores]
    return cuts, rounds, [[v / sum(q) for v in q] for q in p]


def plain_tree(rows, bins, cuts, g, h, s):
    """Level by level, the best splits of a level first while leaves last."""

    def leaf(own):
        return -s.rate * (sum(g[i] for i in own) / bo.UNIT) / (sum(h[i] for i in own) / bo.UNIT + s.l2 + 1e-12)

    def worth(own):
        a, b = sum(g[i] for i in own) / bo.UNIT, sum(h[i] for i in own) / bo.UNIT
        return a * a / (b + s.l2 + 1e-12)

    tree = [None, leaf(rows), rows]
    frontier, leaves = [tree], 1
    for _ in range(s.levels):
        found = []
        for k, node in enumerate(frontier):
            best = None
            for f in FEATURES:
                for cut in range(len(cuts[f])):
                    left, right = [i for i in node[2] if bins[f][i] <= cut], [i for i in node[2] if bins[f][i] > cut]
                    if min(len(left), len(right)) >= s.min_leaf:
                        gain = worth(left) + worth(right) - worth(node[2])
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, cut, left, right)
            if best:
                found.append((-best[0], k, best, node))
        frontier = []
        for _, _, (_, f, cut, left, right), node in sorted(found, key=lambda x: x[:2]):
            if leaves < s.leaves:
                kids = [None, leaf(left), left], [None, leaf(right), right]
                node[0] = (f, cut, *kids)
                leaves += 1
                frontier += kids
        if not frontier:
            break
    return tree


def fall(tree, row):
    while tree[0]:
        f, cut, left, right = tree[0]
        tree = left if row[f] <= cut else right
    return tree[1]


def shape(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return FEATURES[tree.feature[node]], tree.cut[node], shape(tree, tree.left[node]), shape(tree, tree.right[node])


def plain_shape(tree):
    return (tree[0][0], tree[0][1], plain_shape(tree[0][2]), plain_shape(tree[0][3])) if tree[0] else tree[1]


def flat(told):
    return [told] if not isinstance(told, tuple) else [told[:2], *flat(told[2]), *flat(told[3])]


SMALL = bo.Settings(rounds=3, rate=0.3, leaves=5, min_leaf=6, bins=8, held_out=0.0)


def same_trees(model, expected):
    for got, trees in zip(model.trees, expected, strict=True):
        for a, b in zip(got, trees, strict=True):
            one, two = flat(shape(a)), flat(plain_shape(b))
            assert [v for v in one if isinstance(v, tuple)] == [v for v in two if isinstance(v, tuple)]
            assert [v for v in one if not isinstance(v, tuple)] == pytest.approx([v for v in two if not isinstance(v, tuple)], abs=1e-6)


def test_trees_and_probabilities_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(bo, "RENEW", 2)
    df = table(spark).repartition(5)
    rows = df.orderBy("id").collect()
    model = bo.fit_boosted(df, FEATURES, CLASSES, ["id"], settings=SMALL)[None]
    cuts, trees, probs = plain(rows, SMALL, [False] * len(rows))
    assert model.cuts == [cuts[f] for f in FEATURES]
    same_trees(model, trees)
    told = {r["id"]: r for r in model.predict(df).collect()}
    for r, p in zip(rows, probs, strict=True):
        assert list(told[r["id"]]["probs"]) == pytest.approx(p, abs=1e-6)
        assert told[r["id"]]["pred"] == CLASSES[int(np.argmax(told[r["id"]]["probs"]))]


def test_folds_grow_together_as_they_grow_alone(spark):
    df = table(spark)
    both = bo.fit_boosted(df, FEATURES, CLASSES, ["id"], settings=SMALL, fold=F.col("subject"), folds=(0, 3, None))
    for s in (0, 3, None):
        own = df if s is None else df.where(F.col("subject") != s)
        alone = bo.fit_boosted(own.repartition(3), FEATURES, CLASSES, ["id"], settings=SMALL)[None]
        assert both[s].to_json() == alone.to_json()


def test_few_cells_at_a_time_change_nothing(spark, monkeypatch):
    df = table(spark)
    one = bo.fit_boosted(df, FEATURES, CLASSES, ["id"], settings=SMALL)[None]
    monkeypatch.setattr(bo, "CELLS", 1)
    assert bo.fit_boosted(df, FEATURES, CLASSES, ["id"], settings=bo.Settings(**{**SMALL.__dict__, "rounds": 1}))[None].trees == one.trees[:1]


def test_noise_stops_early_and_signal_goes_on(spark):
    s = bo.Settings(rounds=12, rate=0.5, leaves=8, min_leaf=2, bins=16, held_out=0.3, patience=2)
    noise = bo.fit_boosted(table(spark, noise=1.0), FEATURES, CLASSES, ["id"], settings=s)[None]
    assert len(noise.trees) < 8 and len(noise.losses) == len(noise.trees) + 1
    assert not any(v < noise.losses[-3] - s.tolerance for v in noise.losses[-2:])
    clear = bo.fit_boosted(table(spark, noise=0.0), FEATURES, CLASSES, ["id"], settings=bo.Settings(**{**s.__dict__, "rate": 0.1, "rounds": 8}))[None]
    assert len(clear.trees) == 8 and clear.losses == sorted(clear.losses, reverse=True)


def test_small_classes_switch_early_stopping_off(spark):
    s = bo.Settings(rounds=4, rate=0.5, leaves=4, min_leaf=2, bins=16, held_out=0.3, patience=1)
    df = table(spark, noise=1.0)
    one = df.where("label = 'c'").orderBy("id").limit(1)
    small = df.where("label <> 'c'").unionByName(one)
    model = bo.fit_boosted(small, FEATURES, CLASSES, ["id"], settings=s)[None]
    assert model.losses == [] and len(model.trees) == 4
    few = bo.fit_boosted(df.orderBy("id").limit(6), FEATURES, CLASSES, ["id"], settings=bo.Settings(rounds=2, held_out=0.12, min_leaf=1))[None]
    assert few.losses == []


def test_absent_classes_and_odd_rows(spark):
    df = table(spark).withColumn("label", F.when(F.col("label") == "b", "other").otherwise(F.col("label"))).withColumn("__y", F.lit("taken"))
    model = bo.fit_boosted(df, FEATURES, CLASSES, ["id"], settings=SMALL)[None]
    told = model.predict(df.withColumns({"u": F.lit(None).cast("double"), "v": F.lit(float("inf"))})).collect()
    assert all(r["probs"][1] == 0 and sum(r["probs"]) == pytest.approx(1) for r in told) and len(told) == 160
    again = bo.Boosted.from_json(model.to_json())
    assert again == model and again.predict(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        bo.fit_boosted(df.where("label = 'other'"), FEATURES, CLASSES, ["id"])
