"""Gradient-boosted trees over all classes, by histograms.

Each feature is cut at quantiles. A round grows one tree a class on the gradients of the softmax, level by level: tasks count gradients, curvatures and rows by (node, feature, bin), the counts
of a node and a few features meet in one group, and that returns its best split. So the driver sees a few numbers a node, and no rows. Several models grow in the same
passes, each without the rows of one held-out subject. Gradients are whole numbers of a small unit, so that sums, and with them trees, are the same in any order.

A row's scores are carried in a written table, renewed every ``RENEW`` rounds; trees that are younger are applied in each pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.operators import metrics, scans
from tidewindow.storage import delete_folder, new_folder

#: Gradients, curvatures and losses are counted in 1 / UNIT.
UNIT = 2.0**24
#: Features whose counts of a node meet in one group, cells that a task counts at a time, and rounds after which scores are written anew.
TOGETHER, CELLS, RENEW = 16, 4_000_000, 20
_BEST = "target long, feature int, cut int, gain double, gl long, hl long, nl long, g long, h long, n long"


@dataclass(frozen=True)
class Settings:
    """How trees grow. ``held_out`` is the share of rows that losses are told by; 0 switches early stopping off. ``levels`` bounds a tree's depth."""

    rounds: int = 250
    rate: float = 0.05
    leaves: int = 31
    levels: int = 10
    l2: float = 0.1
    min_leaf: int = 20
    bins: int = 255
    held_out: float = 0.12
    patience: int = 10
    tolerance: float = 1e-7
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order of their making: a feature and a cut, rows up to the cut go left; feature -1 at leaves."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        f, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while (inner := f[at] >= 0).any():
            goes = np.where(bins[rows, np.maximum(f[at], 0)] <= cut[at], left[at], right[at])
            at = np.where(inner, goes, at)
        return at

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        """The numbers of a node's new children."""
        kids = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, *kids
        for v in values:
            for column, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, v)):
                column.append(new)
        return kids


@dataclass
class Boosted:
    """A fitted model: fill values and cuts of each feature, first scores of each class (None for a class without rows), and a tree a class and round."""

    features: list[str]
    classes: list[str]
    fills: list[float]
    cuts: list[list[float]]
    base: list[float | None]
    trees: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """The bin of each value; missing and non-finite ones count as the fill value."""
        filled = np.where(np.isfinite(values), values, np.array(self.fills))
        return np.stack([np.searchsorted(np.array(c), filled[:, i], side="left") for i, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def start(self, n: int) -> np.ndarray:
        """The first scores of so many rows."""
        return np.tile([-np.inf if b is None else b for b in self.base], (n, 1))

    def added(self, scores: np.ndarray, bins: np.ndarray, since: int = 0) -> np.ndarray:
        """Scores with those of the trees from a round on."""
        scores = scores.copy()
        for trees in self.trees[since:]:
            for k, t in enumerate(trees):
                scores[:, k] += np.array(t.value)[t.nodes(bins)]
        return scores

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        bins = self.binned(values)
        return _softmax(self.added(self.start(len(bins)), bins))

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows with ``probs`` in class order, ``pred`` and ``confidence``."""
        given = rows.select("*", F.array(*(F.col(f"`{c}`").cast("double") for c in self.features)).alias("__x"))
        columns = rows.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", probs array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    probs = pa.array(self.probabilities(_values(b.column("__x"), len(self.features))).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), probs], [*columns, "probs"])

        names = F.array(*map(F.lit, self.classes))
        told = given.mapInArrow(run, schema)
        return told.withColumns({"pred": F.get(names, x.argmax(F.col("probs"))), "confidence": F.array_max("probs")})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        told = json.loads(text)
        return cls(**{**told, "trees": [[Tree(**t) for t in row] for row in told["trees"]]})


def _values(column: pa.Array, features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), features)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# -- before the first tree ------------------------------------------------------------------------------------------------


def _prepared(
    rows: DataFrame, features: Sequence[str], classes: Sequence[str], label: str, settings: Settings, weighting: str, masks: Sequence[Column]
) -> list[tuple[Boosted, np.ndarray, bool]]:
    """For the rows of each mask: an empty model with its fill values, cuts and first scores, the weight of each class, and whether losses are to be told.

    Early stopping is off where a class that occurs has fewer than two rows, or where fewer rows than classes would be held out.
    """
    names = [[f"m{k}_{i}" for i in range(len(features))] for k in range(len(masks))]
    known = {n: F.when(mask, x.finite(F.col(f"`{c}`").cast("double"))) for mask, own in zip(masks, names, strict=True) for n, c in zip(own, features, strict=True)}
    fills = {n: v if v is not None else 0.0 for n, v in scans.medians(rows.select(*(v.alias(n) for n, v in known.items())), list(known)).items()}
    places = [(i + 1) / settings.bins for i in range(settings.bins - 1)]
    filled = [F.when(mask, F.coalesce(known[n], F.lit(fills[n]))).alias(n) for mask, own in zip(masks, names, strict=True) for n in own]
    counts = [F.count_if(mask & (F.col(label) == c)).alias(f"n{k}_{j}") for k, mask in enumerate(masks) for j, c in enumerate(classes)]
    count = rows.agg(*counts).first()
    marks = rows.select(*filled).agg(*(F.struct(F.percentile_approx(n, places, 10_000).alias("at"), F.max(n).alias("top")).alias(n) for n in known)).first()
    out = []
    for k, own in enumerate(names):
        n = np.array([count[f"n{k}_{j}"] for j in range(len(classes))], dtype=float)
        present, total = np.count_nonzero(n), n.sum()
        if not total:
            raise ValueError("no rows of any class to train on")
        cuts = [sorted({v for v in marks[c]["at"] or () if v < marks[c]["top"]}) for c in own]
        weight = {"none": np.ones(len(n)), "balanced": total / (present * np.maximum(n, 1)), "root": np.sqrt(total / (present * np.maximum(n, 1)))}[weighting]
        share = n * weight / (n * weight).sum()
        stops = settings.held_out > 0 and n[n > 0].min() >= 2 and np.ceil(total * settings.held_out) >= present
        base = [float(np.log(s)) if s > 0 else None for s in share]
        out.append((Boosted(list(features), list(classes), [fills[c] for c in own], cuts, base), weight, bool(stops)))
    return out


class _Fit:
    """Models that grow together over one table ``fold, held, y, bins array<binary>, scores array<double>``, a part of the last two for each model."""

    def __init__(self, rows: DataFrame, models: Sequence[Boosted], weights: Sequence[np.ndarray], folds: Sequence[int | None], stops: Sequence[bool], settings: Settings) -> None:
        self.models, self.weights, self.folds, self.stops, self.settings = list(models), list(weights), list(folds), list(stops), settings
        self.since, self.path, self.spark = 0, None, rows.sparkSession
        self.classes, self.features = len(models[0].classes), len(models[0].features)
        self._write(rows, fresh=True)

    def _write(self, rows: DataFrame, fresh: bool = False) -> None:
        """The table anew, with the scores of all trees so far."""
        models, since, k = self.models, self.since, self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if fresh:
                    values = _values(b.column("x"), len(models[0].features))
                    bins = [m.binned(values) for m in models]
                    scores = np.hstack([m.start(len(values)) for m in models])
                else:
                    bins, scores = _opened(b, len(models))
                    scores = np.hstack([m.added(scores[:, i * k : (i + 1) * k], bins[i], since) for i, m in enumerate(models)])
                packed = pa.array([[own[r].tobytes() for own in bins] for r in range(b.num_rows)], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("fold", "held", "y")), packed, pa.array(scores.tolist(), pa.list_(pa.float64()))], ["fold", "held", "y", "bins", "scores"])

        path, before = new_folder(self.spark, "boosting"), self.path
        rows.mapInArrow(run, "fold int, held boolean, y int, bins array<binary>, scores array<double>").write.parquet(path)
        self.rows, self.path, self.since = self.spark.read.parquet(path), path, max((len(m.trees) for m in models), default=0)
        if before:
            delete_folder(self.spark, before)

    def close(self) -> None:
        delete_folder(self.spark, self.path)

    def best_splits(self, targets: Sequence[tuple[int, int, int]], growing: Mapping[tuple[int, int], Tree], losses: Sequence[int]) -> tuple[dict, dict[int, float]]:
        """(model, class, node) -> its best split, as a row of ``_BEST``, for each target that has one; model -> loss of its held-out rows, for each of ``losses``."""
        settings, models, weights, folds, stops, since, k, n_features = self.settings, self.models, self.weights, self.folds, self.stops, self.since, self.classes, self.features
        bins_at_most = max((len(c) for m in models for c in m.cuts), default=0) + 1

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(targets), n_features, 3, bins_at_most), dtype=np.int64)
            lost = {m: np.zeros(2, dtype=np.int64) for m in losses}
            for b in batches:
                bins, scores = _opened(b, len(models))
                fold, held, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "held", "y"))
                for i in sorted({t[0] for t in targets} | set(losses)):
                    mine = fold != folds[i] if folds[i] is not None else np.full(len(fold), True)
                    p = _softmax(models[i].added(scores[:, i * k : (i + 1) * k], bins[i], since))
                    w = weights[i][y]
                    if i in lost:
                        out = mine & held
                        loss = -np.log(np.clip(p[out, y[out]], 1e-300, None)) * w[out]
                        lost[i] += np.array([np.rint(loss * UNIT).sum(), np.rint(w[out] * UNIT).sum()]).astype(np.int64)
                    mine = mine & ~held if stops[i] else mine
                    for c in sorted({t[1] for t in targets if t[0] == i}):
                        g, h = (np.rint(v * UNIT) for v in (w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c])))
                        at = growing[i, c].nodes(bins[i])
                        for place, (_, _, node) in ((j, t) for j, t in enumerate(targets) if t[:2] == (i, c)):
                            here = np.flatnonzero(mine & (at == node))
                            cell = (np.arange(n_features) * bins_at_most + bins[i][here]).ravel()
                            for row, v in enumerate((g, h, None)):
                                each = None if v is None else np.repeat(v[here], n_features)
                                total[place, :, row] += np.bincount(cell, each, n_features * bins_at_most).reshape(n_features, -1).astype(np.int64)
            keys, blocks, parts = [], [], []
            for place in range(len(targets)):
                for block in range(0, n_features, TOGETHER):
                    if total[place, block, 2].any():
                        keys, blocks, parts = [*keys, place], [*blocks, block], [*parts, total[place, block : block + TOGETHER].tobytes()]
            for i, sums in lost.items():
                keys, blocks, parts = [*keys, -1 - i], [*blocks, 0], [*parts, sums.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], ["target", "block", "part"])

        def best(key: tuple, parts: pa.Table) -> pa.Table:
            target, block = (v.as_py() for v in key)
            sums = np.sum([np.frombuffer(p.as_py(), dtype=np.int64) for p in parts.column("part")], axis=0)
            if target < 0:
                row = [target, 0, 0, 0.0, int(sums[0]), int(sums[1]), 0, 0, 0, 0]
            else:
                row = [target, *_best_split(sums.reshape(-1, 3, bins_at_most), block, settings)]
            return pa.table({name.split()[0]: pa.array([v]) for name, v in zip(_BEST.split(", "), row, strict=True)}).cast(_BEST_SCHEMA)

        found = self.rows.mapInArrow(counted, "target long, block int, part binary").groupBy("target", "block").applyInArrow(best, _BEST).collect()
        splits: dict = {}
        for r in sorted(found, key=lambda r: (r["target"], -r["gain"], r["feature"])):
            if r["target"] >= 0:
                splits.setdefault(targets[r["target"]], r)
        return splits, {-1 - r["target"]: r["gl"] / r["hl"] if r["hl"] else 0.0 for r in found if r["target"] < 0}


_BEST_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in _BEST.split(", ")])


def _opened(batch: pa.RecordBatch, models: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The bins of each model and all scores of a batch."""
    packed = batch.column("bins").flatten().to_pylist()
    bins = [np.frombuffer(b"".join(packed[i::models]), dtype=np.uint8).reshape(batch.num_rows, -1) for i in range(models)]
    return bins, batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _best_split(counts: np.ndarray, first: int, settings: Settings) -> list:
    """The feature, cut and gain of the best split of ``counts(feature, (gradient, curvature, rows), bin)``, and the sums on its left and in all; gain 0 where there is none.

    Of equal gains the first feature's lowest cut is taken.
    """
    left = counts.cumsum(axis=2)
    whole = left[:, :, -1:]
    right = whole - left

    def worth(s: np.ndarray) -> np.ndarray:
        g, h = s[:, 0] / UNIT, s[:, 1] / UNIT
        return g * g / (h + settings.l2 + 1e-12)

    gain = worth(left) + worth(right) - worth(whole)
    allowed = (left[:, 2] >= settings.min_leaf) & (right[:, 2] >= settings.min_leaf)
    gain = np.where(allowed, gain, 0.0)
    f, cut = np.unravel_index(gain.argmax(), gain.shape)
    return [first + int(f), int(cut), float(max(gain[f, cut], 0.0)), *(int(v) for v in left[f, :, cut]), *(int(v) for v in whole[f, :, 0])]


def _stopped(losses: Sequence[float], settings: Settings) -> bool:
    """Whether none of the last ``patience`` losses is below the one before them."""
    if len(losses) <= settings.patience:
        return False
    return not any(v < losses[-settings.patience - 1] - settings.tolerance for v in losses[-settings.patience :])


def fit_boosted(
    rows: DataFrame, features: Sequence[str], classes: Sequence[str], keys: Sequence[str], label: str = "label", settings: Settings | None = None,
    weighting: str = "balanced", fold: Column | None = None, folds: Sequence[int | None] = (None,),
) -> dict[int | None, Boosted]:
    """A model for each of ``folds``, trained on the rows whose ``fold`` is another; None trains on all rows.

    Rows with a label that isn't a class are left out. ``keys`` name a row: those whose hashed keys fall into the held-out share tell the loss. A model stops when none of the last
    losses was better than the one before them. A tree's levels are cut off at ``leaves``, the best splits first. A class without rows is never predicted.
    """
    settings = settings or Settings()
    if not 2 <= settings.bins <= 256:
        raise ValueError("between 2 and 256 bins")
    rows = rows.where(F.col(label).isin(*classes))
    fold = F.lit(None).cast("int") if fold is None else fold.cast("int")
    prepared = _prepared(rows, features, classes, label, settings, weighting, [F.lit(True) if f is None else ~fold.eqNullSafe(F.lit(f)) for f in folds])
    held = F.pmod(F.xxhash64(F.lit(settings.seed), *keys), F.lit(1_000_000)) < int(settings.held_out * 1_000_000)
    index = F.array_position(F.array(*map(F.lit, classes)), F.col(label)).cast("int") - 1
    given = rows.select(
        F.coalesce(fold, F.lit(-1)).alias("fold"), held.alias("held"), index.alias("y"), F.transform(F.array(*(F.col(f"`{c}`").cast("double") for c in features)), lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x")
    )
    fit = _Fit(given, [p[0] for p in prepared], [p[1] for p in prepared], folds, [p[2] for p in prepared], settings)
    try:
        going = list(range(len(folds)))
        for r in range(settings.rounds):
            if r and r % RENEW == 0:
                fit._write(fit.rows)
            going = _round(fit, going)
            if not going:
                break
    finally:
        fit.close()
    return dict(zip(folds, fit.models, strict=True))


def _round(fit: _Fit, going: list[int]) -> list[int]:
    """One more tree a class for each model that goes on, and which ones do."""
    settings = fit.settings
    classes = {i: [c for c, b in enumerate(fit.models[i].base) if b is not None] for i in going}
    growing = {(i, c): Tree() for i in going for c in range(fit.classes)}
    frontier = [(i, c, 0) for i in going for c in classes[i]]
    leaves = dict.fromkeys(growing, 1)
    losses = [i for i in going if fit.stops[i]]
    size = max(1, CELLS // (fit.features * 3 * settings.bins))
    for level in range(settings.levels):
        splits: dict = {}
        for start in range(0, len(frontier), size):
            found, told = fit.best_splits(frontier[start : start + size], growing, losses if level == start == 0 else ())
            splits |= found
            for i, loss in told.items():
                fit.models[i].losses.append(loss)
        if level == 0:
            going = [i for i in going if not _stopped(fit.models[i].losses, settings)]
        frontier = []
        for (i, c, node), r in sorted(splits.items(), key=lambda s: (-s[1]["gain"], s[0])):
            tree = growing[i, c]
            if i not in going:
                continue
            if node == 0 and level == 0:
                tree.value[0] = _leaf(r["g"], r["h"], settings)
            if r["gain"] > 0 and leaves[i, c] < settings.leaves:
                sides = (r["gl"], r["hl"], r["nl"]), (r["g"] - r["gl"], r["h"] - r["hl"], r["n"] - r["nl"])
                kids = tree.split(node, r["feature"], r["cut"], tuple(_leaf(g, h, settings) for g, h, _ in sides))
                leaves[i, c] += 1
                frontier += [(i, c, kid) for kid, (_, _, n) in zip(kids, sides, strict=True) if n >= 2 * settings.min_leaf]
        frontier = sorted(t for t in frontier if leaves[t[:2]] < settings.leaves)
        if not frontier:
            break
    for i in going:
        fit.models[i].trees.append([growing[i, c] for c in range(fit.classes)])
    return going


def _leaf(g: int, h: int, settings: Settings) -> float:
    return -settings.rate * (g / UNIT) / (h / UNIT + settings.l2 + 1e-12)


def leave_one_subject_out(
    rows: DataFrame, features: Sequence[str], classes: Sequence[str], abnormal: Sequence[str], subjects: Sequence[int], keys: Sequence[str], settings: Settings | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(held_out_subject, truth, pred)`` of every row by the trees of the other subjects, which grow in the same passes, and the metrics by fold and pooled."""
    models = fit_boosted(rows, features, classes, keys, settings=settings, fold=F.col("subject_id"), folds=subjects)
    told = [models[s].predict(rows.where(F.col("subject_id") == s)).select(F.lit(s).alias("held_out_subject"), F.col("label").alias("truth"), "pred") for s in subjects]
    out = reduce(DataFrame.unionByName, told)
    return out, metrics.pooled_and_folds(metrics.valid_truth(out, classes), classes, abnormal)
