"""Transition models and Viterbi decoding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.functions.expressions import argmax, group_fusion
from tidewindow.operators.frames import in_parts, overlapping, settled
from tidewindow.storage import new_folder

FLOOR = 1e-12
#: Positions of a subject that one task decodes at a time, and the unit of logarithms.
BLOCK = 4096
UNIT = 2.0**32


def class_dimension(spark, classes: Sequence[str]) -> DataFrame:
    """``(class_idx, class)`` in a fixed order."""
    return spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "class_idx int, class string")


def transition_counts(frames: DataFrame, classes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(label, n)`` of the labels that open a run and ``(before, label, n)`` of steps within runs.

    A label that isn't a class ends a run, as a subject's end does.
    """
    valid = F.col("label").isin(*classes)
    own = overlapping(frames.select("subject_id", "pos", "label"), 1)
    rows = settled(own.select("label", F.lag("label").over(in_parts()).alias("before"), F.coalesce(valid, F.lit(False)).alias("valid"), "__copied"))
    rows = rows.where("valid").withColumn("inside", F.coalesce(F.col("before").isin(*classes), F.lit(False)))
    opens = rows.where("not inside").groupBy("label").agg(F.count("*").alias("n"))
    return opens, rows.where("inside").groupBy("before", "label").agg(F.count("*").alias("n"))


def transition_model(frames: DataFrame, classes: Sequence[str], laplace: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``(class, p)`` of a run's first label and ``(before, class, p)`` of steps, both smoothed and complete."""
    if laplace <= 0:
        raise ValueError("laplace must be positive")
    names = class_dimension(frames.sparkSession, classes).select("class")
    opens, steps = transition_counts(frames, classes)
    n = F.coalesce("n", F.lit(0)) + laplace
    initial = names.join(opens.withColumnRenamed("label", "class"), "class", "left").withColumn("w", n)
    initial = initial.select("class", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("p"))
    pairs = names.select(F.col("class").alias("before")).crossJoin(names)  # classes by classes, a literal table
    moves = pairs.join(steps.withColumnRenamed("label", "class"), ["before", "class"], "left").withColumn("w", n)
    return initial, moves.select("before", "class", (F.col("w") / F.sum("w").over(Window.partitionBy("before"))).alias("p"))


def _units(p: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logarithms as whole numbers: sums are the same in whatever order they are made, so equals stay equal."""
    return np.rint(strength * np.log(np.clip(p, FLOOR, None)) * UNIT).astype(np.int64)


def _forward(emit: np.ndarray, move: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The predecessors of each class at each frame for each strength, and the scores at the last one, from the scores before the first."""
    back = np.zeros((len(emit), *score.shape), dtype=np.int64)
    for t in range(len(emit)):
        reached = score[:, :, None] + move
        back[t] = reached.argmax(axis=1)
        score = reached.max(axis=1) + emit[t]
    return back, score


def _backward(back: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class before each frame for each strength, from the classes at the last one."""
    path, each = np.empty(back.shape[:2], dtype=np.int64), np.arange(len(end))
    for t in range(len(back) - 1, -1, -1):
        path[t] = end = back[t, each, end]
    return path


def _scaled(transition: np.ndarray, initial: np.ndarray, strengths: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of transitions and of first classes, scaled by each strength."""
    return np.stack([_units(transition, s) for s in strengths]), np.stack([_units(initial, s) for s in strengths])


def _best_paths(emissions: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The path of class indices of each strength, frames by strengths."""
    emit = _units(emissions)
    back, score = _forward(emit[1:], move, emit[0] + first)
    end = score.argmax(axis=1)
    return np.vstack([_backward(back, end), end])


def viterbi(emissions: np.ndarray, transition: np.ndarray, initial: np.ndarray, strength: float) -> np.ndarray:
    """The most probable path of class indices; ``strength`` scales the logarithms of transition and initial probabilities.

    Of equally good predecessors, and of equally good ends, the lowest class is taken.
    """
    return _best_paths(emissions, *_scaled(transition, initial, [strength]))[:, 0]


#: Numbers of predecessors that a task holds at a time: sequences by positions by strengths by classes.
HELD = 32_000_000


def _trellis(emissions: np.ndarray, lengths: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The paths of many sequences at once: sequences by strengths by positions. ``emissions``: sequences, longest first, by positions by classes, filled up behind their lengths.

    A step is taken for all sequences that last so long and all strengths.
    """
    emit = _units(emissions)
    s, t, k = emit.shape
    n = len(move)
    active = np.searchsorted(-lengths, -np.arange(t), side="left")  # sequences longer than each position
    score = emit[:, 0, None, :] + first
    back = np.zeros((t, s, n, k), dtype=np.uint8 if k < 256 else np.int32)
    for at in range(1, t):
        m = active[at]
        reached = score[:m, :, :, None] + move
        back[at, :m] = reached.argmax(axis=2)
        score[:m] = reached.max(axis=2) + emit[:m, at, None, :]
    path = np.zeros((s, n, t), dtype=np.int32)
    now = score.argmax(axis=2)
    rows, strengths = np.arange(s)[:, None], np.arange(n)[None, :]
    path[rows, strengths, lengths[:, None] - 1] = now
    for at in range(t - 1, 0, -1):
        m = active[at]
        now[:m] = back[at, rows[:m], strengths, now[:m]]
        path[:m, :, at - 1] = now[:m]
    return path


def _sequences(sequences: DataFrame, move: np.ndarray, first: np.ndarray) -> DataFrame:
    """``sequences(..., frames array<struct<pos, probs, ...>>)`` with ``paths``, an array of class numbers for each strength."""
    n, k = first.shape
    columns = sequences.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames = b.column("frames")
            lengths = np.diff(frames.offsets.to_numpy())
            probs = frames.flatten().field("probs").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            begins = np.cumsum(lengths) - lengths
            order, found, at = np.argsort(-lengths, kind="stable"), {}, 0
            while at < len(order):
                longest = max(int(lengths[order[at]]), 1)
                own = order[at : at + max(1, HELD // (longest * n * k))]
                at += len(own)
                padded = np.ones((len(own), longest, k))
                for i, r in enumerate(own):
                    padded[i, : lengths[r]] = probs[begins[r] : begins[r] + lengths[r]]
                paths = _trellis(padded, lengths[own], move, first)
                found |= {r: paths[i, :, : lengths[r]] for i, r in enumerate(own)}
            flat = np.concatenate([found[r].ravel() for r in range(len(lengths))]) if len(lengths) else np.empty(0, dtype=np.int32)
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.repeat(lengths, n))]).astype(np.int32)), pa.array(flat.astype(np.int32)))
            outer = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(lengths) + 1, n, dtype=np.int32)), inner)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), outer], [*columns, "paths"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sequences.schema)
    return sequences.mapInArrow(run, f"{kinds}, paths array<array<int>>")


def _told(sequences: DataFrame, strengths: Sequence[float], classes: Sequence[str]) -> DataFrame:
    """The frames of sequences with paths, a row for each strength and frame with ``strength``, ``label`` and ``confidence``."""
    keys = [c for c in sequences.columns if c not in ("frames", "paths")]
    each = sequences.select(*keys, "frames", F.posexplode("paths").alias("which", "path")).select(*keys, "which", F.inline(F.arrays_zip("frames", "path"))).select(*keys, "which", "frames.*", "path")
    names, at = F.array(*map(F.lit, classes)), F.array(*(F.lit(float(v)) for v in strengths))
    return each.withColumns({"strength": F.get(at, F.col("which")), "label": F.get(names, F.col("path")), "confidence": F.get("probs", F.col("path"))}).drop("which", "probs", "path")


def _collected(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., frames``: the other columns of a sequence's rows as structs in order of ``pos``; a sequence is a block at most."""
    others = [c for c in rows.columns if c not in (*keys, "pos")]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", *others))).alias("frames"))


def _paths(rows: DataFrame, keys: Sequence[str], transition: np.ndarray, initial: np.ndarray, strengths: Sequence[float], classes: Sequence[str], block: int) -> DataFrame:
    """``rows(keys..., pos, probs, ...)`` without ``probs``, with ``strength``, ``label`` and ``confidence``: the paths :func:`viterbi` finds for each of ``keys`` at each strength.

    Sequences up to a block are decoded many at a time, filled up to a common length. Longer ones, if there are any, are cut into blocks that tasks decode in parallel.
    """
    move, first = _scaled(transition, initial, strengths)
    spark, table = rows.sparkSession, new_folder(rows.sparkSession, "decode")  # read several times, worked out once
    rows.write.parquet(table)
    rows = spark.read.schema(rows.schema).parquet(table)
    long = rows.where(F.col("pos") >= block).select(*keys).distinct()
    if long.isEmpty():
        return _told(_sequences(_collected(rows, keys), move, first), strengths, classes)
    short = _told(_sequences(_collected(rows.join(long, list(keys), "left_anti"), keys), move, first), strengths, classes)
    blocks = _block_paths(rows.join(long, list(keys), "left_semi"), keys, transition, initial, strengths, classes, block)
    return short.unionByName(blocks)


def _block_paths(rows: DataFrame, keys: Sequence[str], transition: np.ndarray, initial: np.ndarray, strengths: Sequence[float], classes: Sequence[str], block: int) -> DataFrame:
    """As :func:`_paths`, for sequences of several blocks, of which no task holds more than one.

    Each block's best scores from every class before it to every class at its end are found in parallel; chaining these gives the scores that enter each block. From those a second pass finds the class
    before the block for each class at its end; chaining these gives the ends, from which the last pass follows each block's path.
    """
    k, n, names = len(classes), len(strengths), np.array(list(classes), dtype=object)
    move, first = _scaled(transition, initial, strengths)
    carried = [c for c in rows.columns if c != "probs"]
    out = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried) + ", strength double, label string, confidence double"

    def ordered(g: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        g = g.sort_values("pos", kind="stable")
        return g, np.stack(g["probs"].to_numpy())

    def told(g: pd.DataFrame, emissions: np.ndarray, found: np.ndarray) -> pd.DataFrame:
        """A row for each frame and strength."""
        at = np.arange(len(found))
        return pd.concat([g[carried].assign(strength=float(s), label=names[found[:, i]], confidence=emissions[at, found[:, i]]) for i, s in enumerate(strengths)])

    rows = rows.withColumn("block", F.floor(F.col("pos") / block))
    by = [*keys, "block"]
    typed = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def matrix(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        emit = _units(ordered(g)[1])
        best = np.concatenate([move, first[:, None, :]], axis=1) + emit[0]  # the last row is for a block that opens its sequence
        for e in emit[1:]:
            best = (best[:, :, :, None] + move[:, None, :, :]).max(axis=2) + e
        return pd.DataFrame([[*key, best.ravel().tolist()]], columns=[*by, "best"])

    def chained(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, entries, score = g.sort_values("block"), [], None
        for best in g["best"]:
            best = np.asarray(best).reshape(n, k + 1, k)
            entries.append([] if score is None else score.ravel().tolist())
            score = best[:, k] if score is None else (score[:, :, None] + best[:, :k]).max(axis=1)
            score = score - score.max(axis=1, keepdims=True)
        ends = [[-1] * n] * (len(g) - 1) + [score.argmax(axis=1).tolist()]
        return g[by].assign(entry=entries, end=ends)

    def traced(g: pd.DataFrame, entry: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """The block's rows, their emissions, and the predecessors of its frames; of an opening block, from its second frame on."""
        g, emissions = ordered(g)
        emit = _units(emissions)
        back, _ = _forward(emit, move, entry.reshape(n, k)) if len(entry) else _forward(emit[1:], move, emit[0] + first)
        return g, emissions, back

    def befores(key: tuple, g: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        _, _, back = traced(g, np.asarray(at["entry"].iat[0], dtype=np.int64))
        before = np.tile(np.arange(k), (n, 1))
        for b in back[::-1]:
            before = np.take_along_axis(b, before, axis=1)
        return pd.DataFrame([[*key, at["entry"].iat[0], at["end"].iat[0], before.ravel().tolist()]], columns=[*by, "entry", "end", "before"])

    def ended(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, ends = g.sort_values("block", ascending=False), []
        end = np.asarray(g["end"].iat[0])
        for before in g["before"]:
            ends.append(end.tolist())
            end = np.asarray(before).reshape(n, k)[np.arange(n), end]
        return g[[*by, "entry"]].assign(end=ends)

    def path(g: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        entry, end = np.asarray(at["entry"].iat[0], dtype=np.int64), np.asarray(at["end"].iat[0])
        g, emissions, back = traced(g, entry)
        return told(g, emissions, np.vstack([_backward(back, end)[1 if len(entry) else 0 :], end]))

    blocks = rows.groupBy(*by)
    entries = blocks.applyInPandas(matrix, f"{typed}, best array<long>").groupBy(*keys).applyInPandas(chained, f"{typed}, entry array<long>, end array<int>")
    seen = blocks.cogroup(entries.groupBy(*by)).applyInPandas(befores, f"{typed}, entry array<long>, end array<int>, before array<int>")
    ends = seen.groupBy(*keys).applyInPandas(ended, f"{typed}, entry array<long>, end array<int>")
    return blocks.cogroup(ends.groupBy(*by)).applyInPandas(path, out)


def _likeliest(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """As :func:`_paths` at strength 0, where each frame stands for itself."""
    names = F.array(*map(F.lit, classes))
    return rows.withColumns({"label": F.get(names, argmax(F.col("probs"))), "confidence": F.array_max("probs")}).drop("probs")


def decode(frames: DataFrame, transition: np.ndarray, initial: np.ndarray, classes: Sequence[str], strength: float, block: int = BLOCK) -> DataFrame:
    """``(subject_id, pos, label, confidence)``: each subject's path over ``frames(subject_id, pos, probs)``; confidence is the label's probability."""
    rows = frames.select("subject_id", F.col("pos").cast("long").alias("pos"), "probs")
    out = _paths(rows, ["subject_id"], transition, initial, [strength], classes, block) if strength else _likeliest(rows, classes)
    return out.select("subject_id", "pos", "label", "confidence")


def decode_grid(frames: DataFrame, group: DataFrame, truth: DataFrame, transition: np.ndarray, initial: np.ndarray, classes: Sequence[str], abnormal: Sequence[str], alphas: Sequence[float], strengths: Sequence[float], block: int = BLOCK) -> DataFrame:
    """``(alpha, strength, subject_id, pos, truth, label)``: every setting of gate and decoder over every subject, all strengths of a gate in one pass."""
    rows = frames.join(group.select("subject_id", "pos", F.col("probs").alias("gate")), ["subject_id", "pos"]).join(truth, ["subject_id", "pos"])
    rows = rows.select("subject_id", F.col("pos").cast("long").alias("pos"), "truth", "probs", "gate")
    spark, table = rows.sparkSession, new_folder(rows.sparkSession, "grid")
    rows.write.parquet(table)
    rows = spark.read.schema(rows.schema).parquet(table)
    settings = F.explode(F.array(*(F.lit(float(a)) for a in alphas))).alias("alpha")

    def fused(probs: Column, gate: Column) -> Column:
        return group_fusion(probs, gate, F.col("alpha"), classes, abnormal)

    long = rows.where(F.col("pos") >= block).select("subject_id").distinct()
    some = not long.isEmpty()
    # gates fuse a subject's whole frames, so that its probabilities are shuffled once, whatever the number of settings
    each = _collected(rows.join(long, "subject_id", "left_anti") if some else rows, ["subject_id"]).select("subject_id", "frames", settings)
    each = each.withColumn("frames", F.transform("frames", lambda f: F.struct(f["pos"].alias("pos"), f["truth"].alias("truth"), fused(f["probs"], f["gate"]).alias("probs"))))
    out = _told(_sequences(each, *_scaled(transition, initial, strengths)), strengths, classes)
    if some:
        own = rows.join(long, "subject_id", "left_semi").select("subject_id", "pos", "truth", settings, "probs", "gate")
        own = own.select("subject_id", "pos", "truth", "alpha", fused(F.col("probs"), F.col("gate")).alias("probs"))
        out = out.unionByName(_block_paths(own, ["alpha", "subject_id"], transition, initial, strengths, classes, block))
    return out.select("alpha", "strength", "subject_id", "pos", "truth", "label")
