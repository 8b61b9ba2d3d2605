"""Overlapping windows by number of rows.

A window is ``[start_pos, end_pos)`` within a subject. Frames name the windows that hold them, so that windows and frames
meet by an equi-key; no range join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.operators.frames import missing_columns

KEYS = ("subject_id", "start_pos")


def window_starts(n: Column, size: int, stride: int, cover_tail: bool = False) -> Column:
    """Starts for ``n`` rows: 0, stride, ... up to ``n - size``, and with ``cover_tail`` also ``n - size``; 0 alone if ``n`` is at most ``size``, none if it is 0."""
    grid = F.sequence(F.lit(0).cast("long"), F.greatest(n - size, F.lit(0)).cast("long"), F.lit(stride).cast("long"))
    starts = F.array_distinct(F.concat(grid, F.array((n - size).cast("long")))) if cover_tail else grid
    none = F.expr("cast(array() as array<bigint>)")
    return F.when(n <= 0, none).when(n <= size, F.array(F.lit(0).cast("long"))).otherwise(starts)


def starts_holding(pos: Column, n: Column, size: int, stride: int, cover_tail: bool = False) -> Column:
    """The starts of the windows that hold the frame ``pos`` of ``n``."""
    low = F.greatest(F.lit(0).cast("long"), F.ceil((pos - size + 1) / F.lit(stride)))
    high = F.least(F.floor(pos / F.lit(stride)), F.floor((n - size) / F.lit(stride)))
    none = F.expr("cast(array() as array<bigint>)")
    held = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(none)  # sequence counts down otherwise
    if cover_tail:
        held = F.array_distinct(F.concat(held, F.when(pos >= n - size, F.array((n - size).cast("long"))).otherwise(none)))
    return F.when(n <= size, F.array(F.lit(0).cast("long"))).otherwise(held)


def with_length(frames: DataFrame) -> DataFrame:
    """Frames with ``n_frames`` of their subject, counted apart, so that no task holds a subject."""
    n = frames.groupBy(F.col("subject_id").alias("__s")).agg(F.count("*").alias("n_frames"))
    return frames.join(n, F.col("subject_id").eqNullSafe(F.col("__s"))).drop("__s")


def frames_in_windows(frames: DataFrame, size: int, stride: int, cover_tail: bool = False) -> DataFrame:
    """Each frame once for each window that holds it, with ``start_pos``."""
    held = starts_holding(F.col("pos"), F.col("n_frames"), size, stride, cover_tail)
    return with_length(frames).withColumn("start_pos", F.explode(held)).drop("n_frames")


def window_table(frames: DataFrame, size: int, stride: int, cover_tail: bool = False) -> DataFrame:
    """``(subject_id, start_pos, end_pos)`` of each subject's windows."""
    n = frames.groupBy("subject_id").agg(F.count("*").alias("n"))
    out = n.withColumn("start_pos", F.explode(window_starts(F.col("n"), size, stride, cover_tail)))
    return out.select("subject_id", "start_pos", F.least(F.col("start_pos") + size, F.col("n")).alias("end_pos"))


def window_metadata(framed: DataFrame, frame_id: str = "frame_id") -> DataFrame:
    """Of frames in windows: ``start_pos, end_pos, frame_start, frame_end``, the last of these inclusive."""
    return framed.groupBy(*KEYS).agg(
        (F.max("pos") + 1).alias("end_pos"), F.min_by(frame_id, "pos").alias("frame_start"), F.max_by(frame_id, "pos").alias("frame_end")
    )


def majority_labels(framed: DataFrame, classes: Sequence[str], threshold: float = 0.70, label: str = "label") -> DataFrame:
    """``(subject_id, start_pos, label, share)``: the most common class of each window if its share of all frames reaches the threshold, else NULL.

    Frames without a class count in the share; of equally common classes the one found first is taken.
    """
    counts = framed.groupBy(*KEYS, label).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    valid = F.col(label).isin(*classes)
    best = F.max(F.when(valid, F.struct("n", (-F.col("first")).alias("early"), F.col(label).alias("name")))).alias("best")
    out = counts.groupBy(*KEYS).agg(best, F.sum("n").alias("frames")).withColumn("share", F.col("best.n") / F.col("frames"))
    return out.select(*KEYS, F.when(F.col("share") >= threshold, F.col("best.name")).alias("label"), "share")


def labelled_windows(frames: DataFrame, classes: Sequence[str], size: int, stride: int, threshold: float = 0.70) -> DataFrame:
    """Frames of the windows that have a label, with it; windows without one are gone before anything is computed on them."""
    framed = frames_in_windows(frames.withColumnRenamed("label", "frame_label"), size, stride)
    labels = majority_labels(framed, classes, threshold, "frame_label").where("label is not null").drop("share")
    return framed.join(labels, list(KEYS))


def unlabelled_windows(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """Frames of windows up to the last frame, made without a look at labels."""
    return frames_in_windows(frames.drop("label"), size, stride, cover_tail=True).withColumn("label", F.lit(None).cast("string"))


def padded(values: Column, size: int) -> Column:
    """An array repeated at its last element up to ``size``."""
    return F.concat(values, F.array_repeat(F.element_at(values, -1), F.greatest(F.lit(size) - F.size(values), F.lit(0))))


def tensor_windows(framed: DataFrame, column: str) -> DataFrame:
    """``(subject_id, start_pos, values)``: a column's values of each window in order of position."""
    rows = framed.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(column).alias("v")))).alias("rows"))
    return rows.select(*KEYS, F.transform("rows", lambda r: r["v"]).alias("values"))


def non_overlapping(windows: DataFrame, stride: int) -> DataFrame:
    """The windows that start at a multiple of ``stride``."""
    return windows.where(F.pmod("start_pos", F.lit(stride)) == 0)


def subsampled(windows: DataFrame, stride: int, n_frames: Column, cover_tail: bool = True) -> DataFrame:
    """The windows at a coarser stride, and with ``cover_tail`` the one that ends each subject."""
    keep = F.pmod("start_pos", F.lit(stride)) == 0
    if cover_tail:
        longest = F.max(F.col("end_pos") - F.col("start_pos")).over(Window.partitionBy("subject_id"))
        tail = F.greatest(F.lit(0).cast("long"), n_frames - longest)
        windows = windows.withColumn("__keep", keep | (F.col("start_pos") == tail))
        return windows.where("__keep").drop("__keep")
    return windows.where(keep)


def label_afterwards(windows: DataFrame, frames: DataFrame, classes: Sequence[str], threshold: float = 0.70) -> DataFrame:
    """Windows that were made without labels, with those of their frames; windows without a label go."""
    own = windows.select("subject_id", "start_pos", F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("pos"))
    labels = majority_labels(own.join(frames.select("subject_id", "pos", "label"), ["subject_id", "pos"]), classes, threshold)
    return windows.drop("label").join(labels.where("label is not null").drop("share"), list(KEYS))


def window_grid(frames: DataFrame, sizes: Sequence[int], strides: Sequence[int]) -> DataFrame:
    """Windows of every size and stride, with both as columns."""
    each = [window_table(frames, w, s, True).withColumns({"window_size": F.lit(w), "stride": F.lit(s)}) for w in sizes for s in strides]
    return concatenated(each)


def concatenated(tables: Sequence[DataFrame]) -> DataFrame:
    """One table of all rows; tables must have the same columns."""
    first = tables[0]
    for t in tables[1:]:
        if missing_columns(t, first.columns) or missing_columns(first, t.columns):
            raise ValueError("the tables have different columns")
    return reduce(DataFrame.unionByName, tables)
