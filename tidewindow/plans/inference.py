"""From poses to labelled frames: the steps of training and of prediction put together."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.operators import decode, features, frames, fusion, learning, metrics, signals, tensors, windows
from tidewindow.schema import CLASSES, COORDS, MAJORITY, TEST_STRIDE, TRAIN_STRIDE, WINDOW
from tidewindow.sources import cache


def signal_frames(poses: DataFrame, signal_set: str = "A") -> tuple[DataFrame, list[str]]:
    """Poses cleaned, normalised and turned into signals; the names of these."""
    return signals.signal_set(signals.normalised_for(frames.prepare(poses), signal_set), signal_set)


def window_features(framed: DataFrame, names: Sequence[str], chosen: Sequence[str] = features.SUMMARIES) -> tuple[DataFrame, list[str]]:
    """``subject_id, start_pos, end_pos, label`` and the features of each window as columns, with their names."""
    wide = features.summary_columns(features.window_summaries(framed, names, chosen), names, chosen)
    meta = framed.groupBy(*windows.KEYS).agg({"pos": "max", "label": "max"}).selectExpr(*windows.KEYS, "`max(pos)` + 1 AS end_pos", "`max(label)` AS label")
    return meta.join(wide, list(windows.KEYS)), [f"{s}__{n}" for n in chosen for s in names]


def experiment_windows(
    poses: DataFrame, signal_set: str = "A", size: int = WINDOW, stride: int = TRAIN_STRIDE, threshold: float = MAJORITY, classes: Sequence[str] = CLASSES
) -> tuple[DataFrame, list[str]]:
    """The signals of set A, B or C in the windows that a class has the majority of, with that label; and the signals' names."""
    own, names = signal_frames(poses, signal_set)
    return windows.labelled_windows(own, classes, size, stride, threshold), names


def compact_windows(poses: DataFrame, size: int, stride: int, threshold: float = MAJORITY, labelled: bool = False, classes: Sequence[str] = CLASSES) -> tuple[DataFrame, list[str]]:
    """The 122 compact signals in windows, and their names. A window is never padded; with ``labelled`` only windows with a label, else the tail is covered."""
    own, names = signals.compact_signals(frames.normalise_pose(frames.prepare(poses)))
    return windows.labelled_windows(own, classes, size, stride, threshold) if labelled else windows.unlabelled_windows(own, size, stride), names


def stream_windows(poses: DataFrame, size: int, stride: int, threshold: float = MAJORITY, labelled: bool = False, classes: Sequence[str] = CLASSES) -> DataFrame:
    """``subject_id, start_pos, coordinates, bones, velocity``, the last three as arrays of frames, with ``label`` where ``labelled``; windows as in :func:`compact_windows`."""
    clean = frames.normalise_pose(frames.prepare(poses))
    own = signals.streams(clean)
    if labelled:
        own = own.join(clean.select("subject_id", "pos", "label"), ["subject_id", "pos"])
    framed = windows.labelled_windows(own, classes, size, stride, threshold) if labelled else windows.unlabelled_windows(own, size, stride)
    kinds = ("coordinates", "bones", "velocity")
    rows = framed.groupBy(*windows.KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", *kinds))).alias("rows"), F.first("label").alias("label"))  # a window's frames, size of them
    return rows.select(*windows.KEYS, *(["label"] if labelled else []), *(F.col(f"rows.{k}").alias(k) for k in kinds))


def tensor_windows(poses: DataFrame, size: int, stride: int, threshold: float = MAJORITY, labelled: bool = False, classes: Sequence[str] = CLASSES) -> DataFrame:
    """As :func:`stream_windows`, but only coordinates are put into windows; bones and velocities are worked out of those, many windows at once. A window's first velocity is 0."""
    clean = frames.normalise_pose(frames.prepare(poses)).withColumn("coordinates", F.array(*COORDS))
    own = clean.select("subject_id", "pos", "coordinates", *(["label"] if labelled else []))
    framed = windows.labelled_windows(own, classes, size, stride, threshold) if labelled else windows.unlabelled_windows(own, size, stride)
    rows = framed.groupBy(*windows.KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", "coordinates"))).alias("rows"), F.first("label").alias("label"))  # a window's frames
    return tensors.with_streams(rows.select(*windows.KEYS, *(["label"] if labelled else []), F.col("rows.coordinates").alias("coordinates")))


#: Strides of stream windows: between windows with labels, and between those to be predicted.
STREAM_STRIDES = {True: 75, False: 30}


def stream_cache(spark: SparkSession, folder: str, sources: Mapping, poses: Callable[[], DataFrame], labelled: bool, size: int = WINDOW, threshold: float = MAJORITY, classes: Sequence[str] = CLASSES) -> tuple[DataFrame, bool]:
    """Streams of windows as floats, a folder a subject, for training (with labels, by their threshold) or for prediction (a table with labels is an error); and whether they were there."""
    key = cache.signature(sources, "streams", {"size": size, "stride": STREAM_STRIDES[labelled], "labelled": labelled, "threshold": threshold if labelled else None, "classes": list(classes) if labelled else None})

    def make() -> DataFrame:
        rows = tensor_windows(poses(), size, STREAM_STRIDES[labelled], threshold, labelled, classes)
        rows = rows if labelled else rows.withColumn("label", F.lit(None).cast("string"))
        return rows.withColumns({c: F.col(c).cast("array<array<float>>") for c in ("coordinates", "bones", "velocity")})

    rows, there = cache.cached(spark, folder, key, make, ("subject_id",))
    return (rows if labelled else cache.label_free(rows)), there


def training_windows(
    poses: DataFrame, signal_set: str = "A", size: int = WINDOW, stride: int = TRAIN_STRIDE, threshold: float = MAJORITY, classes: Sequence[str] = CLASSES, chosen: Sequence[str] = features.SUMMARIES
) -> tuple[DataFrame, list[str]]:
    """Features of the windows that a class has the majority of."""
    framed, names = experiment_windows(poses, signal_set, size, stride, threshold, classes)
    return window_features(framed, names, chosen)


def label_free_cache(spark: SparkSession, folder: str, sources: Mapping, poses: Callable[[], DataFrame], signal_set: str = "C", size: int = WINDOW, stride: int = TRAIN_STRIDE) -> tuple[DataFrame, bool]:
    """Features of windows made without a look at labels, as a table of their sources' signature; and whether it was there. A table with labels is an error."""
    key = cache.signature(sources, f"windows-{signal_set}", {"size": size, "stride": stride, "labelled": False})

    def make() -> DataFrame:
        own, names = signal_frames(poses(), signal_set)
        return window_features(windows.unlabelled_windows(own, size, stride), names)[0]

    rows, there = cache.cached(spark, folder, key, make, ("subject_id",))
    return cache.label_free(rows), there


def multiscale_cache(spark: SparkSession, folder: str, sources: Mapping, poses: Callable[[], DataFrame], sizes: Sequence[int] = (60, 150, 300), stride: int = 15) -> tuple[DataFrame, bool]:
    """The nine numbers of each compact signal in windows of several sizes at a fine stride, as floats in long form, a folder a subject and size; and whether it was there."""
    key = cache.signature(sources, "compact", {"sizes": list(sizes), "stride": stride})

    def make() -> DataFrame:
        own, names = signals.compact_signals(frames.normalise_pose(frames.prepare(poses())))
        at = f"{folder}/signals-{key}"
        own.drop("label").write.mode("overwrite").parquet(at)  # worked out once, put into windows of each size
        own, each = spark.read.parquet(at), []
        for size in sizes:
            out = features.summary_rows(features.window_summaries(windows.unlabelled_windows(own, size, stride), names), names)
            each.append(out.select(*features.GROUP, F.lit(size).alias("window_size"), *(F.col(c).cast("float").alias(c) for c in features.SUMMARIES)))
        return windows.concatenated(each)

    return cache.cached(spark, folder, key, make, ("subject_id", "window_size"))


def evaluated(told: DataFrame, labels: DataFrame | None, classes: Sequence[str], abnormal: Sequence[str]) -> DataFrame | None:
    """Metrics of predicted frames where there are labels of known classes for them, else None; the macro average is over the classes that are found in either."""
    if labels is None:
        return None
    rows = told.join(labels.select("subject_id", "pos", F.col("label").alias("truth")), ["subject_id", "pos"]).withColumnRenamed("label", "pred")
    rows = metrics.valid_truth(rows, classes)
    return None if rows.isEmpty() else metrics.evaluate(metrics.counts(rows), classes, abnormal, present_only=True)


def predict_frames(
    model: PipelineModel | learning.ClassMeans,
    poses: DataFrame,
    transition: np.ndarray,
    initial: np.ndarray,
    signal_set: str = "A",
    size: int = WINDOW,
    stride: int = TEST_STRIDE,
    strength: float = 1.0,
    classes: Sequence[str] = CLASSES,
    chosen: Sequence[str] = features.SUMMARIES,
) -> DataFrame:
    """``subject_id, pos, label, confidence, coverage`` of every frame, with no look at labels."""
    own, names = signal_frames(poses.drop("label"), signal_set)
    rows, used = window_features(windows.unlabelled_windows(own, size, stride), names, chosen)
    told = learning.predict(model, rows, used, classes).select("subject_id", "start_pos", "end_pos", "probs")
    probs = fusion.frame_probabilities(told, own, classes)
    path = decode.decode(probs.select("subject_id", "pos", "probs"), transition, initial, classes, strength)
    return path.join(probs.select("subject_id", "pos", "coverage"), ["subject_id", "pos"])
