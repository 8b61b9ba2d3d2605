"""From probabilities of windows to labels of frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.operators.frames import known_around, without_known


def covered_frames(windows: DataFrame, n_classes: int, normalise: bool = True) -> DataFrame:
    """``(subject_id, pos, probs, coverage)``: the mean over the windows that hold each frame, and their number.

    ``windows`` has ``subject_id, start_pos, end_pos, probs``; a window that is given twice counts once.
    """
    probs = x.normalised(F.col("probs")) if normalise else F.col("probs")
    own = windows.dropDuplicates(["subject_id", "start_pos", "end_pos"]).select(
        "subject_id", F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("pos"), probs.alias("p")
    )
    means = [F.avg(F.col("p")[i]) for i in range(n_classes)]
    return own.groupBy("subject_id", "pos").agg(F.array(*means).alias("probs"), F.count("*").alias("coverage"))


def fill_nearest(frames: DataFrame, column: str = "probs") -> DataFrame:
    """NULLs of a column as the value of the nearest frame that has one, the earlier of two as near."""
    seen, around = known_around(frames, {"n": F.col(column)})
    before, after = around["n"]
    left = after.isNull() | (F.col("pos") - before["p"] <= after["p"] - F.col("pos"))
    return without_known(seen.withColumn(column, F.when(left, F.coalesce(before["v"], after["v"])).otherwise(after["v"])))


def frame_probabilities(windows: DataFrame, frames: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``(subject_id, pos, probs, coverage, label, confidence)`` for every row of ``frames(subject_id, pos)``.

    Frames under no window take the nearest covered frame's probabilities and keep coverage 0.
    """
    covered = covered_frames(windows, len(classes))
    out = frames.select("subject_id", "pos").join(covered, ["subject_id", "pos"], "left")
    out = fill_nearest(out).withColumns({"probs": x.normalised(F.col("probs")), "coverage": F.coalesce("coverage", F.lit(0).cast("long"))})
    return labelled(out, classes)


def plain_frame_means(windows: DataFrame, frames: DataFrame, classes: Sequence[str]) -> DataFrame:
    """As :func:`frame_probabilities` without normalising; a frame under no window is an error."""
    covered = covered_frames(windows, len(classes), normalise=False)
    out = frames.select("subject_id", "pos").join(covered, ["subject_id", "pos"], "left")
    bare = F.raise_error(F.lit("a frame lies under no window")).cast("array<double>")
    return labelled(out.withColumn("probs", F.coalesce("probs", bare)), classes)


def vote_means(windows: DataFrame, frames: DataFrame, classes: Sequence[str]) -> DataFrame:
    """As :func:`plain_frame_means`, with zeros for a frame under no window."""
    covered = covered_frames(windows, len(classes), normalise=False)
    out = frames.select("subject_id", "pos").join(covered, ["subject_id", "pos"], "left")
    zeros = F.array(*(F.lit(0.0) for _ in classes))
    return labelled(out.withColumns({"probs": F.coalesce("probs", zeros), "coverage": F.coalesce("coverage", F.lit(0).cast("long"))}), classes)


def labelled(frames: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Adds ``label``, the class of the largest probability (the first of equals), and that probability as ``confidence``."""
    names = F.array(*map(F.lit, classes))
    return frames.withColumns({"label": F.get(names, x.argmax(F.col("probs"))), "confidence": F.array_max("probs")})


def group_majority(frames: DataFrame, group: str, classes: Sequence[str]) -> DataFrame:
    """``(group, label, frames, confidence)``: the most frequent label of each group (the first class of equals), and the mean confidence of its frames.

    NULL is a group of its own.
    """
    names = F.array(*map(F.lit, classes))
    counts = frames.groupBy(group, "label").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    best = F.max_by(F.struct("label", "n", "confidence"), F.struct("n", -F.array_position(names, F.col("label"))))
    return counts.groupBy(group).agg(best.alias("b"), F.sum("n").alias("frames")).select(group, "b.label", "frames", "b.confidence")
