"""Structured Streaming forms: row-count windows with keyed state, and event-time summaries with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "subject_id long, start_pos long, end_pos long, n long, mean double, least double, greatest double"
_STATE = "seen long, coming long, pos array<long>, x array<double>"


def row_count_windows(frames: DataFrame, size: int, stride: int) -> DataFrame:
    """Complete windows of a stream of ``(subject_id long, pos long, x double)``, each once its last frame has come.

    A subject's state is the next window's start and the frames from there on, at most ``size`` plus one batch; frames of a subject must come in
    order of batches. Positions that were seen before are dropped.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, coming, pos, x = state.get if state.exists else (-1, 0, [], [])
        for rows in batches:
            rows = rows[rows["pos"] > seen]
            pos, x = [*pos, *rows["pos"]], [*x, *rows["x"]]
        places, first = np.unique(np.array(pos, dtype=np.int64), return_index=True)
        values = np.array(x, dtype=float)[first]
        out, at = [], 0
        if len(places):
            seen = max(seen, int(places[-1]))
        while at < len(places):
            start = max(coming, -((size - 1 - int(places[at])) // stride) * stride)
            if seen < start + size - 1:
                break
            low, high = np.searchsorted(places, (start, start + size))
            own = values[low:high].tolist()
            if own:
                out.append((key[0], start, start + size, len(own), sum(own) / len(own), min(own), max(own)))
            coming = start + stride
            at = int(np.searchsorted(places, coming))
        state.update((seen, coming, places[at:].tolist(), values[at:].tolist()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return frames.groupBy("subject_id").applyInPandasWithState(advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def timed_summary(events: DataFrame, time: str, value: str, key: str, window: str, slide: str, late: str) -> DataFrame:
    """Counts and means of a value by key and sliding event-time window, for events at most ``late`` late."""
    own = events.withWatermark(time, late).groupBy(F.window(time, window, slide), key)
    return own.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "mean")


#: Positions of a subject that one batch of a replayed table brings at most.
SLICE = 65_536


def replayed(frames: DataFrame, size: int, stride: int, folder: str, positions: int = SLICE) -> DataFrame:
    """Windows of a table by way of a stream. Slices of so many positions come one after the other to a folder that is streamed each time up to its end, so that a batch has no more of a subject."""
    spark = frames.sparkSession
    frames.withColumn("slice", F.floor(F.col("pos") / positions)).write.partitionBy("slice").parquet(f"{folder}/all")
    every = spark.read.parquet(f"{folder}/all")
    for row in every.select("slice").distinct().orderBy("slice").collect():  # a row for so many positions of the longest subject
        every.where(F.col("slice") == row["slice"]).select(*frames.columns).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(frames.schema).parquet(f"{folder}/in")
        out = row_count_windows(stream, size, stride).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{folder}/out")
