"""Orders over groups of any size: ranks, running counts and exact medians without a task that holds a group.

Rows are dealt out by ranges of their order and written once. A group's order then lies in the order of the ranges, and what comes before a row is what lies before it in its range and the sums of the
ranges before. Only these sums, a row for each range and group that meet, are put in order by group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.storage import new_folder

#: Rows of a group that meet in one task where neighbours are compared.
BLOCK = 50_000


def in_ranges(rows: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` as a written table with ``_part`` and ``_at``: the range a row fell into, and its place in it. Equal rows are spread by their place in the input."""
    keys = [*groups, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = dealt.withColumn("_row", F.monotonically_increasing_id())
    path = new_folder(rows.sparkSession, "ranges")
    dealt.write.parquet(path)
    placed = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    return placed.withColumns({"_part": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_row")


def counted_before(placed: DataFrame, groups: Sequence[str], counted: Column, name: str = "before") -> DataFrame:
    """Rows of :func:`in_ranges` with how many rows of their group that fulfil ``counted`` come before them."""
    one = F.when(counted, 1).otherwise(0)
    inside = Window.partitionBy(*groups, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy(*groups, "_part").agg(F.sum(one).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = placed.withColumn("_own", F.sum(one).over(inside) - one).join(sums, same)
    return out.withColumn(name, F.col("_own") + F.col("_earlier")).drop("_own", "_earlier", "_p", *(f"_g{i}" for i in range(len(groups))))


def ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``rows`` with their place in their group from 0 on."""
    return counted_before(in_ranges(rows, groups, order), groups, F.lit(True), name).drop("_part", "_at")


def in_blocks(rows: DataFrame, rank: str, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """``rows`` with ``block``, their rank by so many, and ``copied`` where they also stand in the next or the last block, as one of the rows right before or after it."""
    at, own = F.pmod(F.col(rank), F.lit(size)), F.floor(F.col(rank) / size)
    places = F.array_compact(
        F.array(
            F.struct(own.alias("block"), F.lit(False).alias("copied")),
            F.when(at >= size - before, F.struct((own + 1).alias("block"), F.lit(True).alias("copied"))),
            F.when((at < after) & (own > 0), F.struct((own - 1).alias("block"), F.lit(True).alias("copied"))),
        )
    )
    return rows.select("*", F.explode(places).alias("_b")).select("*", "_b.*").drop("_b")


# -- exact medians --------------------------------------------------------------------------------------------------------

_DIGIT = 16


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    """The double of such a number."""
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _between(a: float, b: float) -> float:
    """The mean, which two large values don't overflow and two very small equal ones don't lose."""
    return a if a == b else 0.5 * a + 0.5 * b


def medians(rows: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each feature over its finite values, the mean of the two middle ones of an even number; None where there is none.

    Four passes over all features at once find the middle values sixteen binary digits at a time: counts by the next digits, of the values that begin like the middle one. Tasks
    add up their counts, and of each feature only the digits that hold the middle reach the driver.
    """
    n = len(features)
    values = rows.select(F.array(*(F.coalesce(x.finite(F.col(f"`{c}`").cast("double")), F.lit(float("nan"))) for c in features)).alias("x"))
    total = rows.agg(*(F.count(x.finite(F.col(f"`{c}`").cast("double"))).alias(f"n{i}") for i, c in enumerate(features))).first()
    #: (feature, prefix) -> places among the values of that prefix, by the places looked for
    wanted = {(i, which): ((total[f"n{i}"] - 1 + which) // 2, 0) for i in range(n) if total[f"n{i}"] for which in (0, 1)}
    for step in range(64 // _DIGIT):
        if not wanted:
            break
        slots = sorted({(i, prefix) for (i, _), (_, prefix) in wanted.items()})

        def counts(batches: Iterator[pa.RecordBatch], slots: list = slots, step: int = step) -> Iterator[pa.RecordBatch]:
            shift, sums = 64 - _DIGIT * (step + 1), {}
            for b in batches:
                own = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n)
                for s, (i, prefix) in enumerate(slots):
                    keys = _ordered(own[:, i][~np.isnan(own[:, i])])
                    if step:
                        keys = keys[(keys >> np.uint64(shift + _DIGIT)) == np.uint64(prefix)]
                    digits, m = np.unique((keys >> np.uint64(shift)) & np.uint64((1 << _DIGIT) - 1), return_counts=True)
                    for d, c in zip(digits.tolist(), m.tolist(), strict=True):
                        sums[s, d] = sums.get((s, d), 0) + c
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in sums], pa.int32()), pa.array([d for _, d in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["slot", "digit", "n"]
            )

        summed = values.mapInArrow(counts, "slot int, digit int, n long").groupBy("slot", "digit").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("slot").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 2^16 rows a slot at most
        targets = [(slots.index((i, prefix)), i, which, place) for (i, which), (place, prefix) in wanted.items()]
        looked = F.broadcast(rows.sparkSession.createDataFrame(targets, "slot int, feature int, which int, place long"))  # two rows a feature
        found = summed.withColumn("upto", F.sum("n").over(upto)).join(looked, "slot").where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        for r in found.collect():
            place, prefix = wanted[r["feature"], r["which"]]
            wanted[r["feature"], r["which"]] = place - (r["upto"] - r["n"]), prefix << _DIGIT | r["digit"]
    middle = {k: _value(prefix) for k, (_, prefix) in wanted.items()}
    return {c: _between(middle[i, 0], middle[i, 1]) if (i, 0) in middle else None for i, c in enumerate(features)}
