"""Mutual information of a label and numbers by nearest neighbours.

For each value: the distance to its k-th neighbour of the same label, and how many values of any label are nearer than that (itself included, and its equals). The more there are, the less
the value says about the label. Neighbours are found among rows around a row in its label's order, counts by merging the ends of each value's range into the order of all values; no task holds the values of a feature or a label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.operators import scans


def digamma(n: Column) -> Column:
    """Of positive numbers: the asymptotic series ten steps on, less the steps."""
    far = n + 10.0
    series = F.log(far) - 1 / (2 * far) - 1 / (12 * far * far) + 1 / (120 * F.pow(far, F.lit(4.0))) - 1 / (252 * F.pow(far, F.lit(6.0)))
    steps = F.lit(0.0)
    for i in range(10):
        steps = steps + 1 / (n + float(i))
    return series - steps


def _reach(k: int) -> dict[str, Column]:
    """``low`` and ``high``, the ends of the range of values that are nearer than the k-th neighbour in order; k is smaller where the label has fewer rows.

    The neighbour's own value is an end, exactly; the other end is as far away. A distance of 0 gives two equal ends.
    """
    window = Window.partitionBy("feature", "label", "block").orderBy("rank")
    sides = {sign: [(F.lag if sign < 0 else F.lead)("value", j).over(window) for j in range(1, k + 1)] for sign in (-1, 1)}
    gaps = [(v - F.col("value")) * sign for sign, own in sides.items() for v in own]
    gap = F.get(F.array_sort(F.array_compact(F.array(*gaps))), F.least(F.lit(k), F.col("n_label").cast("int") - 1) - 1)

    def end(sign: int) -> Column:
        exact = F.coalesce(*(F.when((v - F.col("value")) * sign == gap, v) for v in sides[sign]))
        return F.coalesce(exact, F.col("value") + gap * sign)

    return {"gap": gap, "low": end(-1), "high": end(1)}


def neighbour_information(rows: DataFrame, features: Sequence[str], label: str = "label", k: int = 3, block: int = scans.BLOCK) -> DataFrame:
    """``(feature, information)`` in nats, not below 0.

    Rows whose label is null or occurs once are left out, missing and non-finite values count as 0 (fill them first). A feature without rows, or rows of one label, have information 0 or none.
    Values are taken as they are: no noise tells equal ones apart.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), (F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) + 0.0).alias("value")) for c in features)))
    sizes = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_label")).where("n_label > 1 AND label IS NOT NULL")
    long = rows.select(F.col(label).alias("label"), pairs.alias("p")).select("label", "p.*").join(F.broadcast(sizes), "label")  # a row a label
    own = scans.in_blocks(scans.ranked(long, ["feature", "label"], ["value"]), "rank", k, k, block)
    near = own.withColumns(_reach(k)).where("not copied").select("feature", "value", "n_label", "gap", "low", "high")
    # a range without length holds the equals of its value: from before them to behind them
    tie = F.col("gap") == 0
    ends = F.array(
        F.struct(F.col("value").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("sign")),
        F.struct(F.col("low").alias("at"), F.when(tie, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")),
        F.struct(F.col("high").alias("at"), F.when(tie, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
    )
    near = near.withColumn("id", F.monotonically_increasing_id())
    path = scans.new_folder(rows.sparkSession, "near")
    near.write.parquet(path)
    near = rows.sparkSession.read.schema(near.schema).parquet(path)
    merged = scans.in_ranges(near.select("feature", "id", F.explode(ends).alias("e")).select("feature", "id", "e.*"), ["feature"], ["at", "kind"])
    upto = scans.counted_before(merged, ["feature"], F.col("kind") == 1)
    inside = upto.where("sign <> 0").groupBy("feature", "id").agg(F.sum(F.col("before") * F.col("sign")).alias("m"))
    told = near.join(inside, ["feature", "id"]).groupBy("feature").agg(
        F.count("*").alias("n"),
        F.avg(digamma(F.least(F.lit(k), F.col("n_label") - 1).cast("double"))).alias("k"),
        F.avg(digamma(F.col("n_label").cast("double"))).alias("own"),
        F.avg(digamma(F.col("m").cast("double"))).alias("all"),
    )
    return told.select("feature", F.greatest(digamma(F.col("n").cast("double")) + F.col("k") - F.col("own") - F.col("all"), F.lit(0.0)).alias("information"))
