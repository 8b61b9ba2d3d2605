"""Evaluation of labels over a fixed list of classes.

All of it starts from a table of counts ``(groups..., truth, pred, n)``, of which there are at most classes squared rows a group,
so that the rows themselves are read and shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.operators.decode import class_dimension


def valid_truth(rows: DataFrame, classes: Sequence[str], truth: str = "truth") -> DataFrame:
    """The rows whose truth is a class; to be called after prediction."""
    return rows.where(F.col(truth).isin(*classes))


def counts(rows: DataFrame, groups: Sequence[str] = (), truth: str = "truth", pred: str = "pred") -> DataFrame:
    """``(groups..., truth, pred, n)``."""
    return rows.groupBy(*groups, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(table: DataFrame, classes: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """``(groups..., class_idx, class, precision, recall, f1, support, predicted)`` for every class, 0 where nothing can be divided by."""
    names = class_dimension(table.sparkSession, classes)
    sides = table.select(*groups, F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))).alias("s"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"))
    own = sides.select(*groups, "s.class", "s.support", "s.predicted", F.when(F.col("s.support") > 0, F.col("hit")).otherwise(0).alias("hit"))
    own = own.groupBy(*groups, "class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    every = table.select(*groups).distinct().crossJoin(F.broadcast(names)) if groups else names  # a row for each group and class
    out = every.join(own, [*groups, "class"], "left").na.fill(0, ["support", "predicted", "hit"])
    precision, recall = _ratio(F.col("hit"), F.col("predicted")), _ratio(F.col("hit"), F.col("support"))
    f1 = _ratio(2.0 * F.col("hit"), F.col("support") + F.col("predicted"))
    return out.select(*groups, "class_idx", "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "predicted")


def evaluate(table: DataFrame, classes: Sequence[str], abnormal: Sequence[str], groups: Sequence[str] = (), present_only: bool = False) -> DataFrame:
    """``accuracy, macro_f1, abnormal_precision, abnormal_recall, abnormal_f1`` by group.

    The macro average is over all classes, or with ``present_only`` over those found in truth or prediction.
    """
    n = F.col("n")
    bad_truth, bad_pred = F.col("truth").isin(*abnormal), F.coalesce(F.col("pred").isin(*abnormal), F.lit(False))
    sums = table.groupBy(*groups).agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(F.col("truth") == F.col("pred"), n).otherwise(0)).alias("hits"),
        F.sum(F.when(bad_truth & bad_pred, n).otherwise(0)).alias("tp"),
        F.sum(F.when(bad_truth, n).otherwise(0)).alias("actual"),
        F.sum(F.when(bad_pred, n).otherwise(0)).alias("said"),
    )
    f1 = F.when((F.col("support") > 0) | (F.col("predicted") > 0), F.col("f1")) if present_only else F.col("f1")
    macro = per_class(table, classes, groups).groupBy(*groups).agg(F.avg(f1).alias("macro_f1"))
    out = sums.join(macro, list(groups)) if groups else sums.crossJoin(macro)  # one row with one row
    return out.select(
        *groups,
        (F.col("hits") / F.col("rows")).alias("accuracy"),
        "macro_f1",
        _ratio(F.col("tp"), F.col("said")).alias("abnormal_precision"),
        _ratio(F.col("tp"), F.col("actual")).alias("abnormal_recall"),
        _ratio(2.0 * F.col("tp"), F.col("said") + F.col("actual")).alias("abnormal_f1"),
    )


def confusion(table: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``(class_idx, truth, class columns...)`` in class order, filled with zeros."""
    names = class_dimension(table.sparkSession, classes).withColumnRenamed("class", "truth")
    wide = table.groupBy("truth").agg(*(F.sum(F.when(F.col("pred") == c, F.col("n"))).alias(c) for c in classes))
    return names.join(wide, "truth", "left").na.fill(0, list(classes)).select("class_idx", "truth", *(F.col(f"`{c}`").cast("long") for c in classes))


def confusion_rates(table: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``(truth, pred, frames, rate)`` for every pair of classes; a rate is a share of the truth's rows, 0 where it has none."""
    names = class_dimension(table.sparkSession, classes)
    pairs = names.select(F.col("class").alias("truth")).crossJoin(names.select(F.col("class").alias("pred")))  # classes by classes
    cells = pairs.join(table.select("truth", "pred", "n"), ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return cells.select("truth", "pred", F.col("n").alias("frames"), _ratio(F.col("n"), F.sum("n").over(Window.partitionBy("truth"))).alias("rate"))


def top_confusions(table: DataFrame, classes: Sequence[str], k: int | None = None, by_rate: bool = True) -> DataFrame:
    """The off-diagonal pairs, largest rate and then most frames first; with ``by_rate`` off most frames first, without empty pairs."""
    cells = confusion_rates(table, classes).where("truth <> pred")
    if not by_rate:
        cells = cells.where("frames > 0")
    first = ["rate", "frames"] if by_rate else ["frames", "rate"]
    out = cells.orderBy(*(F.desc(c) for c in first), "truth", "pred")
    return out.limit(k) if k else out


def report(table: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``(name, precision, recall, f1, support)``: a row for each class, then accuracy, macro and weighted averages."""
    rows = per_class(table, classes)
    total = F.sum("support")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), total)
    macro = rows.agg(F.lit("macro avg").alias("name"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), total.alias("support"))
    mean = rows.agg(F.lit("weighted avg").alias("name"), *(weighted(c).alias(c) for c in ("precision", "recall", "f1")), total.alias("support"))
    hits = table.agg((F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("a"), F.sum("n").alias("support"))
    accuracy = hits.select(F.lit("accuracy").alias("name"), *(F.col("a").alias(c) for c in ("precision", "recall", "f1")), "support")
    each = rows.select(F.col("class").alias("name"), "precision", "recall", "f1", "support")
    return each.unionByName(accuracy).unionByName(macro).unionByName(mean)


def class_counts(rows: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """``(class_idx, class, n)`` for every class."""
    n = rows.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    return class_dimension(rows.sparkSession, classes).join(n, "class", "left").select("class_idx", "class", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def class_weights(table: DataFrame) -> DataFrame:
    """Of class counts: ``balanced`` and its root over the classes present, ``mean_scaled`` and ``root_all`` over all classes."""
    every = Window.partitionBy()  # as many rows as classes
    n, total = F.col("n"), F.sum("n").over(every)
    present, k = F.sum((F.col("n") > 0).cast("int")).over(every), F.count("*").over(every)
    balanced = F.when(n > 0, total / (present * n))
    inverse = total / F.greatest(n, F.lit(1))
    return table.select(
        "class_idx",
        "class",
        "n",
        balanced.alias("balanced"),
        F.sqrt(balanced).alias("root_balanced"),
        (inverse / F.avg(inverse).over(every)).alias("mean_scaled"),
        F.sqrt(total / (k * F.greatest(n, F.lit(1)))).alias("root_all"),
    )


def fold_summary(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``(metric, mean, std, least, worst_subject)`` over ``folds(held_out_subject, metrics...)``; of equally bad subjects the smallest."""
    rows = folds.select("held_out_subject", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))).alias("s"))
    rows = rows.select("held_out_subject", "s.metric", "s.v")
    return rows.groupBy("metric").agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        F.min("v").alias("least"),
        F.min_by("held_out_subject", F.struct("v", "held_out_subject")).alias("worst_subject"),
    )


def pooled_and_folds(rows: DataFrame, classes: Sequence[str], abnormal: Sequence[str], fold: str = "held_out_subject") -> DataFrame:
    """Metrics of each fold and, with a NULL fold, of all rows together."""
    table = counts(rows, [fold])
    each = evaluate(table, classes, abnormal, [fold])
    pooled = evaluate(table.groupBy("truth", "pred").agg(F.sum("n").alias("n")), classes, abnormal)
    return each.unionByName(pooled.withColumn(fold, F.lit(None).cast(rows.schema[fold].dataType)))


def channel_stats(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(channel, mean, std)`` over all rows; a std of at most 1e-5 is 1."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")
    out = rows.select(pairs).groupBy("s.channel").agg(F.avg("s.v").alias("mean"), F.stddev_pop("s.v").alias("std"))
    return out.withColumn("std", F.when(F.col("std") <= 1e-5, 1.0).otherwise(F.col("std")))
