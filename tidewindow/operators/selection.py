"""Splits without leakage, score tables, ranking and choice of settings."""

from __future__ import annotations

import json
import threading
from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor, as_completed
from hashlib import sha256
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Subjects up to which splits are made: their number grows with its square, and that of their rows with its cube.
MAX_SUBJECTS = 200
#: How a mean score ranks: accuracy, worst accuracy, macro F1, abnormal F1, all descending.
RANKING = ("mean_accuracy", "least_accuracy", "mean_macro_f1", "mean_abnormal_f1")


# -- splits -----------------------------------------------------------------------------------------------------------


def leave_one_out(rows: DataFrame, held_out: int, subject: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """Rows of all other subjects and of the held-out one."""
    return rows.where(F.col(subject) != held_out), rows.where(F.col(subject) == held_out)


def inner_splits(subjects: Sequence[int], outer: int) -> list[tuple[tuple[int, ...], int]]:
    """For an outer subject, each other subject as validation and the rest as training; at least three subjects must stay."""
    inner = sorted(set(subjects) - {outer})
    if outer not in subjects or len(inner) < 3:
        raise ValueError("an outer split needs at least three other subjects")
    return [(tuple(s for s in inner if s != v), v) for v in inner]


def _few(subjects: DataFrame) -> DataFrame:
    """The distinct subjects, or an error if there are too many to combine."""
    s = subjects.select("subject_id").distinct()
    if s.limit(MAX_SUBJECTS + 1).count() > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects: their splits are too many")
    return s


def inner_split_table(subjects: DataFrame) -> DataFrame:
    """``(outer_subject, validation_subject, train_subjects)`` for all outer subjects at once."""
    s = _few(subjects)
    pairs = s.select(F.col("subject_id").alias("outer_subject")).join(
        s.select(F.col("subject_id").alias("validation_subject")), F.col("outer_subject") != F.col("validation_subject")
    )
    rest = pairs.join(s, (F.col("subject_id") != F.col("outer_subject")) & (F.col("subject_id") != F.col("validation_subject")))
    return rest.groupBy("outer_subject", "validation_subject").agg(F.sort_array(F.collect_list("subject_id")).alias("train_subjects"))


def unordered_pairs(subjects: DataFrame) -> DataFrame:
    """``(a, b)`` with a before b."""
    s = _few(subjects)
    return s.select(F.col("subject_id").alias("a")).join(s.select(F.col("subject_id").alias("b")), F.col("a") < F.col("b"))


def parse_subjects(c) -> object:
    """``"2_1"`` -> ``[1, 2]``."""
    return F.array_sort(F.transform(F.split(c, "_"), lambda v: v.cast("int")))


def leaks(audit: DataFrame) -> DataFrame:
    """The rows of ``audit(outer_subject, train_subjects, validation_subject)`` that train or validate on what they must not see."""
    outer, seen = F.col("outer_subject"), F.col("train_subjects")
    return audit.where(F.array_contains(seen, outer) | (F.col("validation_subject") == outer) | F.array_contains(seen, F.col("validation_subject")))


def checked_audit(audit: DataFrame) -> DataFrame:
    """The audit itself, or an error if any row leaks."""
    if found := leaks(audit).limit(1).collect():
        raise ValueError(f"the split of subject {found[0]['outer_subject']} leaks")
    return audit


# -- scores -----------------------------------------------------------------------------------------------------------


def summarise(scores: DataFrame, setting: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Mean and least accuracy, mean macro and abnormal F1 of each setting."""
    return scores.groupBy(*groups, *setting).agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.min("accuracy").alias("least_accuracy"),
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.avg("abnormal_f1").alias("mean_abnormal_f1"),
        F.count("*").alias("n_scores"),
    )


def ranked(summary: DataFrame, setting: Sequence[str], groups: Sequence[str] = (), keys: Sequence[str] = RANKING) -> DataFrame:
    """Adds ``place``, 1 the best; equals are told apart by the setting, ascending."""
    order = Window.partitionBy(*groups).orderBy(*(F.desc(k) for k in keys), *setting)
    return summary.withColumn("place", F.row_number().over(order))


def best(scores: DataFrame, setting: Sequence[str], groups: Sequence[str] = (), k: int = 1) -> DataFrame:
    """The k best settings of each group."""
    if k < 1:
        raise ValueError("k must be positive")
    return ranked(summarise(scores, setting, groups), setting, groups).where(F.col("place") <= k)


def require_complete(scores: DataFrame, setting: Sequence[str], expected: int, groups: Sequence[str] = ()) -> DataFrame:
    """The scores, or an error if a setting has another number of them than ``expected``."""
    odd = scores.groupBy(*groups, *setting).agg(F.count("*").alias("n")).where(F.col("n") != expected).limit(1).collect()
    if odd:
        raise ValueError(f"incomplete scores: {odd[0].asDict()}")
    return scores


def outer_choices(pair_scores: DataFrame, splits: DataFrame, setting: Sequence[str] = ("candidate_index",), groups: Sequence[str] = ()) -> DataFrame:
    """The best setting of each outer subject, from scores of pairs that neither train nor validate on it.

    ``pair_scores`` has ``train_subjects ("1_2"), validation_subject`` and metrics, ``splits`` is :func:`inner_split_table`, at most
    MAX_SUBJECTS squared rows. A setting without exactly one score for each split of each outer subject is an error. ``groups`` are further columns, each of
    whose values gets a choice of its own.
    """
    keyed = pair_scores.withColumn("train_subjects", parse_subjects(F.col("train_subjects")))
    splits = splits.withColumn("train_subjects", F.col("train_subjects").cast("array<int>"))
    summary = summarise(keyed.join(F.broadcast(splits), ["train_subjects", "validation_subject"]), setting, ["outer_subject", *groups])
    sizes = F.broadcast(splits.groupBy("outer_subject").agg(F.count("*").alias("expected")))
    every = pair_scores.select(*groups, *setting).distinct().crossJoin(sizes)  # settings by outer subjects, at most MAX_SUBJECTS
    odd = every.join(summary, ["outer_subject", *groups, *setting], "left").where(F.coalesce("n_scores", F.lit(0)) != F.col("expected"))
    if found := odd.select("outer_subject", *groups, *setting, "n_scores", "expected").limit(1).collect():
        raise ValueError(f"incomplete scores: {found[0].asDict()}")
    return ranked(summary, setting, ["outer_subject", *groups]).where("place = 1")


def remaining(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The settings of a grid that have no score yet."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resumed_search(spark: SparkSession, folder: str, grid: DataFrame, keys: Sequence[str], score: Callable[[Mapping], Mapping[str, float]], workers: int = 1) -> tuple[DataFrame, int]:
    """The scores of all settings of a small grid, kept as Parquet in ``folder``, and how many of them had to be worked out now.

    Settings that have a score are not worked out again. Each new one is committed by itself as soon as it is there, in a folder named by its keys, so that a search that was broken
    off goes on with the rest. Up to ``workers`` settings are worked out at once, each thread's jobs in a scheduler pool of its own; after an error no more are begun, and those under way are kept.
    """
    first = next(iter(grid.limit(1).collect()), None)
    if first is None:
        raise ValueError("the grid is empty")
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

    def done() -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").parquet(folder)

    todo = remaining(grid, done(), keys) if there else grid
    settings = [r.asDict() for r in todo.orderBy(*keys).collect()]

    def work(s: Mapping) -> None:
        row = {**{k: s[k] for k in keys}, **{k: float(v) for k, v in score(s).items()}}
        schema = ", ".join(f"{k} {kinds.get(k, 'double')}" for k in row)
        name = sha256(json.dumps([str(s[k]) for k in keys]).encode()).hexdigest()
        spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")

    if workers == 1:
        for s in settings:
            work(s)
        return done(), len(settings)

    def pooled(s: Mapping) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", threading.current_thread().name)
        work(s)

    with ThreadPoolExecutor(workers, thread_name_prefix="search") as pool:
        under_way = [pool.submit(pooled, s) for s in settings]
        failed = next((f for f in as_completed(under_way) if f.exception()), None)
        if failed:
            pool.shutdown(wait=True, cancel_futures=True)
            raise failed.exception()
    return done(), len(settings)


class Once:
    """Values by key, each worked out by the first thread that asks for it while others wait; the last ``most`` that were asked for are kept."""

    def __init__(self, most: int) -> None:
        self._most, self._lock, self._found = most, threading.Lock(), OrderedDict()

    def get(self, key: tuple, make: Callable[[], object]) -> object:
        with self._lock:
            own = key not in self._found
            future = self._found.setdefault(key, Future())
            self._found.move_to_end(key)
            while len(self._found) > self._most:
                self._found.popitem(last=False)
        if own:
            try:
                future.set_result(make())
            except BaseException as e:
                with self._lock:
                    self._found.pop(key, None)
                future.set_exception(e)
        return future.result()


def parameter_grid(spark: SparkSession, values: Mapping[str, Sequence], sample: int | None = None, seed: int = 42) -> DataFrame:
    """``(candidate_index, names...)`` of all combinations, or of ``sample`` of them in the order of a seeded hash."""
    rows = [(i, *c) for i, c in enumerate(product(*values.values()))]
    grid = spark.createDataFrame(rows, ["candidate_index", *values])
    if sample is None:
        return grid
    key = F.xxhash64(F.lit(seed), "candidate_index")
    chosen = grid.orderBy(key, "candidate_index").limit(sample)
    return chosen.withColumn("candidate_index", F.row_number().over(Window.orderBy("candidate_index")) - 1)


def median_setting(chosen: DataFrame, column: str) -> DataFrame:
    """The rounded median of a setting, 1 at least; halves go to the even number."""
    return chosen.agg(F.greatest(F.bround(F.median(column)).cast("long"), F.lit(1).cast("long")).alias(column))


# -- comparison of experiments ----------------------------------------------------------------------------------------


def best_experiment(comparison: DataFrame) -> DataFrame:
    """The row with the best abnormal F1, then worst accuracy, then macro F1, then first name."""
    return comparison.orderBy(F.desc("pooled_abnormal_f1"), F.desc("worst_subject_accuracy"), F.desc("pooled_macro_f1"), "experiment").limit(1)


def eligible_candidates(candidates: DataFrame, baseline: str, f1_slack: float = 0.005, subject_slack: float = 0.05) -> DataFrame:
    """Candidates with the ``reasons`` why they can't win against the one that ``baseline`` names, and their ``place`` among those that can.

    ``candidates`` has ``name, accuracy, worst_accuracy, macro_f1, abnormal_f1, subjects map<int,double>``. A candidate may lose at
    most ``f1_slack`` of the abnormal F1, nothing of the worst accuracy and at most ``subject_slack`` of any subject's, and
    needs the same subjects. The table needs exactly one baseline.
    """
    base = candidates.where(F.col("name") == baseline)
    if base.count() != 1:
        raise ValueError("exactly one baseline is needed")
    b = base.select(*(F.col(c).alias(f"b_{c}") for c in candidates.columns))
    rows = candidates.crossJoin(F.broadcast(b))  # one row
    same = F.array_sort(F.map_keys("subjects")) == F.array_sort(F.map_keys("b_subjects"))
    lost = F.filter(F.map_entries("b_subjects"), lambda e: F.element_at("subjects", e["key"]) < e["value"] - subject_slack)
    reasons = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("abnormal_f1") < F.col("b_abnormal_f1") - f1_slack, "abnormal F1"),
                F.when(F.col("worst_accuracy") < F.col("b_worst_accuracy"), "worst subject"),
                F.when(~same, "other subjects"),
            )
        ),
        F.when(same, F.transform(lost, lambda e: F.concat(F.lit("subject "), e["key"].cast("string")))).otherwise(F.expr("cast(array() as array<string>)")),
    )
    own = F.col("name") == baseline
    rows = rows.withColumn("reasons", F.when(own, F.expr("cast(array() as array<string>)")).otherwise(reasons)).select(*candidates.columns, "reasons")
    rows = rows.withColumn("eligible", F.size("reasons") == 0)
    order = Window.partitionBy("eligible").orderBy(*(F.desc(c) for c in ("accuracy", "worst_accuracy", "macro_f1", "abnormal_f1")), "name")
    return rows.withColumn("place", F.when(F.col("eligible"), F.row_number().over(order)))


def deltas(tables: Mapping[str, DataFrame], key: str, metrics: Sequence[str], base: str) -> DataFrame:
    """Metrics of several experiments side by side by ``key``, and their differences from ``base``."""
    out = None
    for name, t in tables.items():
        t = t.select(key, *(F.col(m).alias(f"{m}_{name}") for m in metrics))
        out = t if out is None else out.join(t, key)
    each = [(F.col(f"{m}_{n}") - F.col(f"{m}_{base}")).alias(f"delta_{m}_{n}") for n in tables if n != base for m in metrics]
    return out.select("*", *each)


def tables_differ(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have other rows, counting repeats."""
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
