"""Nested selection: settings chosen by pairs of subjects, then judged on subjects that took no part in the choice."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.functions import expressions as x
from tidewindow.operators import fusion, learning, metrics, selection

KEYS = ("train_subjects", "candidate_index", "validation_subject")


def pair_grid(spark: SparkSession, subjects: Sequence[int], n_candidates: int) -> DataFrame:
    """Every pair of training subjects with every candidate and every other subject as validation: a small table."""
    rows = [(f"{a}_{b}", c, v) for a, b in combinations(sorted(set(subjects)), 2) for c in range(n_candidates) for v in sorted(set(subjects) - {a, b})]
    return spark.createDataFrame(rows, "train_subjects string, candidate_index int, validation_subject int")


def fit_candidate(rows: DataFrame, features: Sequence[str], classes: Sequence[str], candidate: Mapping, selector: learning.Selector | None = None) -> tuple[PipelineModel, list[str]]:
    """A model of the candidate's settings on the features that its training rows select; ``budget`` bounds their number. A ``selector`` that was fitted before is restricted to the budget."""
    settings = dict(candidate)
    budget = settings.pop("budget", None)
    selector = selector or learning.fit_selector(rows, features)
    chosen = selector.restricted(min(budget, len(selector.ranking))).features if budget else selector.features
    return learning.fit_model(rows, chosen, classes, **settings), chosen


def pair_search(
    spark: SparkSession,
    folder: str,
    rows: DataFrame,
    features: Sequence[str],
    classes: Sequence[str],
    abnormal: Sequence[str],
    candidates: Sequence[Mapping],
    subjects: Sequence[int],
    workers: int = 1,
) -> tuple[DataFrame, int]:
    """The score table of all pairs, kept in ``folder``, and how many scores were new; a pair's selector serves all its candidates, a model all its validations."""
    selectors, models = selection.Once(2 * workers), selection.Once(2 * workers)

    def score(setting: Mapping) -> dict[str, float]:
        pair, index = setting["train_subjects"], setting["candidate_index"]
        own = rows.where(F.col("subject_id").isin([int(s) for s in pair.split("_")]))
        selector = selectors.get((pair,), lambda: learning.fit_selector(own, features))
        model, chosen = models.get((pair, index), lambda: fit_candidate(own, features, classes, candidates[index], selector))
        told = learning.predict(model, rows.where(F.col("subject_id") == setting["validation_subject"]), chosen, classes)
        return _scores(told.withColumnRenamed("label", "truth"), classes, abnormal)

    return selection.resumed_search(spark, folder, pair_grid(spark, subjects, len(candidates)), KEYS, score, workers)


def _scores(told: DataFrame, classes: Sequence[str], abnormal: Sequence[str]) -> dict[str, float]:
    row = metrics.evaluate(metrics.counts(told), classes, abnormal).first()
    return {k: row[k] for k in ("accuracy", "macro_f1", "abnormal_f1")}


SCALE_KEYS = ("train_subjects", "scale", "threshold", "candidate_index", "stride", "validation_subject")


def scale_search(
    spark: SparkSession,
    folder: str,
    training: Callable[[int, float], DataFrame],
    inference: Callable[[int, int], DataFrame],
    truth: DataFrame,
    features: Sequence[str],
    classes: Sequence[str],
    abnormal: Sequence[str],
    candidates: Sequence[Mapping],
    subjects: Sequence[int],
    scales: Sequence[int],
    thresholds: Sequence[float],
    strides: Sequence[int],
    workers: int = 1,
) -> tuple[DataFrame, int]:
    """Scores of every pair of subjects, scale, threshold of training labels, candidate, stride of inference and validation subject, kept in ``folder``, and how many were new.

    ``training(scale, threshold)`` are windows with labels, ``inference(scale, stride)`` windows with ``end_pos`` made without a look at them, ``truth(subject_id, pos, label)`` the frames that predictions are held to.
    A selector serves all candidates, a model all strides and validations; what is under no window takes the nearest covered frame's class.
    """
    selectors, models = selection.Once(2 * workers), selection.Once(2 * workers)
    grid = pair_grid(spark, subjects, len(candidates))
    for name, values in (("scale", [int(v) for v in scales]), ("threshold", [float(v) for v in thresholds]), ("stride", [int(v) for v in strides])):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))  # a literal table

    def score(s: Mapping) -> dict[str, float]:
        pair, at = [int(v) for v in s["train_subjects"].split("_")], (s["train_subjects"], s["scale"], s["threshold"])
        own = training(s["scale"], s["threshold"]).where(F.col("subject_id").isin(pair))
        selector = selectors.get(at, lambda: learning.fit_selector(own, features))
        model, chosen = models.get((*at, s["candidate_index"]), lambda: fit_candidate(own, features, classes, candidates[s["candidate_index"]], selector))
        rows = inference(s["scale"], s["stride"]).where(F.col("subject_id") == s["validation_subject"])
        frames = truth.where(F.col("subject_id") == s["validation_subject"])
        told = fusion.frame_probabilities(learning.predict(model, rows, chosen, classes), frames, classes)
        held = told.select("subject_id", "pos", F.col("label").alias("pred")).join(frames.select("subject_id", "pos", F.col("label").alias("truth")), ["subject_id", "pos"])
        return _scores(metrics.valid_truth(held, classes), classes, abnormal)

    return selection.resumed_search(spark, folder, grid, SCALE_KEYS, score, workers)


def fused_scale_frames(told: Sequence[DataFrame], weights: Sequence[float], allowed: Sequence[Sequence[float]], frames: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``subject_id, pos, probs, coverage, label, confidence``: windows of several scales, each put to frames by itself, fused by declared weights; coverage is 1."""
    rows = frames.select("subject_id", "pos")
    for i, windows in enumerate(told):
        own = fusion.frame_probabilities(windows, frames, classes).select("subject_id", "pos", F.col("probs").alias(f"scale_{i}"))
        rows = rows.join(own, ["subject_id", "pos"])
    probs = x.scale_fusion([F.col(f"scale_{i}") for i in range(len(told))], weights, allowed)
    return fusion.labelled(rows.select("subject_id", "pos", probs.alias("probs"), F.lit(1).cast("long").alias("coverage")), classes)


def nested_evaluation(
    scores: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    classes: Sequence[str],
    abnormal: Sequence[str],
    candidates: Sequence[Mapping],
) -> tuple[DataFrame, DataFrame]:
    """The choice of each outer subject, and the metrics by fold and pooled of models refitted on all other subjects."""
    splits = selection.checked_audit(selection.inner_split_table(rows.select("subject_id").distinct()))
    choices = selection.outer_choices(scores, splits)
    told = []
    for choice in choices.orderBy("outer_subject").collect():  # a row a subject
        train, test = selection.leave_one_out(rows, choice["outer_subject"])
        model, chosen = fit_candidate(train, features, classes, candidates[choice["candidate_index"]])
        own = learning.predict(model, test, chosen, classes)
        told.append(own.select(F.lit(choice["outer_subject"]).alias("held_out_subject"), F.col("label").alias("truth"), "pred"))
    out = told[0]
    for t in told[1:]:
        out = out.unionByName(t)
    return choices, metrics.pooled_and_folds(metrics.valid_truth(out, classes), classes, abnormal)
