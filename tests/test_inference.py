"""Training and prediction end to end on made poses."""

import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewindow.operators import learning, selection, windows
from tidewindow.plans.inference import evaluated, label_free_cache, multiscale_cache, predict_frames, training_windows
from tidewindow.plans.search import SCALE_KEYS, nested_evaluation, pair_search, scale_search
from tidewindow.schema import JOINTS


def test_two_ways_of_moving_are_told_apart(spark):
    t = F.col("pos")
    fast = (t / 120 % 2).cast("int") == 1
    xy = {}
    for j, joint in enumerate(JOINTS):
        xy[f"{joint}_x"] = 100.0 + 3 * j + F.when(fast, 9 * F.sin(t * 1.3 + j)).otherwise(0.2 * F.sin(t / 9 + j))
        xy[f"{joint}_y"] = 200.0 + 5 * j + F.cos(t / 11 + j)
    poses = spark.range(480).select(F.lit(1).alias("subject_id"), F.col("id").alias("pos")).withColumns(xy)
    poses = poses.withColumn("label", F.when(fast, "Attacking").otherwise("Walking"))
    classes = ["Attacking", "Walking"]
    rows, names = training_windows(poses, size=30, stride=15, classes=classes)
    model = learning.fit_model(rows, names, classes, trees=5, depth=3)
    out = predict_frames(model, poses, np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5]), size=30, stride=15, classes=classes)
    right = out.join(poses.select("pos", F.col("label").alias("truth")), "pos").where("label = truth").count()
    assert out.count() == 480 and right > 440


def test_nested_selection_resumes_and_prefers_the_useful_setting(spark, tmp_path):
    rows = spark.range(160).select(
        (F.col("id") % 4 + 1).cast("int").alias("subject_id"),
        F.when(F.col("id") % 8 < 4, "Biting").otherwise("Walking").alias("label"),
        (F.when(F.col("id") % 8 < 4, 1.0).otherwise(0.0) + F.rand(3) * 0.2).alias("useful"),
        F.rand(4).alias("noise"),
    ).persist()
    classes, candidates = ["Biting", "Walking"], [{"trees": 2, "depth": 2, "budget": 1}, {"trees": 1, "depth": 0, "budget": 1}]
    args = (rows, ["useful", "noise"], classes, ["Biting"], candidates)
    scores, new = pair_search(spark, str(tmp_path / "s"), *args, [1, 2, 3, 4])
    assert new == 24 and pair_search(spark, str(tmp_path / "s"), *args, [1, 2, 3, 4])[1] == 0
    choices, result = nested_evaluation(scores, *args)
    assert {r["candidate_index"] for r in choices.collect()} == {0}
    assert result.where("held_out_subject is null").first()["accuracy"] == 1.0
    rows.unpersist()


def test_window_caches_and_optional_labels(spark, tmp_path):
    t = F.col("id")
    poses = spark.range(90).select((t % 2).cast("int").alias("subject_id"), F.floor(t / 2).alias("pos"), F.lit("Walking").alias("label"), *((t % 13 + i).cast("double").alias(f"{j}_{a}") for i, j in enumerate(JOINTS) for a in "xy"))
    made = []

    def source():
        made.append(1)
        return poses

    folder = str(tmp_path)
    for there in (False, True):
        rows, hit = label_free_cache(spark, folder, {"v": 1}, source, "C", 20, 10)
        assert hit is there and rows.where("label is not null").count() == 0 and rows.groupBy("subject_id").count().count() == 2
    assert len(made) == 1 and label_free_cache(spark, folder, {"v": 2}, source, "C", 20, 10)[1] is False
    rows, hit = multiscale_cache(spark, folder, {"v": 1}, source, (10, 20), 10)
    got = {(r["window_size"], r["start_pos"]) for r in rows.select("window_size", "start_pos").distinct().collect()}
    assert not hit and got == {(10, s) for s in (0, 10, 20, 30, 35)} | {(20, s) for s in (0, 10, 20, 25)}
    told = poses.select("subject_id", "pos", F.lit("Walking").alias("label"))
    assert evaluated(told, None, ["Walking"], []) is None and evaluated(told, poses.withColumn("label", F.lit("None")), ["Walking"], []) is None
    assert evaluated(told, poses, ["Walking"], []).first()["accuracy"] == 1.0


def test_searches_at_once_go_on_where_they_were_broken_off(spark, tmp_path):
    """With several workers, rows are those of the sequential search, and what was scored before an error isn't scored again."""
    grid = selection.parameter_grid(spark, {"a": [1, 2, 3], "b": [0.5, 0.7, 0.9]})
    asked, lock = [], threading.Lock()

    def score(setting, broken=False):
        with lock:
            asked.append(setting["candidate_index"])
        if broken and setting["candidate_index"] == 4:
            raise RuntimeError("broken off")
        return {"accuracy": spark.range(setting["candidate_index"] + 1).count() * setting["b"]}

    one, _ = selection.resumed_search(spark, str(tmp_path / "one"), grid, ["candidate_index", "b"], score)
    asked.clear()
    with pytest.raises(RuntimeError, match="broken off"):
        selection.resumed_search(spark, str(tmp_path / "s"), grid, ["candidate_index", "b"], lambda s: score(s, True), workers=3)
    kept = set(asked) - {4}
    asked.clear()
    several, new = selection.resumed_search(spark, str(tmp_path / "s"), grid, ["candidate_index", "b"], score, workers=3)
    assert set(asked) == set(range(9)) - kept and new == len(asked)
    assert sorted(map(tuple, several.collect())) == sorted(map(tuple, one.collect()))


def test_a_value_is_made_once(spark):
    made, once = [], selection.Once(2)

    def make():
        made.append(1)
        return len(made)

    with ThreadPoolExecutor(4) as pool:
        assert set(pool.map(lambda _: once.get(("a",), make), range(20))) == {1}
    with pytest.raises(ZeroDivisionError):
        once.get(("b",), lambda: 1 // 0)
    assert once.get(("b",), lambda: 5) == 5


def test_search_over_scales_thresholds_and_strides(spark, tmp_path):
    frames = spark.range(4 * 48).select((F.col("id") % 4 + 1).cast("int").alias("subject_id"), F.floor(F.col("id") / 4).alias("pos"))
    truth = frames.withColumn("label", F.when(F.floor(F.col("pos") / 12) % 2 == 0, "Biting").otherwise("Walking")).persist()
    value = truth.withColumn("v", F.when(F.col("label") == "Biting", 1.0).otherwise(0.0) + (F.col("pos") % 5) * 0.01)
    classes = ["Biting", "Walking"]

    def training(scale, threshold):
        own = windows.labelled_windows(value, classes, scale, scale // 2, threshold)
        return own.groupBy("subject_id", "start_pos", "label").agg(F.avg("v").alias("mean"), F.max("pos").alias("last"))

    def inference(scale, stride):
        own = windows.unlabelled_windows(value, scale, stride)
        return own.groupBy("subject_id", "start_pos").agg(F.avg("v").alias("mean"), F.max("pos").alias("last"), (F.max("pos") + 1).alias("end_pos"))

    args = (training, inference, truth, ["mean", "last"], classes, ["Biting"], [{"trees": 2, "depth": 2, "budget": 1}], [1, 2, 3], (6,), (0.6, 0.9), (3, 6))
    scores, new = scale_search(spark, str(tmp_path / "s"), *args, workers=3)
    assert new == 3 * 2 * 2 == scores.select(*SCALE_KEYS).distinct().count()
    assert all(r["accuracy"] > 0.8 for r in scores.collect())
    assert scale_search(spark, str(tmp_path / "s"), *args, workers=2)[1] == 0
    truth.unpersist()
