"""Files, caches, artifacts and streams."""

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tidewindow.operators import learning, selection
from tidewindow.schema import CLASSES, COORDS
from tidewindow.sources import cache, files
from tidewindow.streaming.windows import replayed, row_count_windows, timed_summary


@pytest.fixture
def pose_csv(tmp_path):
    lines = [",".join(["frame_id", *COORDS, "Action Label", "note"])]
    lines += [",".join([str(i), *["bad" if i == 1 and c == "nose_x" else str(i + k) for k, c in enumerate(COORDS)], "Walking", "x"]) for i in range(5)]
    (tmp_path / "s1.csv").write_text("\n".join(lines))
    return str(tmp_path / "s1.csv")


def test_pose_file(spark, pose_csv):
    df = files.read_pose(spark, pose_csv, 1)
    rows = df.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == [0, 1, 2, 3, 4] and rows[1]["nose_x"] is None and rows[0]["note"] == "x"
    assert files.labels_of(spark, pose_csv).count() == 5
    assert files.header(spark, pose_csv)[0] == "frame_id"
    assert files.first_column(df, None, files.ID_NAMES) == "frame_id"
    with pytest.raises(ValueError, match="nose_x"):
        files.aligned(df.drop("nose_x"), ["nose_x"])


def test_sinks(spark, pose_csv, tmp_path):
    source = files.read_pose(spark, pose_csv, 1)
    told = source.select("subject_id", "pos", F.lit("Walking").alias("label"), F.lit(0.5).alias("confidence"), F.lit(1).alias("coverage"))
    out = files.filled(source, told, CLASSES)
    assert {"predicted_label", "prediction_confidence", "note"} <= set(out.columns)
    files.write_csv(files.submission(source, told, 7), str(tmp_path / "out"), one_file=True)
    back = files.read_table(spark, str(tmp_path / "out"))
    assert back.columns == ["participant_id", "timestamp", "predicted_label"] and back.count() == 5
    assert files.prediction_table(told).columns == ["frame_index", "predicted_label", "confidence", "coverage"]
    with pytest.raises(SparkRuntimeException, match="no prediction"):
        files.filled(source, told.where("pos < 4"), CLASSES).collect()


def test_cache_hits_only_an_equal_signature(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    one = cache.signature({"a": 1}, "v1", {"x": 1, "y": 2})
    assert one == cache.signature({"a": 1}, "v1", {"y": 2, "x": 1}) != cache.signature({"a": 1}, "v2", {"x": 1, "y": 2})
    hits = [cache.cached(spark, str(tmp_path), key, make)[1] for key in (one, one, "other")]
    assert hits == [False, True, False] and len(made) == 2


def test_label_free_guard(spark):
    df = spark.createDataFrame([(0, None)], "start_pos int, label string")
    assert cache.label_free(df) is df
    with pytest.raises(ValueError):
        cache.label_free(df.withColumn("label", F.lit("Walking")))


def test_artifact_contract(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 2).cast("double").alias("f"), F.when(F.col("id") % 2 == 0, "Biting").otherwise("Walking").alias("label"))
    model = learning.fit_model(rows, ["f"], CLASSES, trees=2, depth=2)
    contract = {"schema_version": "1", "classes": list(CLASSES), "features": ["f"], "window": 150, "stride": 75}
    files.save_artifact(spark, model, contract, str(tmp_path / "m"))
    back, told = files.load_artifact(spark, str(tmp_path / "m"), "1", CLASSES)
    assert told["features"] == ["f"]
    assert learning.predict(back, rows, ["f"], CLASSES).where("pred <> label").count() == 0
    with pytest.raises(ValueError, match="schema version"):
        files.load_artifact(spark, str(tmp_path / "m"), "2", CLASSES)
    with pytest.raises(ValueError, match="order of classes"):
        files.load_artifact(spark, str(tmp_path / "m"), "1", CLASSES[::-1])


def test_predictions_are_filled_by_subject(spark):
    rows = [(s, p, CLASSES[s], 0.5) for s in (1, 2) for p in (0, 1)]
    told = spark.createDataFrame(rows, "subject_id int, pos long, label string, confidence double")
    out = files.filled(told.select("subject_id", "pos"), told, CLASSES).collect()
    assert sorted((r["subject_id"], r["pos"], r["predicted_label"]) for r in out) == [r[:3] for r in rows]


def test_row_count_windows_of_a_stream(spark, tmp_path):
    for part in range(3):
        spark.range(part * 7, part * 7 + 7).select(F.lit(1).cast("long").alias("subject_id"), F.col("id").alias("pos"), F.col("id").cast("double").alias("x")).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema("subject_id long, pos long, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = row_count_windows(stream, 8, 4).writeStream.format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r["start_pos"], r["n"]) for r in spark.table("wins").collect())
    assert got == [(0, 8), (4, 8), (8, 8), (12, 8)]


def test_timed_summary_is_a_plain_aggregate_on_a_table(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:00:09", "a", 3.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    row = timed_summary(df, "t", "v", "k", "10 seconds", "10 seconds", "5 seconds").first()
    assert (row["n"], row["mean"]) == (2, 2.0)


def test_a_search_resumes(spark, tmp_path):
    grid = selection.parameter_grid(spark, {"a": [1, 2], "b": [0.5, 0.7]})
    asked = []

    def score(setting):
        asked.append(setting["candidate_index"])
        if len(asked) == 3:
            raise RuntimeError("broken off")
        return {"accuracy": setting["a"] * setting["b"]}

    with pytest.raises(RuntimeError):
        selection.resumed_search(spark, str(tmp_path / "s"), grid, ["candidate_index"], score)
    scores, new = selection.resumed_search(spark, str(tmp_path / "s"), grid, ["candidate_index"], score)
    assert (scores.count(), new, asked) == (4, 2, [0, 1, 2, 2, 3])
    assert selection.resumed_search(spark, str(tmp_path / "s"), grid, ["candidate_index"], score)[1] == 0


def test_a_replayed_table_comes_in_slices(spark, tmp_path):
    """The windows of a long subject are the same in whatever slices it comes, with a gap over several of them."""
    rows = [(1, p, float(p % 7)) for p in range(100) if not 31 <= p < 62] + [(2, p, 1.0) for p in range(3)]
    frames = spark.createDataFrame(rows, "subject_id long, pos long, x double")
    one, several = (sorted(map(tuple, replayed(frames, 8, 4, f"{tmp_path}/{n}", n).collect())) for n in (1000, 20))
    plain = []
    for start in range(0, 96, 4):
        own = [x for s, p, x in rows if s == 1 and start <= p < start + 8]
        if own and start + 8 <= 100:
            plain.append((1, start, start + 8, len(own), sum(own) / len(own), min(own), max(own)))
    assert one == several == plain
