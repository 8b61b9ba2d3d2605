"""Reading of pose files, and writing of predictions, metrics and model contracts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.operators.frames import missing_columns, require
from tidewindow.schema import COORDS

LABEL = "Action Label"
ID_NAMES = ("frame_id", "frame", "frame_number", "frame_index", "id", "index")
TIME_NAMES = ("timestamp", "time", "time_s", "seconds")


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, of which only the first lines are read."""
    return spark.read.option("header", True).csv(path).columns


def preview(spark: SparkSession, path: str, rows: int = 900) -> DataFrame:
    """The first rows of a CSV file."""
    return spark.read.option("header", True).csv(path).limit(rows)


def read_pose(spark: SparkSession, path: str, subject_id: int, labelled: bool = True) -> DataFrame:
    """A subject's frames with ``subject_id`` and ``pos``; columns are matched by name, further ones are kept as text.

    Without a frame id, ``pos`` follows the order of lines in the file.
    """
    raw = spark.read.option("header", True).csv(path)
    require(raw, [*COORDS, *([LABEL] if labelled else [])])
    numbers = {c: F.col(c).try_cast("double") for c in COORDS}
    out = raw.withColumns(numbers)
    if "frame_id" in out.columns:
        out = out.withColumn("frame_id", F.col("frame_id").try_cast("double").cast("long"))
    return with_line_pos(out).withColumns({"subject_id": F.lit(subject_id), **({"label": F.col(LABEL)} if labelled else {})})


def with_line_pos(df: DataFrame) -> DataFrame:
    """``pos`` by the order of lines: rows are numbered within file splits, and splits are set off by the counts of those before.

    No window over all rows is needed; the counts are one row a split.
    """
    marked = df.withColumn("__id", F.monotonically_increasing_id())
    marked = marked.withColumns({"__part": F.shiftrightunsigned("__id", 33), "__row": F.col("__id").bitwiseAND((1 << 33) - 1)})
    sizes = marked.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row a split
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["__part"], total))
        total += r["n"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part long, __offset long")
    return marked.join(F.broadcast(table), "__part").withColumn("pos", F.col("__row") + F.col("__offset")).drop("__id", "__part", "__row", "__offset")


def labels_of(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, label)``: the label column alone."""
    return with_line_pos(spark.read.option("header", True).csv(path).select(F.col(LABEL).alias("label")))


def first_column(df: DataFrame, explicit: str | None, names: Sequence[str]) -> str | None:
    """The column asked for, else the first of ``names`` that is there, else none."""
    if explicit is not None:
        require(df, [explicit])
        return explicit
    return next((n for n in names if n in df.columns), None)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A result table: JSON or CSV with a header, by the name's ending."""
    return spark.read.option("multiLine", True).json(path) if path.endswith(".json") else spark.read.option("header", True).option("inferSchema", True).csv(path)


# -- sinks ------------------------------------------------------------------------------------------------------------


def prediction_table(frames: DataFrame) -> DataFrame:
    """``frame_index, predicted_label, confidence, coverage``."""
    return frames.select(F.col("pos").alias("frame_index"), F.col("label").alias("predicted_label"), "confidence", "coverage")


def _meeting(source: DataFrame, frames: DataFrame) -> list[str]:
    """The columns that rows and frames meet by."""
    return ["subject_id", "pos"] if "subject_id" in source.columns and "subject_id" in frames.columns else ["pos"]


def filled(source: DataFrame, frames: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The source's columns with ``predicted_label`` and ``prediction_confidence``; an error for a row without a prediction or with an unknown label.

    Rows meet by subject and place where both sides have a subject, else by place.
    """
    keys = _meeting(source, frames)
    own = frames.select(*keys, F.col("label").alias("predicted_label"), F.col("confidence").alias("prediction_confidence"))
    out = source.join(own, keys, "left")
    known = F.coalesce(F.col("predicted_label").isin(*classes), F.lit(False))
    checked = F.when(known, F.col("predicted_label")).otherwise(F.raise_error(F.lit("a row has no prediction of a known class")))
    return out.withColumn("predicted_label", checked)


def submission(source: DataFrame, frames: DataFrame, participant: int, label_name: str = "predicted_label") -> DataFrame:
    """``participant_id, timestamp`` and the label: time is the source's timestamp, else its frame id, else the row's number.

    Rows meet by subject and place where both sides have a subject, else by place.
    """
    time = first_column(source, None, ("timestamp", "frame_id"))
    stamp = F.col(time) if time else F.col("pos")
    keys = _meeting(source, frames)
    out = source.select(*keys, stamp.alias("timestamp")).join(frames.select(*keys, F.col("label").alias(label_name)), keys)
    return out.select(F.lit(participant).alias("participant_id"), "timestamp", label_name)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` for tables known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines of a small table."""
    df.coalesce(1).write.mode("overwrite").json(path)


# -- models with a contract -------------------------------------------------------------------------------------------

REQUIRED = ("schema_version", "classes", "features", "window", "stride")


def save_artifact(spark: SparkSession, model: PipelineModel, contract: dict, path: str) -> None:
    """A model with the names and settings it needs, as JSON beside it."""
    lacks = [k for k in REQUIRED if k not in contract]
    if lacks:
        raise ValueError(f"the contract lacks {', '.join(lacks)}")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(contract, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load_artifact(spark: SparkSession, path: str, schema_version: str, classes: Sequence[str]) -> tuple[PipelineModel, dict]:
    """The model and its contract, refused for another schema version or class order."""
    contract = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    lacks = [k for k in REQUIRED if k not in contract]
    if lacks:
        raise ValueError(f"the contract lacks {', '.join(lacks)}")
    if contract["schema_version"] != schema_version:
        raise ValueError(f"schema version {contract['schema_version']}, not {schema_version}")
    if list(contract["classes"]) != list(classes):
        raise ValueError("another order of classes")
    return PipelineModel.load(f"{path}/model"), contract


def aligned(features: DataFrame, expected: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected features in their order; an error names missing ones."""
    if lacks := missing_columns(features, expected):
        raise ValueError(f"missing features: {', '.join(lacks)}")
    return features.select(*others, *expected)
