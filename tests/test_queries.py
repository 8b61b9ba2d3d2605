"""Every registered query against its SQL, and the entry point."""

import importlib
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewindow.plans import ORACLES, QUERIES
from tidewindow.schema import COORDS


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_has_the_rows_of_its_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_windows_far_from_every_class_are_predicted(spark, data, tmp_path):
    """Shoulders almost in one place put windows so far off that exp(-difference) is 0 for all classes, and the SQL divides by 0: here it counts differences from the least one."""
    table, at = f"{tmp_path}/embeddings.parquet", {c: COORDS.index(c) for c in COORDS}
    v = F.col("embedding")
    moved = F.when(F.col("i") == at["left_shoulder_x"], v[at["right_shoulder_x"]] + 1e-4).when(F.col("i") == at["left_shoulder_y"], v[at["right_shoulder_y"]]).otherwise(F.col("x"))
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("*", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.when(F.col("vec_id") % 50 == 7, moved).otherwise(F.col("x")).cast("float"))
    rows = rows.groupBy("vec_id", "label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows.select("vec_id", F.col("v.x").alias("embedding"), "label").write.parquet(table)
    sql = ORACLES["l15_predicted_frames"]
    for old, new in (("ds AS (", "dn AS ("), ("exp(-(", "(-("), ("CROSS JOIN cm m)", "CROSS JOIN cm m), ds AS (SELECT subject_id, start_pos, end_pos, label, exp(w - max(w) OVER (PARTITION BY subject_id, start_pos)) AS w FROM dn)")):
        assert sql.count(old) == 1
        sql = sql.replace(old, new)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{table}/*.parquet'")
    want = {(s, p): (label, pytest.approx(confidence, abs=1e-7), coverage) for s, p, label, confidence, coverage in db.sql(f"SELECT subject_id, pos, label, confidence, coverage FROM ({sql})").fetchall()}
    got = {(r["subject_id"], r["pos"]): (r["label"], r["confidence"], r["coverage"]) for r in QUERIES["l15_predicted_frames"](spark, str(tmp_path)).collect()}
    assert len(got) == rows.count() and got == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_folders(monkeypatch):
    """The driver removes them; a missing module of theirs is no error, any other is."""
    real = sys.modules.pop("__spark_entry__")
    gone = [n for n in sys.modules if n.startswith(("tidewindow.llm", "corpus_pipeline"))]
    kept = {n: sys.modules.pop(n) for n in gone}

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(("tidewindow.llm", "corpus_pipeline")):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    finder = Missing()
    sys.meta_path.insert(0, finder)
    try:
        again = importlib.import_module("__spark_entry__")
        assert set(again.queries()) == set(QUERIES)
        assert set(again.oracle_sql()) == set(ORACLES)
    finally:
        sys.meta_path.remove(finder)
        sys.modules |= kept
        sys.modules["__spark_entry__"] = real
