"""One local session for all tests, and DuckDB over the driver's tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip(f"no tables in {DATA}")
    return DATA


@pytest.fixture(scope="session")
def same_rows(spark, data):
    """Asserts that a query has the rows of its SQL, as multisets with columns by name."""
    db = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")

    def check(query, sql):
        df = query(spark, data)
        columns = sorted(df.columns)
        found = db.sql(sql)
        assert columns == sorted(found.columns)
        names = ", ".join(f'"{c}"' for c in columns)
        expected = db.sql(f"SELECT {names} FROM ({sql})").fetchall()
        rows = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
        assert sorted(map(repr, rows)) == sorted(map(repr, expected))

    return check
