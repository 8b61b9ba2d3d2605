"""Running sums over arrays, and texts with very many matches or turns."""

import time

import pytest
from pyspark.sql import functions as F

from tidewindow.llm import chat_format, prefixes, secrets


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 500])
def test_sums_and_maxima_before(spark, n):
    values = [(7 * i * i) % 31 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    row = df.select(prefixes.sums_before(F.col("v")).alias("s"), prefixes.most_before(F.col("v")).alias("m")).first()
    assert row["s"] == [sum(values[:i]) for i in range(n)]
    assert row["m"] == [max(values[:i], default=0) for i in range(n)]


def test_very_many_secrets(spark):
    n = 20_000
    text = " ".join(f"token=abcdefgh{i % 10}" for i in range(n))
    df = spark.createDataFrame([(text,)], "t string").select(secrets.spans_of(F.col("t"), secrets.BASE[0], 0).alias("s"))
    start = time.monotonic()
    spans = df.first()["s"]
    assert [(s["start"], s["end"]) for s in spans] == [(16 * i, 16 * i + 15) for i in range(n)]
    assert time.monotonic() - start < 40


def test_redaction_of_overlapping_spans(spark):
    spans = [(0, 3, "a"), (2, 5, "b"), (4, 6, "c"), (6, 8, "d"), (7, 8, "e"), (10, 12, "f")]
    df = spark.createDataFrame([("0123456789abcdef", [(s, 0, k, e, k) for s, e, k in spans]), ("none", [])], f"t string, s {secrets._SPANS}")
    assert [r[0] for r in df.select(secrets.redacted(F.col("t"), F.col("s"))).collect()] == ["[A][D]89[F]cdef", "none"]


def test_very_many_turns(spark):
    n = 5_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said "), F.col("id")).alias("text"))
    out = chat_format.format_conversations(rows)
    row = out.select("formatted", "loss", chat_format.loss_texts(F.col("formatted"), F.col("loss")).alias("said")).first()
    assert row["said"] == [f"said {i}" for i in range(1, n, 2)]
