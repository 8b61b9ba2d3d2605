"""What the pipeline's stages ask of Python workers, each of which holds some hundred MB of an executor."""

import corpus_pipeline
from tidewindow.llm import secrets
from tidewindow.llm.shared import new_path


def test_language_stage_predicts_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = corpus_pipeline.identify_language(spark, docs, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_new_ledger_starts_no_python_workers(spark):
    ledger = secrets.Ledger(spark, new_path(spark, "ledger"))
    assert ledger._rows().rdd.getNumPartitions() == 0
    docs = spark.createDataFrame([("a", "x password=b7db7aa4a5fcc78305 y"), ("b", None)], "path string, content string")
    assert (ledger.scan(docs), ledger.scan(docs)) == (2, 0)
    assert {r["version"]["path"]: len(r["spans"]) for r in ledger.findings(docs).collect()} == {"a": 1, "b": 0}
