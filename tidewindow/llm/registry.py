"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidewindow.llm import queries as q
from tidewindow.llm import sql

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Name -> query over a folder of tables."""
    return {
        "op1_ngram_jaccard_join": q.op1_ngram_jaccard_join,
        "op2_language_id": q.op2_language_id,
        "op3_secret_scan": q.op3_secret_scan,
        "op4_decontamination": q.op4_decontamination,
        "op5_token_counts": q.op5_token_counts,
        "op6_chat_format": q.op6_chat_format,
        "op7_html_extraction": q.op7_html_extraction,
        "op8_source_mixing": q.op8_source_mixing,
        "op9_warc_packages": q.op9_warc_packages,
        "op10_quality_rules": q.op10_quality_rules,
        "op11_embedding_whitening": q.op11_embedding_whitening,
        "op12_quality_classifier": q.op12_quality_classifier,
        "op13_merkle_manifest": q.op13_merkle_manifest,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same rows."""
    return {
        "op1_ngram_jaccard_join": sql.OP1,
        "op3_secret_scan": sql.OP3,
        "op4_decontamination": sql.OP4,
        "op6_chat_format": sql.OP6,
        "op8_source_mixing": sql.mixing_sql(q.MIX_WEIGHTS, q.MIX_SHARE, q.MIX_EPOCHS, q.MIX_SEED),
        "op9_warc_packages": sql.OP9,
        "op10_quality_rules": sql.quality_sql(),
        "op13_merkle_manifest": sql.OP13,
    }
