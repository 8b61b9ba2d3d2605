"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.llm import decontaminate, language_id, mixing, ngram_join, secrets
from tidewindow.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, mix_levels, table
from tidewindow.llm.shared import new_path, saved

#: Out-of-place score under which a text is like none of the languages.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. Texts without letters, and texts like no language, are rejected; a missing ``lang`` is filled in."""
    found = language_id.identify(docs, docs)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    lang = F.coalesce("doc.lang", "lang_pred")
    return kept.select(*(lang.alias("lang") if c == "lang" else F.col(f"doc.{c}") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, five words and 0.8. Of each group the document with the smallest id stays.

    A null id is told by its text. Rows that repeat both id and text are one document, rows that repeat an id alone are not: each is judged by its own text.
    """
    text = F.col("text").cast("string")
    words = F.xxhash64(text)
    key = F.coalesce(F.col("doc_id").cast("long"), -F.abs(words.bitwiseAND(2**62 - 1)) - 1)
    groups = ngram_join.ngram_jaccard_groups(docs.select(key.alias("doc_id"), text.alias("text")), n_words=5, num=80, den=100)
    first = groups.where("leads").select(F.col("doc_id").alias("key"), "text_id").distinct()
    keyed = docs.select(F.struct("*").alias("doc"), key.alias("key"), words.alias("text_id"))
    return keyed.join(first, ["key", "text_id"], "left_semi").dropDuplicates(["key", "text_id"]).select("doc.*")


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Documents with a ten-word window of a benchmark item are dropped."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3. Every document stays; each secret in its text is replaced by its kind, and ``n_chars`` follows."""
    ledger = secrets.Ledger(spark, new_path(spark, "ledger"))
    ledger.scan(docs, path="doc_id", content="text")
    found = ledger.findings(docs, content="text").withColumn("clean", secrets.redacted(F.col("version.text"), F.col("spans")))
    new = {"text": F.col("clean"), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("version.n_chars"))}
    return found.select(*(new.get(c, F.col(f"version.{c}")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. The documents of the mix, with their domain and tokens and how often each is taken.

    Columns of the documents that have one of these three names give way to them.
    """
    out = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    added = ("domain", "n_tokens", "epochs")
    return out.select(*(F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in added), *added)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]
#: Language profiles can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
