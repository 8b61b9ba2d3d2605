"""Each operator over its whole table, with production parameters."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.llm import chat_format, decontaminate, html_text, language_id, merkle, mixing, quality, quality_classifier, secrets, token_counts, warc, whitening
from tidewindow.llm.ngram_join import ngram_jaccard_groups
from tidewindow.llm.shared import new_path

#: Vocabulary of operator 5: a base64 token and its rank on each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Target weights of operator 8; the domain of a source is its number modulo 4.
MIX_WEIGHTS = {"domain": {"0": 4, "1": 3, "2": 2, "3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix_levels() -> dict:
    """The levels of the tree that documents are mixed by."""
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("int")
    return {"domain": F.coalesce(number % 4, F.lit(0)), "lang": F.col("lang"), "source": F.col("source")}


def _is_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at a Jaccard similarity of 0.9 on three-word shingles."""
    groups = ngram_jaccard_groups(table(spark, sf_dir, "documents"), n_words=3, num=90, den=100)
    return groups.select("doc_id", "n_shingles", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by profiles of the documents outside of the held-out fifth."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = documents.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    out = language_id.identify(documents, train)
    return out.select("doc.doc_id", language_id.held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document, by a ledger that starts empty."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.Ledger(spark, new_path(spark, "ledger"))
    ledger.scan(documents, path="doc_id", content="text")
    found = ledger.findings(documents, content="text")
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    counts = [F.size(F.filter("spans", partial(_is_kind, r.kind))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select("version.doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document lie in ten-word windows of the benchmark."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(documents, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of each document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.token_counts(documents, token_counts.read_vocabulary(spark, VOCABULARY))
    return out.select("doc.doc_id", "n_tokens", "n_words")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(rows.unionByName(hard))
    out = out.withColumns({"turns": chat_format.read_back(F.col("formatted")), "trained": chat_format.loss_texts(F.col("formatted"), F.col("loss"))})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    out = html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page.page_id", "page.url", "text", "n_chars")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mix of half of all tokens, and how often each is taken."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.mix(documents, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return out.select("doc.doc_id", "domain", "lang", "source", "n_tokens", "epochs")


def op9_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the pages, written to ZIP packages and read back."""
    out = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each document and whether it is kept."""
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of each embedding."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=16)
    return out.withColumnRenamed("id", "vec_id")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document, learned from the labels of two thirds of them."""
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    labels = table(spark, sf_dir, "labels").where(part != 1)
    out = quality_classifier.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_classifier.label_means(labels, F.col("quality")))
    return out.withColumnRenamed("id", "doc_id").select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for each document, those of every seventh checksum against a changed leaf."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in documents.columns]
    changed = [*fields[:3], F.col("n_chars").cast("decimal(20,0)") + 1, fields[4]]
    altered = F.when((F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull(), merkle.leaf_of(changed))
    rows = documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("tree"), merkle.leaf_of(fields).alias("leaf"), altered.alias("altered"))
    return merkle.proofs(rows).withColumnRenamed("id", "doc_id")
