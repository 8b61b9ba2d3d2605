"""Operator 3: secret scans with an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger has, for each blob, the rule
versions that have scanned it and what they found; a run scans only blobs that some rule version has not seen, with
those rules alone, and findings are joined back to all paths that have the blob.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.llm import prefixes
from tidewindow.llm.shared import saved

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,rule:string>>"
_SCANS = f"blob string, rules array<string>, spans {_SPANS}"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are findings if group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token"))
#: The base kinds. A run of at least so many characters equals a whole run that is long enough, so that the
#: latter two have their length in the pattern; the first can consume a keyword in a short match, so it is filtered after.
BASE = (
    Rule("assign", rf"({_KEYWORDS}|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: What the ledger's rule set adds to them.
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's leftmost non-overlapping matches: code points, end exclusive.

    The pieces between the matches and the matches themselves, laid end to end, give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    graded = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else whole
    rows = F.arrays_zip(whole.alias("m"), graded.alias("g"), F.split(text, rule.pattern, -1).alias("before"))
    rows = F.transform(rows, lambda r: F.struct(F.length(r["before"]).alias("before"), F.coalesce(F.length(r["m"]), F.lit(0)).alias("size"), (r["m"].isNotNull() & (F.length(r["g"]) >= rule.least)).alias("good")))
    empty = F.expr(f"cast(array() as {_SPANS})")

    def placed(own: Column) -> Column:
        at = prefixes.sums_before(F.transform(own, lambda r: r["before"] + r["size"]))
        spans = F.zip_with(
            own, at, lambda r, p: F.struct((p + r["before"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (p + r["before"] + r["size"]).alias("end"), F.lit(rule.name).alias("rule"), r["good"].alias("good"))
        )
        return F.transform(F.filter(spans, lambda x: x["good"]), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "rank", "kind", "end", "rule")))).cast(_SPANS)

    return F.when(F.regexp_like(text, F.lit(rule.pattern)), prefixes.let(rows, placed)).otherwise(empty)


class Ledger:
    """Scans kept as Parquet in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str, rules: Sequence[Rule] = RULES) -> None:
        self.spark, self.folder, self.rules = spark, folder, tuple(rules)
        if len({r.name for r in self.rules}) < len(self.rules):
            raise ValueError("two rules have the same kind and version")

    def scans(self) -> DataFrame:
        """``(blob, rules, spans)``: all runs so far, one row for each blob. What two runs have both found, at once or one after a lost append, counts once."""
        return self._rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))

    def scan(self, versions: DataFrame, path: str = "path", content: str = "content") -> int:
        """Scans what is new in ``versions`` and returns the number of blobs that had something unseen.

        Null content is the empty blob. Equal contents are one blob, under any number of paths; of those the one with the smallest path
        is read. An empty table adds nothing.
        """
        texts = versions.select(F.coalesce(F.col(path).cast("string"), F.lit("")).alias("p"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("text"))
        texts = texts.withColumn("blob", blob_of(F.col("text")))
        names = F.array(*(F.lit(r.name) for r in self.rules))
        blobs = texts.groupBy("blob").agg(F.min("p").alias("p"))
        unseen = blobs.join(self.scans().select("blob", F.col("rules").alias("seen")), "blob", "left")
        unseen = unseen.select("blob", "p", F.array_except(names, F.coalesce("seen", F.expr("cast(array() as array<string>)"))).alias("rules")).where(F.size("rules") > 0)
        todo = texts.join(unseen, ["p", "blob"])
        each = [F.when(F.array_contains("rules", r.name), spans_of(F.col("text"), r, i)).alias(f"s{i}") for i, r in enumerate(self.rules)]
        spans = F.concat(*(F.coalesce(f"s{i}", F.expr(f"cast(array() as {_SPANS})")) for i in range(len(self.rules))))
        found = todo.select("blob", "rules", *each).select("blob", "rules", spans.alias("spans"))
        found = found.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("spans").alias("spans"))
        before = self._rows().count()
        found.write.mode("append").parquet(self.folder)
        return self._rows().count() - before

    def _rows(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.read.schema(_SCANS).parquet(self.folder)
        return self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), _SCANS)  # no partitions: of an empty list, each would start a Python worker

    def findings(self, versions: DataFrame, content: str = "content") -> DataFrame:
        """``versions`` under a struct ``version``, with ``blob`` and the sorted ``spans`` of the current rules.

        Every row returns, whatever the names of its columns; a blob that no run has scanned has null spans.
        """
        rows = versions.select(F.struct("*").alias("version"), blob_of(F.coalesce(F.col(content).cast("string"), F.lit(""))).alias("blob"))
        current = [r.name for r in self.rules]
        kept = self.scans().select("blob", F.array_sort(F.filter("spans", lambda s: s["rule"].isin(current))).alias("spans"))
        return rows.join(saved(kept, "findings"), "blob", "left").select("version", "blob", "spans")


def blob_of(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(text.cast("binary"), 256)


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """A text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""

    def replaced(own: Column) -> Column:
        ends = prefixes.most_before(F.transform(own, lambda x: x["end"]))
        seen = F.filter(F.zip_with(own, ends, lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at"))), lambda x: x["start"] >= x["at"])
        parts = F.transform(seen, lambda x: F.concat(F.substring(text, x["at"] + 1, x["start"] - x["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        last = F.array_max(F.transform(own, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.lit(2**31 - 1)))

    return F.when(F.size(spans) > 0, prefixes.let(spans, replaced)).otherwise(text)
