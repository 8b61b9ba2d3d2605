"""Operator 8: mixing sources to target weights by hierarchical budgeting.

The token budget is handed down a tree of levels (here domain, language, source). Children share what their parent
gets in proportion to their weights, none gets more than its supply times the epochs allowed, and what one
can't use goes to its siblings; only what a whole family can't use goes to the parent's siblings. A leaf that gets ``f`` times its
supply and a rest takes each document ``f`` times, and in the epoch after that the documents of a seeded order whose
tokens before them are fewer than the rest.

No leaf is sorted as a whole: tokens are summed by leaf and by ranges of the seeded hash, which shows the range in which the
prefix ends, and only that range is put in order. What comes of it is one cutoff for each leaf.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.llm.shared import Scratch, saved

#: Leaves up to which the plan, a row of some hundred bytes a leaf, is broadcast.
BROADCAST_LEAVES = 50_000
#: Hex digits of the hash that make a range: 4,096 ranges in a leaf at most.
RANGE_DIGITS = 3
_SPACE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    plain = F.translate(text, _SPACE[1:], " " * (len(_SPACE) - 1))
    return F.coalesce(F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def _weight(level: str, weights: Mapping[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, weight in weights.items():
        out = F.when(F.col(level) == name, weight).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """``nodes(parents..., level, budget, cap, weight)`` -> ``got``: each child's part of its parent's budget."""
    family = Window.partitionBy(*parents)
    order = family.orderBy(F.col("cap").cast("double") / F.col("weight"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = nodes.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "rest": F.sum("weight").over(rest),
        }
    )
    x = x.withColumn("full", F.col("cap") * F.col("rest") <= F.greatest(F.col("budget") - F.col("before"), F.lit(0)) * F.col("weight"))
    x = x.withColumns(
        {
            "spent": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)),
            "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(family),
        }
    )
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("((budget - spent) * weight) div open"))
    return x.withColumn("got", got).drop("before", "rest", "full", "spent", "open")


def allot(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column, epochs: int, default: int = 1) -> DataFrame:
    """``leaves(levels..., tokens)`` -> ``(levels..., tokens, got)``, with whole tokens handed down level by level."""
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs).withColumn("budget", budget)
    for i, level in enumerate(levels):
        path = list(levels[: i + 1])
        children = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first("budget").alias("budget"))
        children = children.withColumn("weight", _weight(level, weights.get(level, {}), default))
        shares = _share(children, path[:-1], level).select(*path, F.col("got").alias("share"))
        nodes = nodes.join(shares, path).withColumn("budget", F.col("share")).drop("share")
    return nodes.select(*levels, "tokens", F.col("budget").alias("got"))


def _key(seed: int, full: Column, row_id: Column) -> Column:
    """Place of a document in the seeded order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), full.cast("string"), F.coalesce(row_id.cast("string"), F.lit(""))))


def plan_mix(
    rows: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget_share: float, epochs: int, seed: int
) -> DataFrame:
    """``rows(row_id, levels..., n_tokens)`` -> ``(levels..., tokens, got, full, cutoff)``, a row for each leaf."""
    leaves = saved(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = F.lit(int(total * budget_share)).cast("long")
    shares = allot(leaves, levels, weights, budget, epochs)
    shares = shares.withColumn("full", F.expr("case when tokens > 0 then got div tokens else 0 end"))
    shares = saved(shares.withColumn("part", F.col("got") - F.col("full") * F.col("tokens")), "shares")
    small = leaves.count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda x: x)

    keyed = rows.join(hint(shares.select(*levels, "full", "part")), list(levels)).where("part > 0")
    keyed = keyed.withColumn("key", _key(seed, F.col("full"), F.col("row_id"))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy(*levels, "range", "part").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).where("before < part")
    last = ranges.groupBy(*levels).agg(F.max(F.struct("range", "before")).alias("last")).select(*levels, "last.range", "last.before")
    inside = keyed.join(hint(last), [*levels, "range"]).groupBy(*levels, "part", "before", "key").agg(F.sum("n_tokens").alias("tokens"))
    keys = Window.partitionBy(*levels).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(keys), F.lit(0))).where("at < part")
    cutoffs = taken.groupBy(*levels).agg(F.max("key").alias("cutoff"))
    return shares.join(cutoffs, list(levels), "left").select(*levels, "tokens", "got", "full", F.coalesce("cutoff", F.lit("")).alias("cutoff"))


def mix(
    documents: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    budget_share: float = 0.5,
    epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``documents`` under a struct ``doc`` with its path ``levels``, ``n_tokens`` and ``epochs``, how often it is taken.

    Documents that aren't taken don't return. Tokens are words ``[^\\x20\\x09-\\x0D]+``; the budget is ``budget_share`` of
    all tokens, rounded down, and each family rounds down as well. ``weights`` has whole positive weights by level and name, others weigh 1. A null level counts as
    the empty string and a null id as an empty one. Rows that repeat an id share a place in the order and are taken together.
    A leaf without tokens gets none, and its documents don't return; an empty table returns no rows.
    """
    named = {k: F.coalesce(v.cast("string"), F.lit("")) for k, v in levels.items()}
    tokens = word_count(F.col(text_col).cast("string"))
    scratch = Scratch(documents.sparkSession, "mixing")
    narrow = scratch.save("tokens", documents.select(F.col(id_col).alias("row_id"), tokens.alias("n_tokens"), *(v.alias(k) for k, v in named.items())))
    plan = saved(plan_mix(narrow, list(levels), weights, budget_share, epochs, seed), "plan")
    scratch.drop("tokens")
    plan = plan.select(*levels, "full", "cutoff")
    if plan.count() <= BROADCAST_LEAVES:
        plan = F.broadcast(plan)
    taken = F.col("full") + (_key(seed, F.col("full"), F.col("row_id")) <= F.col("cutoff")).cast("long")
    rows = documents.select(F.struct("*").alias("doc"), F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("body"), *(v.alias(k) for k, v in named.items()))
    rows = rows.join(plan, list(levels)).withColumn("epochs", taken).where("epochs > 0")
    return rows.select("doc", *levels, word_count(F.col("body")).alias("n_tokens"), "epochs")  # counted again for what is taken only
