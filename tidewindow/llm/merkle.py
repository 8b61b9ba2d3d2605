"""Operator 13: a manifest of a data set as a Merkle tree, and a proof for each of its rows.

Rows are leaves of a tree each (here a language), in order; every two neighbours become the digest of both, until one is left. The roots of the trees
are the leaves of one more tree. Digests name what they were made of: a record, found by the digest of its top, holds the levels of nodes below it, ``STEP`` of them, down
to 2 ** STEP children. Requests for leaves start at the root. The digits of a leaf's rank, base 2 ** STEP, say which child comes next, and at each binary level on the way
the node that was not taken is kept. Requests that share their digits so far are one row and share one path, up to the last record, where 2 ** STEP of them
part. Read backwards, a path leads from the leaf to the root.

Ranks come from a table in range order and counts by partition, so no task orders a whole tree; a record has a fixed number of nodes at any size, and so has a batch of
requests. All of it is Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.llm.shared import Scratch

#: Binary levels of a record.
STEP = 8
#: Up to so many rows of counts are broadcast, one for each partition and tree that meet; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def digest_of(*parts: Column) -> Column:
    """SHA-256 of texts one after the other, as lower-case hexadecimal."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of values: ``-`` for null, else the bytes of its UTF-8 text, a colon and the text."""
    texts = [v.cast("string") for v in values]
    return digest_of(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


# -- ranks ----------------------------------------------------------------------------------------------------------------


def ranked(rows: DataFrame, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``rank``, their place in their ``tree`` from 0 on, and ``size``, the rows of that tree. Nulls come first; rows that are equal in ``order`` take any places.

    Equal rows are spread by their place in the input, so that a row with very many copies is not one partition.
    """
    keys = ["tree", *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = scratch.save(name, dealt.withColumn("_row", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    counts = placed.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part")
    counts = counts.select(
        "tree",
        "_part",
        (F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("size"),
    )
    counts = scratch.save(f"{name}-counts", counts)
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = placed.join(F.broadcast(counts) if few else counts, ["tree", "_part"])
    return out.withColumn("rank", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


# -- records --------------------------------------------------------------------------------------------------------------


def _nodes_at(size: Column, level: int) -> Column:
    """How many nodes a tree of so many leaves has ``level`` records up."""
    return F.shiftright(size - 1, STEP * level) + 1


def _rounds(size: Column, level: int) -> Column:
    """Binary levels of a record: as many as reach one node in the top record of a tree, ``STEP`` elsewhere."""
    n = _nodes_at(size, level)
    return F.when(n > 2**STEP, STEP).when(n == 1, 0).otherwise(F.length(F.bin(n - 1)))


def _up(nodes: Column) -> Column:
    """The level above: every two nodes become the digest of both, a last one alone its own."""
    pairs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1))
    return F.transform(pairs, lambda i: digest_of(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _levels(nodes: Column, rounds: Column) -> Column:
    """The levels of a record, the children first."""
    kind = "array<array<string>>"
    grown = F.aggregate(F.sequence(F.lit(1), rounds), F.array(nodes).cast(kind), lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1)))).cast(kind))
    return F.when(rounds == 0, F.array(nodes).cast(kind)).otherwise(grown)


@dataclass(frozen=True)
class Trees:
    """Trees in records: of each level up, ``tree, size, block, digest, levels``; those of the first level hold ``requests`` too, an entry a leaf."""

    blocks: tuple[DataFrame, ...]

    def records(self, level: int) -> DataFrame:
        """``digest, levels``: what a digest was made of, each digest once."""
        return self.blocks[level].select("digest", "levels").dropDuplicates(["digest"])

    def roots(self, level: int) -> DataFrame:
        """``tree, size, digest`` of the trees that end at this level."""
        least = 2 ** (STEP * level) if level else 0
        ends = (F.col("size") > least) & (F.col("size") <= 2 ** (STEP * (level + 1)))
        return self.blocks[level].where(ends).select("tree", "size", "digest")

    def all_roots(self) -> DataFrame:
        out = self.roots(0)
        for level in range(1, len(self.blocks)):
            out = out.unionByName(self.roots(level))
        return out


def grow(leaves: DataFrame, scratch: Scratch, name: str) -> Trees:
    """Trees of ``tree, size, rank, digest, request`` with size over 0, level by level; each level is a written table, a 2 ** STEP-th of the one below."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    blocks, nodes, level = [], leaves, 0
    while not blocks or largest > 2 ** (STEP * level):
        parts = [F.col("rank"), F.col("digest")] + ([F.col("request")] if level == 0 else [])
        grouped = nodes.groupBy("tree", "size", F.shiftright("rank", STEP).alias("block")).agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("nodes"))
        grouped = grouped.withColumn("levels", _levels(F.col("nodes.digest"), _rounds(F.col("size"), level)))
        requests = [F.col("nodes.request").alias("requests")] if level == 0 else []
        blocks.append(scratch.save(f"{name}-{level}", grouped.select("tree", "size", "block", F.element_at("levels", -1)[0].alias("digest"), "levels", *requests)))
        level += 1
        nodes = blocks[-1].where(F.col("size") > 2 ** (STEP * level)).select("tree", "size", F.col("block").alias("rank"), "digest")
    return Trees(tuple(blocks))


# -- descent --------------------------------------------------------------------------------------------------------------


def _segment(levels: Column, child: Column) -> Column:
    """The nodes beside the way from a record's top to a child, top first: an empty text where a node stood alone, and whether it is on the left."""

    def beside(level: Column) -> Column:
        at = F.call_function("shiftright", child, level)
        sibling = F.get(F.get(levels, level), at.bitwiseXOR(F.lit(1)))
        return F.struct((at % 2 == 1).alias("left"), F.coalesce(sibling, F.lit("")).alias("digest"))

    top = F.size(levels) - 2
    empty = F.expr("cast(array() as array<struct<left: boolean, digest: string>>)")
    return F.when(top < 0, empty).otherwise(F.transform(F.sequence(top, F.lit(0), F.lit(-1)), beside))


def descend(trees: Trees, starts: DataFrame) -> DataFrame:
    """``subroot, path, request`` for each leaf: ``path`` has the nodes that were not taken from the root on.

    ``starts``: ``tree, digest, path``, where requests enter a tree and what lies above it.
    """
    above = None
    for level in reversed(range(len(trees.blocks))):
        enter = trees.roots(level).select("tree").join(starts, "tree").select("tree", F.lit(0).cast("long").alias("block"), "digest", F.col("digest").alias("subroot"), "path")
        here = enter if above is None else above.unionByName(enter)
        if level:
            met = here.join(trees.records(level), "digest")
            met = met.select("tree", "block", "subroot", "path", "levels", F.posexplode(F.col("levels")[0]).alias("child", "digest"))
            path = F.concat("path", _segment(F.col("levels"), F.col("child")))
            above = met.select("tree", (F.shiftleft("block", STEP) + F.col("child")).alias("block"), "digest", "subroot", path.alias("path"))
    batches = trees.blocks[0].select("tree", "block", "requests").join(here, ["tree", "block"]).join(trees.records(0), "digest")
    met = batches.select("subroot", "path", "levels", F.posexplode("requests").alias("child", "request"))
    return met.select("subroot", F.concat("path", _segment(F.col("levels"), F.col("child"))).alias("path"), "request")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the nodes beside its way lead to."""
    return F.aggregate(F.reverse(path), leaf, lambda acc, x: F.sha2(F.when(x["left"], F.concat(x["digest"], acc)).otherwise(F.concat(acc, x["digest"])), 256))


def proofs(rows: DataFrame) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``id, tree, leaf, altered``.

    ``tree``: a text or null, the latter being a tree of its own, before all others; trees are in order of their UTF-8. Leaves are in order of ``id``, nulls first, and those with
    equal ids in order of their digests. ``altered``: the leaf as it is now, null if it is as it was. An empty table gives no rows. The result reads the manifest, which stays in the shared folder.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    tree = F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit(""))
    leaves = scratch.save("leaves", rows.select("id", "leaf", "altered", tree.alias("tree")))
    placed = ranked(leaves, ["id", "leaf"], scratch, "sorted")
    trees = grow(placed.select("tree", "size", "rank", F.col("leaf").alias("digest"), F.struct("id", "leaf", "altered").alias("request")), scratch, "tree")
    scratch.drop("leaves", "sorted", "sorted-counts")
    subroots = ranked(trees.all_roots().select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), ["own"], scratch, "subroots")
    top = grow(subroots.select("tree", "size", "rank", "digest", F.struct("own", "digest").alias("request")), scratch, "top")
    root = top.all_roots().select("tree", "digest", F.expr("cast(array() as array<struct<left: boolean, digest: string>>)").alias("path"))
    starts = scratch.save("starts", descend(top, root).select(F.col("request.own").alias("tree"), F.col("request.digest").alias("digest"), "path"))
    scratch.drop("subroots", "subroots-counts")
    told = (root.first() or {"digest": None})["digest"]
    found = descend(trees, starts).select("request.*", "subroot", "path")
    out = found.select(
        "id",
        "leaf",
        "subroot",
        F.lit(told).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform(F.reverse("path"), lambda x: x["digest"]), ""), 256).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
