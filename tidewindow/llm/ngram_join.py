"""Operator 1: Jaccard self-join of documents on their distinct word n-grams.

Documents with the same n-gram set form one class, and only classes are compared. An n-gram's place in the global order is given by
how often its bucket of hash space occurs in the whole corpus, rarest first; a class is entered under the
n-grams of its prefix alone. Candidates pass a length filter, a positional filter and a filter
on the symmetric difference of what follows (parity bitmaps, then counts between
pivots of the sorted sets), and each distinct pair is compared once.

To stay linear on large groups of near copies, a first round compares each class only with the
leader of its n-gram, the class that reaches it at the earliest position. Pairs inside one
component of these links need no further comparison for the components; a second round compares all
remaining pairs whose components differ, without a cap. An n-gram under which very many such classes are left is not joined by itself. A link
shares two n-grams of prefixes that are one n-gram longer, so classes with few such n-grams meet under pairs of n-grams. For a class with many of them these would be too many. Two sets of n and m items that link
have at most D = n + m - 2 * overlap unlike items, so of their first D + 2 common items two stand side by side in both: each unlike item parts one such pair at most.
Such a class meets others under pairs of neighbours in the order, of which a prefix twice as long has no more than it has items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.components import components
from tidewindow.llm.shared import Scratch, small_batches
from tidewindow.llm.textvec import mix64, set_id, shingles

#: Buckets of hash space whose occurrences are counted, as powers of two: the broadcast order table has 4 bytes for each,
#: so 1 MB at least and 64 MB at most. They grow with the corpus, to hold BUCKET_BYTES of text each until there are most.
LEAST_BITS, MOST_BITS, BUCKET_BYTES = 18, 24, 6_000
#: Texts remembered in a task, so that its copies are entered once.
SEEN = 50_000
#: Rows of some hundred bytes up to which a table of linked classes, of n-grams over several components or of the ids of texts to compare is broadcast; above, both sides
#: of its join are shuffled.
BROADCAST_ROWS = 200_000
#: Entries under one n-gram above which the second round joins on pairs of n-grams.
HOT_ENTRIES = 1_000
#: Such n-grams in a prefix up to which a class meets others under each of them together with each later n-gram; with more, under neighbours in the order. The former has the stronger
#: filter (the first is the first that both have, so it stands early in both), the latter fewer entries.
HEAVY = 64
_PIVOTS = (np.arange(1, 64, dtype=np.uint64)) << np.uint64(58)

#: Bits of a set's parity bitmap, which tells unlike sets apart as long as their bound of unlike items is below half of it or so.
PARITY_BITS = 1024
_BITS = tuple(f"s{i}" for i in range(PARITY_BITS // 64))
_PROFILE = f"row_id long, text_id long, n int, a long, b long, {', '.join(f'{s} long' for s in _BITS)}, range int, uses binary"
#: Buckets whose counts a task writes as one row, as a power of two.
_RANGE_BITS = 12
_POSTING = "token long, a long, b long, n int, pos int"


def order_bits(text_bytes: int) -> int:
    """The number of buckets, as a power of two, for so much text."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, text_bytes) / BUCKET_BYTES))))


def _parity(items: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, each the parity of the count of items that fall on it: unlike bits never outnumber unlike items."""
    bits = np.bincount((items & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch], n_words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end a row for each range of buckets of the order table that has any n-gram: its counts, packed."""
    names = [x.split()[0] for x in _PROFILE.split(", ")]
    uses, waiting, held = np.zeros(1 << bits, dtype=np.int64), [], 0
    for batch in batches:
        rows = []
        for text in batch.column(2):
            items = shingles(text.as_py(), n_words)
            waiting.append((items >> np.uint64(64 - bits)).astype(np.int64))
            held += len(items)
            rows.append((len(items), *set_id(items), *_parity(items).tolist()))
        if held > 4 << LEAST_BITS:
            uses += np.bincount(np.concatenate(waiting), minlength=1 << bits)
            waiting, held = [], 0
        columns = list(zip(*rows, strict=True)) or [[]] * (3 + len(_BITS))
        none = pa.nulls(len(rows))
        own = [pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own, none.cast(pa.int32()), none.cast(pa.binary())], names=names)
    if waiting:
        uses += np.bincount(np.concatenate(waiting), minlength=1 << bits)
    ranges = uses.reshape(-1, 1 << _RANGE_BITS)
    used = np.flatnonzero(ranges.any(axis=1))
    none = pa.nulls(len(used))
    own = [none.cast(pa.int64())] * 2 + [none.cast(pa.int32())] + [none.cast(pa.int64())] * (2 + len(_BITS))
    yield pa.RecordBatch.from_arrays([*own, pa.array(used, pa.int32()), pa.array([ranges[r].tobytes() for r in used], pa.binary())], names=names)


def _summed(parts: pa.Table) -> pa.Table:
    """The counts of one range of buckets, a row each a task, added up."""
    total = np.zeros(1 << _RANGE_BITS, dtype=np.int64)
    for part in parts.column("uses"):
        total += np.frombuffer(part.as_py(), dtype=np.int64)
    return pa.table({"range": parts.column("range").slice(0, 1), "uses": pa.array([total.tobytes()], pa.binary())})


def _need(n: int, num: int, den: int) -> int:
    """The least overlap of a set of ``n`` items with any set that it links with."""
    return (num * n + den - 1) // den


def _postings(batches: Iterator[pa.RecordBatch], order, n_words: int, num: int, den: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The prefix of each set that the task has not seen yet, and one item after it where there is one."""
    rank, seen = order.value, set()
    shift, low = np.uint64(64 - bits), np.uint64((1 << (64 - bits)) - 1)
    for batch in batches:
        tokens, a_s, b_s, sizes, places = [], [], [], [], []
        for text in batch.column(0):
            items = shingles(text.as_py(), n_words)
            own = set_id(items)
            if not len(items) or own in seen:
                continue
            if len(seen) < SEEN:
                seen.add(own)
            k = min(len(items), len(items) - _need(len(items), num, den) + 2)
            keys = (rank[(items >> shift).astype(np.int64)].astype(np.uint64) << shift) | (items & low)
            if k < len(keys):
                keys = np.partition(keys, k - 1)[:k]
            keys.sort()
            tokens.append(keys.view(np.int64))
            a_s.append(np.full(k, own[0]))
            b_s.append(np.full(k, own[1]))
            sizes.append(np.full(k, len(items), dtype=np.int32))
            places.append(np.arange(k, dtype=np.int32))
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (tokens, a_s, b_s, sizes, places)], names=["token", "a", "b", "n", "pos"]
            )


def _beyond(num: int, den: int) -> int:
    """The size from which a set has enough common items with any that it links with for two of them to be neighbours in both; 0 if there is none.

    Of n and m items, the overlap has to be two more than the unlike items: 3 * overlap >= n + m + 2, and it is num * (n + m) / (num + den) at least.
    """
    spare = 2 * num - den  # 3 * overlap is more than n + m by spare / (num + den) of them, and n + m by (num + den) / den more than n alone
    return -(-2 * den // spare) if spare > 0 else 0


def _neighbours(batches: Iterator[pa.RecordBatch], order, n_words: int, num: int, den: int, bits: int) -> Iterator[pa.RecordBatch]:
    """As :func:`_postings`, entries of each two neighbours in the order of a set, as far as the first pair that both sets of a link have as neighbours can stand: up to
    place n - overlap + D + 1, largest for the smallest set that links."""
    rank, seen = order.value, set()
    shift, low = np.uint64(64 - bits), np.uint64((1 << (64 - bits)) - 1)
    for batch in batches:
        tokens, a_s, b_s, sizes, places = [], [], [], [], []
        for text in batch.column(0):
            items = shingles(text.as_py(), n_words)
            own, n = set_id(items), len(items)
            if n < _beyond(num, den) or own in seen:
                continue
            if len(seen) < SEEN:
                seen.add(own)
            least = num * n // den
            k = min(n, 2 * n + least - 3 * (num * (n + least) // (num + den)) + 3)
            keys = (rank[(items >> shift).astype(np.int64)].astype(np.uint64) << shift) | (items & low)
            if k < n:
                keys = np.partition(keys, k - 1)[:k]
            keys.sort()
            tokens.append(mix64(mix64(keys[:-1]) + keys[1:]).view(np.int64))
            a_s.append(np.full(k - 1, own[0]))
            b_s.append(np.full(k - 1, own[1]))
            sizes.append(np.full(k - 1, n, dtype=np.int32))
            places.append(np.arange(k - 1, dtype=np.int32))
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (tokens, a_s, b_s, sizes, places)], names=["token", "a", "b", "n", "pos"]
            )


def _linked(batches: Iterator[pa.RecordBatch], n_words: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are as alike as asked for."""
    kept_id, kept = None, None
    for batch in batches:
        keep = []
        nodes = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
        for v, left, right in zip(nodes, batch.column(4), batch.column(5), strict=True):
            if kept_id != v:
                kept_id, kept = v, shingles(right.as_py(), n_words)
            x, y = shingles(left.as_py(), n_words), kept
            both = len(x) + len(y)
            least = -(-num * both // (num + den))
            apart = np.abs(np.diff(np.searchsorted(x, _PIVOTS), prepend=0, append=len(x)) - np.diff(np.searchsorted(y, _PIVOTS), prepend=0, append=len(y)))
            keep.append(apart.sum() <= both - 2 * least and len(np.intersect1d(x, y, assume_unique=True)) >= least)
        yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))


def _may_link(num: int, den: int) -> Column:
    """Length and positional filters on two entries x and y of one n-gram."""
    c = F.col
    n, m = c("x.n").cast("long"), c("y.n").cast("long")
    least = F.ceil((num * (n + m)) / F.lit(num + den))
    return (
        (F.least(n, m) * den >= F.greatest(n, m) * num)
        & (F.least(n - c("x.pos"), m - c("y.pos")) >= least)
        & (c("x.pos") + c("y.pos") <= n + m - 2 * least)
    )


def _near(num: int, den: int) -> Column:
    """Length filter, and a filter on the places of two entries x and y of neighbours: what stands before them in one set only is unlike."""
    n, m = F.col("x.n").cast("long"), F.col("y.n").cast("long")
    least = F.ceil((num * (n + m)) / F.lit(num + den))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (F.abs(F.col("x.pos") - F.col("y.pos")) <= n + m - 2 * least)


def _same(*columns: str) -> Column:
    out = F.lit(True)
    for column in columns:
        out = out & (F.col(f"x.{column}") == F.col(f"y.{column}"))
    return out


def _node(side: str) -> Column:
    return F.struct(F.col(f"{side}.a").alias("a"), F.col(f"{side}.b").alias("b"))


def _sized(small: DataFrame) -> DataFrame:
    """A written table to broadcast where it has few enough rows."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _pairs(joined: DataFrame) -> DataFrame:
    """The distinct pairs of classes of joined entries x and y, the larger one first."""
    u, v = F.greatest(_node("x"), _node("y")), F.least(_node("x"), _node("y"))
    return joined.select(u["a"].alias("ua"), u["b"].alias("ub"), v["a"].alias("va"), v["b"].alias("vb")).distinct()


def ngram_jaccard_groups(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = 5,
    num: int = 80,
    den: int = 100,
    hot_entries: int = HOT_ENTRIES,
) -> DataFrame:
    """``(doc_id, text_id, n_shingles, component_id, leads, n_links)`` for each row of ``documents``.

    Two documents link when ``den * |A and B| >= num * |A or B|`` for their sets of distinct n-grams
    of lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``. A text of fewer words is one n-gram. Null, empty and
    wordless texts have an empty set and link with nothing. ``component_id`` is the smallest id
    reachable by links; ``n_links`` counts the links that were verified for the document's class, not those
    that its component made needless. Rows with equal texts share a class, rows that repeat an id each return,
    each judged by its own text, and a class in which all ids are null links with nothing. ``text_id`` is the text's 64-bit hash, and a row
    ``leads`` if its id and text_id are the smallest of its component, or its set is empty or its id null. ``hot_entries`` changes the way
    to the result, not the result. Other columns of the input, whatever their names, are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    texts = documents.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("body"))
    texts = texts.select("row_id", F.xxhash64("body").alias("text_id"), "body")
    bits = order_bits(texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0)

    both = texts.mapInArrow(partial(_profile, n_words=n_words, bits=bits), _PROFILE).withColumn("counts", F.col("range").isNotNull())
    both = scratch.save("profile", both, partitions=["counts"])  # profiles and counts are files of their own
    profile = both.where("not counts").drop("range", "uses", "counts")
    ranges = both.where("counts").select("range", "uses").groupBy("range").applyInArrow(_summed, "range int, uses binary")
    counts = np.zeros(1 << bits, dtype=np.int64)
    for row in ranges.toLocalIterator():  # 8 bytes a bucket
        counts[row["range"] << _RANGE_BITS : (row["range"] + 1) << _RANGE_BITS] = np.frombuffer(row["uses"], dtype=np.int64)
    rank = np.empty(1 << bits, dtype=np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(1 << bits, dtype=np.uint32)
    order = spark.sparkContext.broadcast(rank)

    told = F.when(F.col("row_id").isNotNull(), F.struct("row_id", "text_id"))
    classes = profile.where("n > 0").groupBy("a", "b").agg(F.min(told).alias("rep"), F.first("n").alias("n"), *(F.first(s).alias(s) for s in _BITS))
    classes = scratch.save("classes", classes.where("rep is not null").select("a", "b", "rep.row_id", "rep.text_id", "n", *_BITS))

    entries = texts.select("body").mapInArrow(partial(_postings, order=order, n_words=n_words, num=num, den=den, bits=bits), _POSTING)
    entries = scratch.save("entries", entries)
    # tables of their own, here and below: a join with an aggregate of the same key would keep that key's rows in one task
    common = entries.groupBy("token").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("token")
    common = scratch.save("common", common)
    shared = scratch.save("shared", entries.join(common, "token").repartition("token", "a").distinct())
    scratch.drop("entries", "common")
    need = F.expr(f"({num} * cast(n as long) + {den - 1}) div {den}")
    own = shared.where(F.col("pos") <= F.col("n") - need)  # without the item after the prefix

    leaders = own.groupBy("token").agg(F.min(F.struct("pos", "a", "b", "n")).alias("y")).select("token", "y.*")
    leaders = scratch.save("leaders", leaders)
    other = (F.col("x.a") != F.col("y.a")) | (F.col("x.b") != F.col("y.b"))
    first = scratch.save("first", _pairs(own.alias("x").join(leaders.alias("y"), _same("token") & other & _may_link(num, den))))
    scratch.drop("leaders")

    def verified(name: str, pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs: by bitmaps, then by the texts of those that are left."""
        facts = classes.select("a", "b", "n", *_BITS)
        sides = pairs
        for side in "uv":
            sides = sides.join(facts.select(*(F.col(c).alias(side + c) for c in facts.columns)), [f"{side}a", f"{side}b"])
        total = (F.col("un") + F.col("vn")).cast("long")
        differ = sum(F.bit_count(F.col(f"u{s}").bitwiseXOR(F.col(f"v{s}"))) for s in _BITS)
        sides = sides.where(differ <= total - 2 * F.ceil(num * total / F.lit(num + den))).select("ua", "ub", "va", "vb")
        sides = scratch.save(f"{name}-pairs", sides)
        wanted = sides.selectExpr("ua as a", "ub as b").unionByName(sides.selectExpr("va as a", "vb as b")).distinct()
        wanted = classes.join(wanted, ["a", "b"]).select("a", "b", "row_id", "text_id")
        if 2 * sides.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        bodies = texts.join(wanted, ["row_id", "text_id"]).groupBy("a", "b").agg(F.first("body").alias("body"))
        bodies = scratch.save(f"{name}-bodies", bodies)
        for side, text in (("u", "left"), ("v", "right")):
            sides = sides.join(bodies.select(F.col("a").alias(f"{side}a"), F.col("b").alias(f"{side}b"), F.col("body").alias(text)), [f"{side}a", f"{side}b"])
        sides = sides.select("ua", "ub", "va", "vb", "left", "right")
        links = sides.mapInArrow(partial(_linked, n_words=n_words, num=num, den=den), "ua long, ub long, va long, vb long")
        links = scratch.save(name, links.select(F.struct(F.col("ua").alias("a"), F.col("ub").alias("b")).alias("u"), F.struct(F.col("va").alias("a"), F.col("vb").alias("b")).alias("v")))
        scratch.drop(f"{name}-pairs", f"{name}-bodies")
        return links

    links = verified("links", first)
    labels = scratch.save("labels", components(links))
    placed = shared.join(_sized(labels.select("node.a", "node.b", "component")), ["a", "b"], "left").withColumn("component", F.coalesce("component", F.struct("a", "b")))
    placed = scratch.save("placed", placed)
    scratch.drop("shared")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (_node("x") < _node("y")))

    def opened(name: str, entries: DataFrame) -> DataFrame:
        """The entries under n-grams that several components have, with the component that has most of them."""
        sizes = entries.groupBy("token", "component").agg(F.count("*").alias("members"))
        mains = sizes.groupBy("token").agg(F.max(F.struct("members", "component")).alias("main"), F.count("*").alias("parts"), F.sum("members").alias("entries"))
        mains = mains.where("parts > 1").select("token", F.col("main.component").alias("main"), (F.col("entries") > hot_entries).alias("hot"))
        mains = scratch.save(f"{name}-mains", mains)
        out = scratch.save(name, entries.join(_sized(mains), "token"))
        scratch.drop(f"{name}-mains")
        return out

    def met(left: DataFrame, alike: Column) -> DataFrame:
        return _pairs(left.where("component <> main").alias("x").join(left.alias("y"), _same("token") & apart & alike))

    inside = opened("open", placed.where(F.col("pos") <= F.col("n") - need))
    second = met(inside.where(~F.col("hot") | (need <= 1)), _may_link(num, den))  # a set of one n-gram shares no two
    beyond = _beyond(num, den)
    crowded = inside.where("hot").groupBy("a", "b").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.count("*").alias("n_hot"))
    crowded = crowded.withColumn("heavy", (F.col("n_hot") > HEAVY) & F.lit(beyond > 0) & (F.col("n") >= 2 * beyond))
    crowded = scratch.save("crowded", crowded.select("a", "b", "component", "heavy"))
    if not crowded.isEmpty():
        # the first two n-grams that both sets of a link have: the second lies in a prefix that is one longer
        later = placed.select("a", "b", F.col("token").alias("token2"), F.col("pos").alias("pos2"))
        light = inside.where("hot").join(_sized(crowded.where("not heavy").select("a", "b")), ["a", "b"]).join(later, ["a", "b"]).where("pos2 > pos")
        light = scratch.save("light", light.withColumn("token", F.xxhash64("token", "token2")).drop("token2", "pos2"))
        second = second.unionByName(met(light, _may_link(num, den))).distinct()
    if not crowded.where("heavy").isEmpty():
        wanted = crowded.join(classes, ["a", "b"]).select("row_id", "text_id")
        bodies = texts.join(wanted, ["row_id", "text_id"], "left_semi").select("body")
        paired = bodies.mapInArrow(partial(_neighbours, order=order, n_words=n_words, num=num, den=den, bits=bits), _POSTING)
        paired = scratch.save("paired", paired.repartition("token", "a").distinct())
        twice = opened("twice", paired.join(_sized(crowded), ["a", "b"]))
        second = second.unionByName(met(twice, _near(num, den) & (F.col("x.heavy") | F.col("y.heavy")))).distinct()
    second = second.join(first, ["ua", "ub", "va", "vb"], "left_anti")
    second = scratch.save("second", second)
    scratch.drop("placed", "open", "first", "crowded", "light", "paired", "twice")
    more = verified("more", second)
    all_links = links.unionByName(more)
    labels = labels if more.isEmpty() else components(all_links)
    degree = all_links.selectExpr("u as node").unionByName(all_links.selectExpr("v as node")).groupBy("node").agg(F.count("*").alias("n_links"))
    members = classes.select("a", "b", "row_id", "text_id", F.struct("a", "b").alias("node")).join(labels, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    least = scratch.save("least", members.groupBy("component").agg(F.min(F.struct("row_id", "text_id")).alias("leader")))
    named = members.select("a", "b", "node", "component").join(least, "component").join(degree, "node", "left")
    named = scratch.save("named", named.select("a", "b", "leader", "n_links"))
    scratch.drop("classes", "links", "more", "second", "labels", "least")
    linked = F.col("n") > 0
    leads = ~linked | F.col("row_id").isNull() | F.struct("row_id", "text_id").eqNullSafe(F.col("leader"))
    return profile.join(named, ["a", "b"], "left").select(
        F.col("row_id").alias("doc_id"),
        "text_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(linked, F.col("leader.row_id")).otherwise(F.col("row_id")).alias("component_id"),
        leads.alias("leads"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
