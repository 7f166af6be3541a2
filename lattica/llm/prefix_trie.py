"""Conversation prefix trie with the Euler-tour technique.

Every distinct sequence of the first d turns of some conversation is a node.  It
is named by its depth and a 128-bit sum of hashes of its turns, each hashed with
its place, so names come from prefix sums along a conversation, which are computed
over range partitions: a conversation of any length spreads over many tasks.

Nodes are numbered by (parent, smallest member), so that siblings have consecutive
numbers.  Each has an enter arc and an exit arc; the tour goes from an enter arc
to the first child's or back out, and from an exit arc to the next sibling's enter
arc or the parent's exit arc.  The tour is ranked as a linked list: rounds of
splicing out arcs whose coin shows tails and whose predecessor's shows heads, until
a bounded number is left, which one task walks; then the spliced arcs are put back
in the opposite order.  All rounds together handle some multiple of the arcs.

With the arcs in tour order, a subtree's leaves and savings are the difference of
two prefix sums: those at its exit arc and before its enter arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import shuffle_partitions

from .common import cut, pick, written

#: Arcs that are left to be walked by one task, at most.
WALKED = 1 << 15
#: Arcs or ids of a block, whose sums are combined by one window over all blocks.
BLOCK = 1 << 13
#: 2^9 ids at most are joined to one row before a digest is continued with them.
ID_BITS = 9
#: Four hashes of 32 bits name a prefix; as longs, their sums do not overflow.
_LANES = ("s0", "s1", "s2", "s3")
_PARENT = ("p0", "p1", "p2", "p3")


# --------------------------------------------------------------- prefix sums
def _scanned(rows: DataFrame, part: str, order: list[str], values: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``_at`` (1-based place in ``part`` by ``order``) and sums of
    ``values`` up to each row, in the columns of ``values``.

    Range partitions are scanned by themselves; the totals of the earlier
    partitions of a part are added.  Written once, in order.
    """
    n = shuffle_partitions(rows.sparkSession)
    keep = [c for c in rows.columns if c not in order or c == part]
    ranged = rows.repartitionByRange(n, part, *order).sortWithinPartitions(part, *order).select(*keep, F.monotonically_increasing_id().alias("_seq"))
    ranged = cut(ranged).withColumn("_p", F.shiftright("_seq", 33).cast("int"))
    totals = ranged.groupBy(part, "_p").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = totals.select(part, "_p", "_first", carried("_n").alias("_c"), *[carried(f"_t_{v}").alias(f"_c_{v}") for v in values])
    upto = Window.partitionBy(part, "_p").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.withColumns({v: F.sum(v).over(upto) for v in values}) if values else ranged
    out = sums.join(totals, [part, "_p"]).withColumn("_at", F.col("_seq") - F.col("_first") + 1 + F.col("_c"))
    return out.withColumns({v: F.col(v) + F.col(f"_c_{v}") for v in values}).drop("_seq", "_p", "_first", "_c", *[f"_c_{v}" for v in values])


# -------------------------------------------------------------------- turns
def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words): the turns of each conversation, numbered from 1.

    Turns are ordered by turn (null first), then by role and text; a null role or
    text is empty.  Rows without a conv_id take no part.
    """
    raw = pick(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    raw = raw.filter("conv_id is not null")
    # The role's length keeps ("ab", "c") and ("a", "bc") apart.
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    digest = F.substring(F.unhex(digest), 1, 16)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    ranked = _scanned(raw.withColumns({"digest": digest, "words": words}), "conv_id", ["turn", "role", "text"], ())
    return ranked.select("conv_id", F.col("_at").alias("at"), "digest", "words")


def _mixed(depth: Column, digest: Column) -> list[Column]:
    """Four 32-bit hashes of a turn at a depth."""
    two = [F.xxhash64(F.lit(seed), depth.cast("long"), digest) for seed in (1, 2)]
    low = F.lit((1 << 32) - 1)
    return [c for h in two for c in (F.shiftrightunsigned(h, 32), h.bitwiseAND(low))]


def with_names(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, at, digest, words) with the name of the prefix that each
    ends (s0 to s3), and of the one before it (p0 to p3)."""
    own = _mixed(F.col("at"), F.col("digest"))
    rows = turns.withColumns(dict(zip(_LANES, own)))
    named = _scanned(rows, "conv_id", ["at"], _LANES).withColumnRenamed("_at", "at")
    again = _mixed(F.col("at"), F.col("digest"))
    return named.withColumns({p: F.col(s) - h for p, s, h in zip(_PARENT, _LANES, again)})


def trie_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of conversations' prefixes and, for every conversation, the node it ends at.

    ``turns``: conv_id, at (1 to the conversation's length), digest, words.  ``convs``:
    conv_id, length, of every conversation, also the turnless.  Nodes: id, depth,
    conv_id (smallest member), n_convs, words (of the last text), the names of the
    node and its parent; siblings have consecutive ids by smallest member, and
    the root has id 0.
    """
    named = written(with_names(turns), "named_prefixes")
    zero = [F.lit(0).cast("long").alias(c) for c in (*_LANES, *_PARENT)]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    # The first turn of a hot prefix is pre-aggregated in every map task.
    found = named.groupBy(F.col("at").cast("int").alias("depth"), *_LANES).agg(
        *[F.min(p).alias(p) for p in _PARENT], F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    nodes = root.unionByName(found)
    n = shuffle_partitions(nodes.sparkSession)
    order = ["depth", *_PARENT, "conv_id"]
    ranged = cut(nodes.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_p", F.shiftright("_seq", 33).cast("int"))
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    numbered = ranged.join(F.broadcast(offsets), "_p").withColumn("id", F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before"))
    ends = named.join(convs, "conv_id").filter("at = length").select("conv_id", F.col("at").cast("int").alias("depth"), *_LANES)
    ends = ends.unionByName(convs.filter("length = 0").select("conv_id", F.lit(0).alias("depth"), *zero[:4]))
    return written(numbered.drop("_p", "_seq", "_before"), "trie_nodes"), ends


# ----------------------------------------------------------------- list ranking
def _coin(arc: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), F.col(arc)).bitwiseAND(F.lit(1)) == 1


def list_ranks(arcs: DataFrame, walked: int = WALKED) -> DataFrame:
    """(arc, rank from 0) of a linked list: rows (arc, next), next null at the end.

    A round splices out the arcs of coin 1 whose predecessor has coin 0: about a
    quarter.  What is left in the end is walked by one task (at most ``walked`` arcs).
    """
    list_ = cut(arcs.select("arc", "next", F.lit(1).cast("long").alias("gap")))  # gap: arcs from this to the next
    n, number, spliced = list_.count(), 0, []
    while n > walked:
        heads, tails = ~_coin("arc", number), _coin("arc", number)
        goes = F.col("next").isNotNull() & _coin("next", number)
        after = list_.filter(tails).select(F.col("arc").alias("next"), F.col("next").alias("next2"), F.col("gap").alias("gap2"))
        joined = cut(list_.filter(heads & goes).join(after, "next"))
        gone = joined.select(F.col("next").alias("arc"), F.col("arc").alias("before"), "gap")
        kept = joined.select("arc", F.col("next2").alias("next"), (F.col("gap") + F.col("gap2")).alias("gap"))
        # A head whose next stays is as before; a tail stays unless a head splices it out.
        rest = list_.filter(tails).join(gone.select("arc"), "arc", "left_anti").unionByName(list_.filter(heads & ~goes))
        spliced.append(gone)
        list_ = cut(kept.unionByName(rest))
        n, number = list_.count(), number + 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if batches else None
        after, gaps = {}, {}
        for arc, nxt, gap in zip(*(table.column(c).to_pylist() for c in ("arc", "next", "gap"))):
            after[arc], gaps[arc] = nxt, gap
        heads = after.keys() - {x for x in after.values() if x is not None}
        order, ranks, at, rank = [], [], next(iter(heads), None), 0
        while at is not None:
            order.append(at)
            ranks.append(rank)
            at, rank = after[at], rank + gaps[at]
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(ranks, pa.int64())], names=["arc", "rank"])

    ranks = cut(list_.coalesce(1).mapInArrow(_nonempty(walk), "arc bigint, rank bigint"))
    for gone in reversed(spliced):
        back = gone.join(ranks.withColumnRenamed("arc", "before"), "before").select("arc", (F.col("rank") + F.col("gap")).alias("rank"))
        ranks = cut(ranks.unionByName(back))
    return ranks


def _nonempty(walk):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from walk(rows)
    return run


# ------------------------------------------------------------------ the tour
def tour_arcs(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """(arc, next) of the tour: 2 id enters a node, 2 id + 1 leaves it.

    ``families``: id, first, last (ids of the children) of every node with children.
    """
    arcs = [
        # Into the first child, or out of a node without children.
        nodes.select("id").join(families.select("id", "first"), "id", "left")
        .select((2 * F.col("id")).alias("arc"), F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1).alias("next")),
        # Out of the last child, out of its parent.
        families.select((2 * F.col("last") + 1).alias("arc"), (2 * F.col("id") + 1).alias("next")),
        # Out of any other child, into its next sibling.
        nodes.filter("depth > 0").select("id").join(families.select(F.col("last").alias("id")), "id", "left_anti")
        .select((2 * F.col("id") + 1).alias("arc"), (2 * F.col("id") + 2).alias("next")),
        # Out of the root: the end.
        nodes.filter("depth = 0").select((2 * F.col("id") + 1).alias("arc"), F.lit(None).cast("long").alias("next")),
    ]
    return reduce(DataFrame.unionByName, arcs)


def subtree_sums(nodes: DataFrame, ranks: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(id, values) summed over each node's subtree, from prefix sums along the tour."""
    at = nodes.select("id", *[v.cast("long").alias(c) for c, v in values.items()])
    # A node's values stand at its enter arc; an exit arc brings nothing.
    arcs = ranks.select((F.shiftright("arc", 1)).alias("id"), (F.col("arc") % 2 == 0).alias("enter"), "rank").join(at, "id")
    arcs = cut(arcs.select("id", "enter", "rank", *[F.when(F.col("enter"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in values])
               .withColumn("block", F.floor(F.col("rank") / BLOCK).cast("long")))
    blocks = arcs.groupBy("block").agg(*[F.sum(c).alias(c) for c in values])  # one row for each BLOCK arcs
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{c}") for c in values])
    upto = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = arcs.select("id", "enter", "block", *[F.col(c).alias(f"_v_{c}") for c in values], *[F.sum(c).over(upto).alias(c) for c in values]).join(blocks, "block")
    sign = F.when(F.col("enter"), F.lit(-1)).otherwise(F.lit(1))
    # Up to the exit arc, without what came before the enter arc.
    return summed.groupBy("id").agg(*[F.sum(sign * (F.col(c) + F.col(f"_b_{c}") - F.when(F.col("enter"), F.col(f"_v_{c}")).otherwise(F.lit(0)))).alias(c) for c in values])


def trie(nodes: DataFrame) -> DataFrame:
    """``nodes`` of ``trie_nodes`` with parent_conv_id, n_children, n_leaves and saved_tokens."""
    key = ["depth", *_LANES]
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(s) for p, s in zip(_PARENT, _LANES)]).agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n_children"))
    families = cut(nodes.select("id", "conv_id", *key).join(children, key).select("id", "conv_id", "first", "last", "n_children", *key))
    ranks = list_ranks(tour_arcs(nodes, families))
    sums = subtree_sums(nodes.join(families.select("id", "n_children"), "id", "left"), ranks, {
        "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    # Both sides are plain shuffles, which adaptive execution splits for a parent of very many children.
    parents = families.select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(p) for s, p in zip(_LANES, _PARENT)], F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(parents, ["depth", *_PARENT], "left").join(families.select("id", "n_children"), "id", "left").join(sums, "id")
            .withColumn("n_children", F.coalesce("n_children", F.lit(0))))


# ---------------------------------------------------------------------- ends
def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, s0 to s3, ends_sha256): SHA-256 of the ids of the conversations that
    end at a node, decimal, ascending, joined by commas.

    Up to 2^``ID_BITS`` ids are joined to one text over range partitions first, so that
    the task that continues a node's digest reads few rows, one batch at a time.
    """
    key = ["depth", *_LANES]
    n = shuffle_partitions(ends.sparkSession)
    ordered = ends.select(*key, "conv_id").repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    place = ordered.withColumn("_seq", F.monotonically_increasing_id())
    # Consecutive rows of a partition; a node's ids may share a group with others', hence the key.
    joined = place.groupBy(*key, F.shiftright("_seq", ID_BITS).alias("_g")).agg(
        F.min("conv_id").alias("first"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state, done = None, None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key))
            for k, ids in zip(keys, batch.column("ids").to_pylist()):
                if k != open_:
                    if open_ is not None:
                        done.append((*open_, state.hexdigest()))
                    open_, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield _rows(done)
                done = []
        if open_ is not None:
            yield _rows([(*open_, state.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done))
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*key, "ends_sha256"])

    schema = "depth int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, ends_sha256 string"
    return joined.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "ids").mapInArrow(digest, schema)


# ------------------------------------------------------------------- operator
def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of conversations.

    ``turns``: conv_id, at (numbered from 1 without gaps), digest (anything that names role and
    text), words (of the text); ``convs``: conv_id, length, one row for each
    conversation, the turnless with length 0.  Output: conv_id (smallest member),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Without conversations there is no node.
    """
    nodes, ends = trie_nodes(turns, convs)
    digests = written(ends_digest(ends), "ends_digests")
    none = hashlib.sha256(b"").hexdigest()
    out = trie(nodes).join(digests, ["depth", *_LANES], "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, length) of the conversations of ``turns``."""
    return turns.groupBy("conv_id").agg(F.max("at").alias("length"))


def borrowed_turns(turns: DataFrame, convs: DataFrame, source: Column, n: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``n`` turns are those of the conversation ``source``
    (all if it has fewer, none if it is absent) and whose others are their own.

    ``source`` and ``n`` are columns of conv_id; ``n`` is at most ``most``.  Returns
    turns and convs for ``prefix_trie``.
    """
    plan = convs.select("conv_id", "length", source.alias("source"), n.cast("int").alias("n"))
    first = turns.filter(F.col("at") <= most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "words"))).alias("given"))
    plan = plan.join(first.withColumnRenamed("conv_id", "source"), "source", "left")
    plan = plan.withColumn("given", F.filter("given", lambda t: t["at"] <= F.col("n")))
    plan = plan.withColumn("given", F.coalesce("given", F.array().cast(plan.schema["given"].dataType)))
    plan = written(plan.select("conv_id", "length", "n", "given"), "borrowed_turns")
    own = turns.join(plan.select("conv_id", "n", F.size("given").alias("m")), "conv_id").filter(F.col("at") > F.col("n"))
    own = own.select("conv_id", (F.col("at") - F.col("n") + F.col("m")).alias("at"), "digest", "words")
    given = plan.select("conv_id", F.inline("given")).select("conv_id", "at", "digest", "words")
    rebuilt = plan.select("conv_id", (F.greatest(F.col("length") - F.col("n"), F.lit(0)) + F.size("given")).alias("length"))
    return given.unionByName(own), rebuilt
