"""SimHash near-dedup with BK-trees.

Distinct fingerprints are cut into blocks of bits.  Two fingerprints that
differ in at most r bits agree in all but r blocks, so each fingerprint goes to
one bucket for every choice of the other blocks.  Within a bucket it is dealt to
one shard; a shard's fingerprints form a BK-tree, whose children are keyed by
their Hamming distance to the parent, and the bucket's other fingerprints
search it along the edges within the radius.  A shard's tree is bounded and
travels to the tasks that search it with the shuffle: a Spark broadcast of all
trees would grow with the corpus.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Union, by_group, cut, pick, with_result, written
from .components import components

BITS = 64
SEED = 42
#: Fingerprints in a shard's tree, at most; a bucket with more has several trees.
SHARD = 2_048


def fingerprint(text: str, words: int) -> int:
    """Bit i is set if it is in over half the hashes of the text's shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased; repeated
    shingles count again; fewer words make one shingle; no words give 0.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(found) - words + 1
    if not found:
        return 0
    if n < 2:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    ends = ends[words - 1:].tolist()
    for i in range(0, n, 65_536):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[i:i + 65_536], ends[i:i + 65_536])), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int) -> tuple[DataFrame, str]:
    """``docs`` with the fingerprint of ``text`` as a signed long; and that column's name."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return with_result(docs, of, "text")


class BkTree:
    """BK-tree: a child is keyed by its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self._children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        values, children = self.values, self._children
        values.append(value)
        children.append({})
        new, at = len(values) - 1, 0
        while at != new:
            at = children[at].setdefault((value ^ values[at]).bit_count(), new)

    def search(self, value: int, radius: int) -> list[int]:
        """Places of the values within the radius; only edges that can lead there are followed."""
        values, children = self.values, self._children
        found, open_ = [], [0] if values else []
        while open_:
            at = open_.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                if len(below) <= 2 * radius + 1:
                    open_ += [c for key, c in below.items() if -radius <= key - d <= radius]
                else:
                    open_ += [below[key] for key in range(d - radius, d + radius + 1) if key in below]
        return found


def tile_links(tree_values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the same classes as all pairs (tree value, query) in the radius do."""
    tree = BkTree()
    for v in tree_values:
        tree.add(v)
    values = tree_values + queries
    union = Union(len(values))
    for i, q in enumerate(queries, len(tree_values)):
        for at in tree.search(q, radius):
            union.add(at, i)
    return [(values[a], values[b]) for a, b in union.forest()]


def own_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """The same for all pairs among ``values``: each searches those before it."""
    tree, union = BkTree(), Union(len(values))
    for i, v in enumerate(values):
        for at in tree.search(v, radius):
            union.add(at, i)
        tree.add(v)
    return [(values[a], values[b]) for a, b in union.forest()]


def _keys(radius: int, blocks: int) -> list[int]:
    """Masks of the bits in every choice of ``blocks - radius`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [sum(m) for m in itertools.combinations(masks, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(values: DataFrame, radius: int, blocks: int | None = None, shard_size: int = SHARD) -> DataFrame:
    """Links (a, b) that join the distinct longs of ``values`` (one column, f) as
    all pairs within ``radius`` bits do.

    ``blocks`` (by default radius + 2) trades copies for smaller buckets: each
    value goes to C(blocks, radius) buckets, of the bits in blocks - radius blocks.
    """
    masks = _keys(radius, blocks or radius + 2)
    keyed = values.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("choice", "key"))
    sizes = cut(keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                .select("choice", "key", F.ceil(F.col("n") / shard_size).cast("int").alias("shards")))
    # Adaptive execution splits the rows of a large bucket in this join.
    keyed = keyed.join(sizes, ["choice", "key"]).withColumn("shard", F.pmod(F.xxhash64("f"), F.col("shards")).cast("int"))
    # In tile (i, j), i <= j, the values of shard j search the tree of shard i.
    tiles = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda other: F.struct(
        F.least(F.col("shard"), other).alias("i"), F.greatest(F.col("shard"), other).alias("j")))
    tiled = keyed.withColumn("tile", F.explode(tiles)).select("f", "shard", "choice", "key", "tile.i", "tile.j")

    def search(tile: pa.Table) -> pa.RecordBatch:
        values, shard = tile.column("f").to_numpy().view(np.uint64), tile.column("shard").to_numpy()
        i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        if i == j:
            found = own_links(values.tolist(), radius)
        else:
            found = tile_links(values[shard == i].tolist(), values[shard == j].tolist(), radius)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return by_group(tiled, ["choice", "key", "i", "j"], search, "a bigint, b bigint")


def groups(values: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """(f, class) of the fingerprints (column f) that have links."""
    values = written(values.select("f").distinct(), "distinct_fingerprints")
    members = components(links(values, radius, blocks))
    return members.select(F.col("node").alias("f"), F.col("component").alias("class"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    Documents link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest doc_id that links reach, null only if all of the group are null.
    Null and empty texts have fingerprint 0 and link like any other.  Equal rows
    are separate documents.
    """
    rows, name = fingerprints(pick(docs, "doc_id", "text"), words)
    rows = written(rows.select("doc_id", F.col(name).alias("f")), "fingerprints")
    # One row per fingerprint first, however many documents share it.
    per = rows.groupBy("f").agg(F.min("doc_id").alias("smallest"))
    per = written(per.join(groups(rows, radius), "f", "left").withColumn("class", F.coalesce("class", "f")), "fingerprint_classes")
    first = cut(per.groupBy("class").agg(F.min("smallest").alias("component_id")))
    named = written(per.select("f", "class").join(first, "class").select("f", "component_id"), "fingerprint_components")
    return rows.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One document of each group that ``near_duplicates`` links, with all its columns.

    Kept is the one with the smallest doc_id, null before all others; of rows that
    repeat an id, the one with the smallest hash of all its columns; of equal rows, one.
    Map columns take no part in that hash.
    """
    columns = docs.columns
    flat, f = fingerprints(docs, words)
    names = [f"_c{i}" for i in range(len(columns))]
    flat = flat.toDF(*names, "_f")
    doc_id = F.col(f"_c{columns.index('doc_id')}")
    plain = [F.col(n) for n in names if flat.schema[n].dataType.typeName() != "map"]
    # Which columns are null counts too: the hash itself passes over nulls.
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in plain])
    row = F.concat(F.hex(F.xxhash64(*plain, nulls)), F.hex(F.xxhash64(nulls, *plain)))
    slim = written(flat.select(doc_id.alias("id"), row.alias("row"), F.col("_f").alias("f")), "document_fingerprints")
    per = slim.groupBy("f").agg(F.min(F.struct("id", "row")).alias("first"))
    per = per.join(groups(slim, radius), "f", "left").withColumn("class", F.coalesce("class", "f"))
    kept = written(per.groupBy("class").agg(F.min("first").alias("first")).select("first.id", "first.row"), "kept_documents")
    flat = flat.drop("_f").withColumns({"_id": doc_id, "_row": row})
    stays = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_row") == F.col("row"))
    # The join leaves equal rows together, so repeats go without another shuffle.
    return flat.join(kept, stays, "left_semi").dropDuplicates(["_id", "_row"]).drop("_id", "_row").toDF(*columns)
