"""Embedding near-dedup by sorted projection passes.

Every pass draws random directions, concatenates the signs of a vector's
projections on them to one key, and sorts all vectors by it: near vectors agree
in the first bits and stand near each other.  Neighbours in a window are
compared exactly, and the pairs found over all passes are united.  Two vectors
whose angle is t agree in the first b bits with probability (1 - t / pi)^b.  The
number of passes follows from the number of vectors, so that a linked pair
agrees in b bits in some pass with probability ``RECALL`` at least.  Prefixes
of b bits that at most a window's vectors share lie within the window; the members
of more crowded ones are compared in bounded tiles, except with those of their
own class.  So the recall holds for every pair, however the vectors crowd.

Inside the classes found, all pairs are then compared in bounded tiles, so that
the links of a dense class are all counted however large it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Union, by_group, cut, pick, written
from .components import components

#: Passes, at least.
PASSES = 16
BITS = 60
#: Least probability that a pair of the least cosine is compared.
RECALL = 0.999
#: Vectors that a vector is compared with on each side in a pass, at least.
WINDOW = 128
#: Vectors of one side of a tile.
TILE = 1_024


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, as unit vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny values stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passes_and_depth(n: int, least: float, window: int, passes: int | None = None) -> tuple[int, int]:
    """Passes for ``n`` vectors, and the bits of a prefix in which a pair of cosine
    ``least`` agrees in one of them with probability ``RECALL``."""
    same = 1 - np.arccos(np.clip(least, -1, 1)) / np.pi
    missed = lambda depth, k: (1 - same ** depth) ** k
    if passes is None:
        # Evenly spread vectors leave a quarter of a window to a prefix.
        depth, passes = min(BITS, max(0, int(np.ceil(np.log2(max(1, 4 * n / window)))))), PASSES
        while missed(depth, passes) > 1 - RECALL:
            passes += 1
    return passes, max(d for d in range(BITS + 1) if missed(d, passes) <= 1 - RECALL)


def _directions(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([dim, number, 2024]).standard_normal((dim, BITS))


def _keyed(vectors: DataFrame, passes: int) -> DataFrame:
    """Every vector once for each pass: pass, dim, key, node, vec."""

    def project(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                mine = table.filter(pa.array(dims == dim))
                x = _matrix(mine.column("vec"), dim)
                for number in range(passes):
                    bits = (x @ _directions(dim, number) > 0).astype(np.int64)
                    key = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), number, np.int32)), mine.column("dim").combine_chunks(), pa.array(key),
                         mine.column("node").combine_chunks(), mine.column("vec").combine_chunks()],
                        names=["pass", "dim", "key", "node", "vec"])

    return vectors.select("node", "dim", "vec").mapInArrow(project, "pass int, dim int, key bigint, node string, vec array<double>")


def _window_links(least: float, window: int):
    """Links among neighbours in the sorted rows of a partition, as a forest for
    each block; and the rows at its ends, for the windows across its border."""

    def compare(table: pa.Table):
        n = table.num_rows
        nodes = table.column("node").to_pylist()
        runs = np.ones(n + 1, bool)
        number, dims = table.column("pass").to_numpy(), table.column("dim").to_numpy()
        runs[1:-1] = (number[1:] != number[:-1]) | (dims[1:] != dims[:-1])
        at = np.flatnonzero(runs)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            x = _matrix(table.column("vec").slice(lo, hi - lo), int(dims[lo]))
            for i in range(0, hi - lo, window):
                # Rows i..i+window against themselves and the next window: every
                # pair at most ``window`` places apart is in some block.
                near = x[i:i + window] @ x[i:i + 2 * window].T >= least
                a, b = np.nonzero(np.triu(near, 1))
                if len(a):
                    union = Union(min(2 * window, hi - lo - i))
                    for p, q in zip(a.tolist(), b.tolist()):
                        union.add(p, q)
                    for p, q in union.forest():
                        yield nodes[lo + i + p], nodes[lo + i + q]

    return compare


def window_links(vectors: DataFrame, least: float, passes: int, window: int) -> DataFrame:
    """Links (a, b) between nodes of cosine ``least`` or more that meet in a window."""
    spark = vectors.sparkSession
    n = vectors.count() * passes
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (4 * window)))
    ordered = (_keyed(vectors, passes).repartitionByRange(parts, "pass", "dim", "key", "node")
               .sortWithinPartitions("pass", "dim", "key", "node"))
    compare = _window_links(least, window)
    schema = "a string, b string, side int, part int, place bigint, pass int, dim int, node string, vec array<double>"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64())]

    def batch(n_rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n_rows, t) for c, t in zip(names, types)], names=names)

    def links_of(table: pa.Table) -> pa.RecordBatch:
        found = list(compare(table))
        return batch(len(found), a=pa.array([a for a, _ in found], pa.string()), b=pa.array([b for _, b in found], pa.string()))

    def border(rows: pa.Table, side: int, part: int, first: int) -> pa.RecordBatch:
        k = rows.num_rows
        rows = rows.combine_chunks()
        own = {c: rows.column(c).chunk(0) for c in ("pass", "dim", "node", "vec")}
        return batch(k, side=pa.array([side] * k, pa.int32()), part=pa.array([part] * k, pa.int32()), place=pa.array(range(first, first + k), pa.int64()), **own)

    def scan(batches):
        from pyspark import TaskContext

        part, seen, tail = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            if seen < window:
                yield border(table.slice(0, window - seen), 1, part - 1, seen)
            seen += table.num_rows
            # The last window of the batch before is compared with this one too.
            table = table if tail is None else pa.concat_tables([tail, table])
            yield links_of(table)
            tail = table.slice(max(0, table.num_rows - window))
        if tail is not None:
            yield border(tail, 0, part, 0)

    rows = written(ordered.mapInArrow(scan, schema), "window_links")

    def across(table: pa.Table) -> pa.RecordBatch:
        found = list(compare(table))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["a", "b"])

    # At most two windows for each border between partitions.
    borders = rows.filter("side is not null").select("part", "side", "place", "pass", "dim", "node", "vec")
    met = by_group(borders, ["part"], lambda t: across(t.sort_by([("side", "ascending"), ("place", "ascending")])), "a string, b string")
    return rows.filter("a is not null").select("a", "b").unionByName(met)


def crowded_links(vectors: DataFrame, members: DataFrame, least: float, passes: int, window: int, depth: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between classes, among vectors that share a prefix with more than a window's."""
    group = ["pass", "dim", "prefix"]
    keys = _keyed(vectors, passes).select("pass", "dim", F.shiftright("key", BITS - depth).alias("prefix"), "node")
    keys = written(keys, "prefixes")
    crowds = cut(keys.groupBy(*group).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > window).select(*group))
    rows = keys.join(crowds, group).join(members, "node", "left").withColumn("class", F.coalesce("component", "node"))
    rows = written(rows.select(*group, "node", "class"), "crowded_prefixes")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("m"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    sizes = cut(sizes.filter("lo != hi").select(*group, F.ceil(F.col("m") / tile).cast("int").alias("shards")))
    rows = rows.join(sizes, group).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda other: F.struct(
        F.least(F.col("shard"), other).alias("i"), F.greatest(F.col("shard"), other).alias("j")))
    rows = rows.join(vectors.select("node", "vec"), "node").withColumn("tile", F.explode(others))
    rows = rows.select(*group, "tile.i", "tile.j", "shard", "node", F.xxhash64("class").alias("class"), "vec")

    def compare(table: pa.Table) -> pa.RecordBatch:
        shard, label = table.column("shard").to_numpy(), table.column("class").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = _matrix(table.column("vec"), table.column("dim")[0].as_py())
        order = np.argsort(label, kind="stable")
        left, right = order[shard[order] == i], order[shard[order] == j]
        union = Union(len(x))
        for lo in range(0, len(left), 256):
            part = left[lo:lo + 256]
            # A block of one class meets the others only.
            to = right if label[part[0]] != label[part[-1]] else right[label[right] != label[part[0]]]
            p, q = np.nonzero((x[part] @ x[to].T >= least) & (label[part][:, None] != label[to]))
            for a, b in zip(part[p].tolist(), to[q].tolist()):
                union.add(a, b)
        nodes, found = table.column("node").to_pylist(), union.forest()
        return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.string()), pa.array([nodes[b] for _, b in found], pa.string())], names=["a", "b"])

    return by_group(rows, [*group, "i", "j"], compare, "a string, b string")


def count_links(vectors: DataFrame, members: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """(node, links): how many vectors, with copies, each node of a class links with directly."""
    sizes = cut(members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
                .select("component", F.ceil(F.col("n") / tile).cast("int").alias("shards")))
    placed = cut(members.join(sizes, "component").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")))
    others = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda other: F.struct(
        F.least(F.col("shard"), other).alias("i"), F.greatest(F.col("shard"), other).alias("j")))
    rows = (vectors.join(placed, "node").withColumn("tile", F.explode(others))
            .select("component", "tile.i", "tile.j", "shard", "node", "dim", "vec", "copies"))

    def count(table: pa.Table) -> pa.RecordBatch:
        shard = table.column("shard").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = _matrix(table.column("vec"), table.column("dim")[0].as_py())
        copies = table.column("copies").to_numpy()
        links = np.zeros(len(x), np.int64)
        left, right = np.flatnonzero(shard == i), np.flatnonzero(shard == j)
        for lo in range(0, len(left), 256):
            part = left[lo:lo + 256]
            near = x[part] @ x[right].T >= least
            if i == j:
                near[np.arange(len(part)), lo + np.arange(len(part))] = False
            links[part] += near @ copies[right]
            if i != j:
                links[right] += copies[part] @ near
        return pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), pa.array(links)], names=["node", "links"])

    parts = by_group(rows, ["component", "i", "j"], count, "node string, links bigint")
    return parts.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(embeddings: DataFrame, least: float = 0.95, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths.  Equal vectors are one
    node with copies.  ``component_id`` is the smallest vec_id that links reach,
    null only if all of the class are null; equal rows are separate vectors.
    ``passes`` follow from the number of vectors unless given.
    """
    raw = pick(embeddings, "vec_id", "embedding")
    vec = F.col("embedding").cast("array<double>")
    fits = (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = raw.select("vec_id", vec.alias("vec"))
    # 0.0 and -0.0 are one value; two hashes of it name a vector.
    same = F.transform("vec", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))
    named = F.concat_ws("-", F.hex(F.xxhash64(same)), F.hex(F.xxhash64(F.lit(1), same)))
    rows = rows.withColumn("node", F.when(F.coalesce(fits, F.lit(False)), named))
    vectors = written(rows.filter("node is not null").groupBy("node").agg(
        F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("smallest"))
        .withColumn("dim", F.size("vec")), "vectors")
    passes, depth = passes_and_depth(vectors.count(), least, window, passes)
    met = written(window_links(vectors, least, passes, window), "met_links")
    members = components(met)
    # Pairs in crowded prefixes that no window brought together.
    more = written(crowded_links(vectors, members, least, passes, window, depth), "crowded_links")
    if not more.isEmpty():
        members = components(met.unionByName(more))
    linked = written(count_links(vectors.select("node", "dim", "vec", "copies"), members, least), "link_counts")
    per = (vectors.select("node", "copies", "smallest").join(members, "node", "left").join(linked, "node", "left")
           .select("node", "smallest", F.coalesce("component", "node").alias("component"),
                   (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    per = written(per, "vector_classes")
    first = cut(per.groupBy("component").agg(F.min("smallest").alias("component_id")))
    per = written(per.join(first, "component").select("node", "n_links", "component_id"), "vector_components")
    out = rows.select("vec_id", "node").join(per, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
