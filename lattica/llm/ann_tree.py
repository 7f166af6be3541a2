"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE_BYTES``): a cluster with more
than a leaf's share is split by k-means into up to ``BRANCH`` clusters, down to the
leaves.  Every vector is then dealt to the leaf that a greedy descent finds.

A query goes through the tree best bin first: a priority queue holds the clusters
seen so far by the distance to their centres; the nearest is taken out, a leaf is
visited, any other cluster's children go into the queue.  How many leaves are
visited is calibrated: for a bounded number of queries (``CALIBRATE``) the exact
neighbours are found by reading all vectors once, and visits are widened until
these queries meet the wanted share of their neighbours.

Leaves and the queries that visit them meet in tiles of bounded size, so a leaf
with a large share of all vectors, or of all queries, is spread over many tasks.
Equal vectors are one row with their smallest ids: more than ``k`` + 1 of them
can't be in a result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_group, by_hash, cut, empty, pick, written

#: Clusters that a cluster is split into, at most; rounds of k-means.
BRANCH, ROUNDS = 16, 8
#: Vectors of a leaf, about, while the sample's bound allows it; sampled vectors of a leaf, at least.
LEAF, LEAF_SAMPLE = 256, 16
#: Bytes of the sampled vectors in double precision, about.
SAMPLE_BYTES = 64 << 20
#: Queries whose exact neighbours calibrate the visits, and the share of these to be met.
CALIBRATE, RECALL = 256, 0.96
#: Bytes of a tile's vectors in double precision, at most, and rows of its sides.
TILE_BYTES, TILE = 32 << 20, 2_048

RESULT = "query_id bigint, rank int, vec_id bigint, score double"


# ------------------------------------------------------------------ distances
def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.argmin((centres ** 2).sum(1) - 2 * (x @ centres.T), axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis, from the differences; squares of
    huge and tiny differences are kept in range."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        apart = x - y
        d = np.sqrt((apart * apart).sum(-1))
        most = np.abs(apart).max(-1)
        odd = (most > 1e150) | ((most < 1e-140) & (most > 0))
        if odd.any():
            scaled = apart[odd] / most[odd, None]
            d[odd] = np.where(np.isfinite(most[odd]), np.sqrt((scaled * scaled).sum(-1)) * most[odd], np.inf)
    return d


def nearest_rows(queries: np.ndarray, x: np.ndarray, smallest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row of x, distance) of each query's k nearest rows, ties to the smaller ``smallest``."""
    k = min(k, len(x))
    if not k or not len(queries):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    with np.errstate(over="ignore", invalid="ignore"):
        qq, xx = (queries ** 2).sum(1), (x ** 2).sum(1)
        rough = qq[:, None] + xx - 2 * (queries @ x.T)
        margin = 1e-10 * (qq + xx.max())
    if not np.isfinite(rough).all():
        rough, margin = np.zeros_like(rough), np.ones(len(queries))
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + margin
    # All rows that rounding may have put among the nearest, then exact distances.
    q, at = np.nonzero(rough <= limit[:, None])
    d = np.empty(len(q))
    for lo in range(0, len(q), 65_536):
        part = slice(lo, lo + 65_536)
        d[part] = distances(queries[q[part]], x[at[part]])
    order = np.lexsort((smallest[at], d, q))
    q, at, d = q[order], at[order], d[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    first = place < k
    return q[first], at[first], d[first]


# ----------------------------------------------------------------------- tree
class KMeansTree:
    """Clusters of a sample, split by k-means until a leaf holds at most ``leaf`` of them.

    Children of a cluster are next to each other: ``span[c]`` is their range, empty
    for a leaf; ``leaf[c]`` numbers the leaves.
    """

    def __init__(self, sample: np.ndarray, leaf: int, branch: int = BRANCH, first_leaf: int = 0):
        rng = np.random.default_rng([len(sample), sample.shape[1], 2024])
        centres, self.span, self.leaf = [np.zeros(sample.shape[1])], [(0, 0)], [-1]
        open_, self.n_leaves = [(0, np.arange(len(sample)))], 0
        for at, rows in open_:  # breadth first: clusters are appended while it runs
            parts = self._split(sample[rows], min(branch, -(-len(rows) // leaf)), rng) if len(rows) > leaf else []
            if len(parts) < 2:
                self.leaf[at] = first_leaf + self.n_leaves
                self.n_leaves += 1
                continue
            self.span[at] = (len(centres), len(centres) + len(parts))
            for centre, mine in parts:
                open_.append((len(centres), rows[mine]))
                centres.append(centre)
                self.span.append((0, 0))
                self.leaf.append(-1)
        self.centres = np.array(centres)

    @staticmethod
    def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            near = _nearest(x, centres)
            kept = np.unique(near)
            centres = np.stack([x[near == j].mean(0) for j in kept.tolist()])
        near = _nearest(x, centres)
        return [(centres[j], np.flatnonzero(near == j)) for j in np.unique(near).tolist()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by greedy descent."""
        out = np.zeros(len(x), np.int32)
        open_ = [(0, np.arange(len(x)))]
        while open_:
            at, rows = open_.pop()
            lo, hi = self.span[at]
            if lo == hi:
                out[rows] = self.leaf[at]
                continue
            near = _nearest(x[rows], self.centres[lo:hi])
            open_ += [(lo + j, rows[near == j]) for j in np.unique(near).tolist()]
        return out

    def best_first(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which a best-bin-first search visits them."""
        queue = [(0.0, 0)]
        while queue:
            _, at = heapq.heappop(queue)
            lo, hi = self.span[at]
            if lo == hi:
                yield self.leaf[at]
                continue
            with np.errstate(over="ignore"):
                apart = self.centres[lo:hi] - query
                away = np.nan_to_num((apart * apart).sum(1), nan=np.inf).tolist()
            for child, d in zip(range(lo, hi), away):
                heapq.heappush(queue, (d, child))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _per_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, its rows, their vectors) of each length in a batch with columns dim and vec."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        mine = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
        yield dim, mine, _matrix(mine.column("vec"), dim)


# ------------------------------------------------------------------- operator
def vectors_of(embeddings: DataFrame, queries: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (a, b, dim, vec, ids) and the queries (query_id, a, b, dim, vec, copies).

    Rows whose vector is null, empty, zero or holds null or non-finite components
    take no part.  (a, b) names a vector by two hashes; ``ids`` are the k + 1
    smallest of its rows, null last.  ``queries`` is a condition on vec_id.
    """
    raw = pick(embeddings, "vec_id", "embedding")
    inner = raw.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(inner, T.FloatType) else "double"
    rows = raw.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    fits = (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    same = F.transform("vec", lambda v: F.when(v == 0, F.lit(0).cast(kind)).otherwise(v))  # 0.0 and -0.0 are one value
    rows = rows.filter(F.coalesce(fits, F.lit(False))).select("vec_id", same.alias("vec"))
    rows = rows.withColumns({"a": F.xxhash64("vec"), "b": F.xxhash64(F.lit(1), "vec"), "dim": F.size("vec")})
    # A rank filter is applied in every map task first: a vector that very many rows hold sends few.
    smallest = Window.partitionBy("a", "b").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("_r", F.row_number().over(smallest)).filter(F.col("_r") <= k + 1)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_r", "vec_id"))), lambda s: s["vec_id"])
    distinct = written(few.groupBy("a", "b").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), ids.alias("ids")), "distinct_vectors")
    asked = rows.filter(queries).groupBy("vec_id", "a", "b").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
    return distinct, written(asked.withColumnRenamed("vec_id", "query_id"), "query_vectors")


def fit_trees(vectors: DataFrame, leaf: int = LEAF) -> dict[int, KMeansTree]:
    """A tree for each length of vectors, from a bounded sample; one row per length reaches the driver."""
    trees, first = {}, 0
    for row in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
        dim, n = row["dim"], row["n"]
        bound = max(LEAF_SAMPLE, SAMPLE_BYTES // (8 * dim))
        leaves = max(1, min(-(-n // leaf), bound // LEAF_SAMPLE))
        bound = min(bound, 2 * LEAF_SAMPLE * leaves)
        chosen = vectors.filter((F.col("dim") == dim) & by_hash(F.col("a"), n, bound)).select("a", "b", "vec").limit(2 * bound).toArrow()
        sample = _matrix(chosen.sort_by([("a", "ascending"), ("b", "ascending")]).column("vec").combine_chunks(), dim)
        if not len(sample):  # a length with very few vectors of unlucky hashes
            sample = np.zeros((1, dim))
        trees[dim] = KMeansTree(sample, max(1, len(sample) // leaves), first_leaf=first)
        first += trees[dim].n_leaves
    return trees


def place(vectors: DataFrame, trees: dict[int, KMeansTree]) -> DataFrame:
    """``vectors`` with the leaf of each."""
    held = vectors.sparkSession.sparkContext.broadcast(trees)  # bounded by SAMPLE_BYTES
    schema = T.StructType([*vectors.schema.fields, T.StructField("leaf", T.IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, mine, x in _per_dim(batch):
                leaf = pa.array(held.value[dim].assign(x), pa.int32())
                yield pa.RecordBatch.from_arrays([*mine.columns, leaf], names=[*mine.schema.names, "leaf"])

    return vectors.mapInArrow(deal, schema)


def exact_leaves(placed: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(dim, q, place, leaf) of the k nearest other vectors of each query, from all vectors.

    ``asked``: for each length the names (a, b) and vectors of a bounded number of
    queries.  A task keeps k rows for each of them.
    """
    held = placed.sparkSession.sparkContext.broadcast(asked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for dim, mine, x in _per_dim(batch):
                if dim not in held.value:
                    continue
                names, queries = held.value[dim]
                a, b, leaf = (mine.column(c).to_numpy() for c in ("a", "b", "leaf"))
                for lo in range(0, len(x), 4_096):
                    part = slice(lo, lo + 4_096)
                    q, at, d = nearest_rows(queries, x[part], a[part], k + 1)
                    other = (names[q, 0] != a[part][at]) | (names[q, 1] != b[part][at])
                    new = q[other], d[other], leaf[part][at[other]]
                    new = tuple(np.concatenate(p) for p in zip(best[dim], new)) if dim in best else new
                    order = np.lexsort((new[1], new[0]))
                    new = tuple(p[order] for p in new)
                    first = np.arange(len(order)) - np.searchsorted(new[0], new[0]) < k
                    best[dim] = tuple(p[first] for p in new)
        for dim, (q, d, leaf) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), dim, np.int32)), pa.array(q.astype(np.int32)), pa.array(d), pa.array(leaf.astype(np.int32))],
                                             names=["dim", "q", "d", "leaf"])

    rows = placed.select("a", "b", "dim", "vec", "leaf").mapInArrow(scan, "dim int, q int, d double, leaf int")
    order = F.row_number().over(Window.partitionBy("dim", "q").orderBy("d", "leaf"))
    return rows.withColumn("place", order).filter(F.col("place") <= k).select("dim", "q", "place", "leaf")


def calibrated_visits(placed: DataFrame, queries: DataFrame, trees: dict[int, KMeansTree], k: int, recall: float,
                      calibrate: int = CALIBRATE) -> int:
    """Leaves to visit: widened until the calibration queries meet ``recall`` of their exact neighbours."""
    n = queries.count()
    # At most twice the bound, as a hash chooses about so many.
    some = queries.filter(by_hash(F.col("a"), n, calibrate)).select("a", "b", "dim", "vec").limit(2 * calibrate).toArrow()
    if not some.num_rows:
        some = queries.select("a", "b", "dim", "vec").limit(calibrate).toArrow()
    asked = {}
    for batch in some.combine_chunks().to_batches():
        for dim, mine, x in _per_dim(batch):
            asked[dim] = (np.stack([mine.column("a").to_numpy(), mine.column("b").to_numpy()], 1), x)
    places = []  # of each exact neighbour's leaf among the leaves that its query visits
    orders: dict[tuple[int, int], dict[int, int]] = {}
    for r in exact_leaves(placed, asked, k).collect():  # k rows for each calibration query
        key = r["dim"], r["q"]
        if key not in orders:
            orders[key] = {leaf: i for i, leaf in enumerate(trees[r["dim"]].best_first(asked[r["dim"]][1][r["q"]]), 1)}
        places.append(orders[key][r["leaf"]])
    visits, met = 1, np.array(places or [1])
    most = max(tree.n_leaves for tree in trees.values())
    while visits < most and (met <= visits).mean() < recall:
        visits += 1
    return visits


def visited(queries: DataFrame, trees: dict[int, KMeansTree], visits: int) -> DataFrame:
    """Each query once for every leaf it visits, and which visit it is (``turn``, from 0)."""
    held = queries.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([*queries.schema.fields, T.StructField("leaf", T.IntegerType()), T.StructField("turn", T.IntegerType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, mine, x in _per_dim(batch):
                tree = held.value[dim]
                for lo in range(0, len(x), 64):
                    leaves = [[leaf for leaf, _ in zip(tree.best_first(q), range(visits))] for q in x[lo:lo + 64]]
                    at = pa.array(np.repeat(np.arange(lo, lo + len(leaves)), [len(m) for m in leaves]))
                    rows = mine.take(at)
                    new = [pa.array([x for m in leaves for x in f(m)], pa.int32()) for f in (list, lambda m: range(len(m)))]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*rows.schema.names, "leaf", "turn"])

    return queries.mapInArrow(walk, schema)


def _search_tiles(placed: DataFrame, asked: DataFrame, k: int, tile: int) -> DataFrame:
    """(query_id, a, b, score, ids, own) for the k + 1 nearest vectors of each tile of a
    visited leaf, as far as they are within the query's ``limit``."""
    side = F.greatest(F.lit(64), F.least(F.lit(tile), F.floor(F.lit(TILE_BYTES) / (F.col("dim") * 16)).cast("int")))
    members = placed.groupBy("leaf", "dim").agg(F.count(F.lit(1)).alias("n")).select("leaf", F.ceil(F.col("n") / side).cast("int").alias("shards"))
    callers = asked.groupBy("leaf", "dim").agg(F.count(F.lit(1)).alias("n")).select("leaf", F.ceil(F.col("n") / side).cast("int").alias("blocks"))
    sizes = cut(members.join(callers, "leaf"))
    place = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda t: F.lit(None).cast(t)
    left = (placed.join(sizes, "leaf").withColumn("shard", place("shards", "a", "b")).withColumn("block", every("blocks"))
            .select("leaf", "shard", "block", F.lit(False).alias("asks"), none("long").alias("query_id"), "a", "b", "dim", "vec", "ids", none("double").alias("limit")))
    right = (asked.join(sizes, "leaf").withColumn("block", place("blocks", "query_id", "a", "b")).withColumn("shard", every("shards"))
             .select("leaf", "shard", "block", F.lit(True).alias("asks"), "query_id", "a", "b", "dim", "vec", none("array<long>").alias("ids"), "limit"))
    schema = pa.schema([("query_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64())), ("own", pa.bool_())])

    def search(rows: pa.Table) -> pa.RecordBatch:
        asks = rows.column("asks").to_numpy()
        dim = rows.column("dim")[0].as_py()
        x = _matrix(rows.column("vec").combine_chunks(), dim)
        limit = rows.column("limit").to_numpy()
        ask, have = np.flatnonzero(asks), np.flatnonzero(~asks)
        # Ties go to the smaller first id; ids are null last.
        ids = rows.column("ids").take(pa.array(have)).combine_chunks()
        lists = ids.to_pylist()
        smallest = np.array([np.iinfo(np.int64).max if i[0] is None else i[0] for i in lists], np.int64)
        found = []
        for lo in range(0, len(ask), 256):  # bounds the matrix of distances
            q, at, d = nearest_rows(x[ask[lo:lo + 256]], x[have], smallest, k + 1)
            inside = d <= limit[ask[q + lo]]
            found.append((q[inside] + lo, at[inside], d[inside]))
        q, at, d = (np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        name = {c: rows.column(c).to_numpy() for c in ("a", "b")}
        qa, qb = name["a"][ask[q]], name["b"][ask[q]]
        own = (qa == name["a"][have[at]]) & (qb == name["b"][have[at]])
        query_id = rows.column("query_id").take(pa.array(ask[q])).combine_chunks()
        return pa.RecordBatch.from_arrays([query_id, pa.array(qa), pa.array(qb), pa.array(d), ids.take(pa.array(at)), pa.array(own)], schema=schema)

    return by_group(left.unionByName(right), ["leaf", "shard", "block"], search,
                    "query_id bigint, a bigint, b bigint, score double, ids array<bigint>, own boolean")


def nearest(embeddings: DataFrame, queries: Column, k: int = 10, recall: float = RECALL, leaf: int = LEAF, tile: int = TILE,
            visits: int | None = None) -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows for which ``queries`` (a condition on vec_id) holds;
    candidates are all rows but the query's own.  ``score`` is the Euclidean
    distance in double precision; nearest come first, ties go to the smaller vec_id
    (null last).  Vectors that are null, empty, zero or hold null or non-finite
    components take no part, as queries or candidates; only vectors of one length
    are compared.  Equal rows are separate rows: a query that stands twice has its
    results twice, each with the other row among them.  ``visits`` (leaves a query
    visits) is calibrated for ``recall`` unless given.
    """
    spark = embeddings.sparkSession
    vectors, asked = vectors_of(embeddings, queries, k)
    if asked.isEmpty():
        return empty(spark, RESULT)
    trees = fit_trees(vectors, leaf)
    placed = written(place(vectors, trees), "vectors_in_leaves")
    if visits is None:
        visits = calibrated_visits(placed, asked, trees, k, recall)
    callers = written(visited(asked.select("query_id", "a", "b", "dim", "vec"), trees, visits), "visited_leaves")
    near = Window.partitionBy("query_id", "a", "b").orderBy("score", F.get("ids", F.lit(0)).asc_nulls_last())
    first_of = lambda t: t.withColumn("_v", F.row_number().over(near)).filter(F.col("_v") <= k + 1)
    # The first visits give each query a distance within which k + 1 vectors lie; the
    # others report what is as near only.
    some = int(np.ceil(np.sqrt(visits)))
    begun = _search_tiles(placed, callers.filter(F.col("turn") < some).withColumn("limit", F.lit(float("inf"))), k, tile)
    begun = written(first_of(written(begun, "first_neighbours")), "nearest_so_far")
    limits = begun.groupBy("query_id", "a", "b").agg(F.max(F.when(F.col("_v") == k + 1, F.col("score"))).alias("limit"))
    rest = callers.filter(F.col("turn") >= some).join(limits, ["query_id", "a", "b"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    found = begun.drop("_v").unionByName(written(_search_tiles(placed, rest, k, tile), "later_neighbours"))
    # Only rows of the k + 1 nearest vectors can be results.
    found = first_of(found)
    # Of the query's own vector one row is the query itself.
    mine = F.array_position("ids", F.col("query_id"))
    others = F.when(F.col("own") & (mine > 0), F.filter("ids", lambda _, i: i + 1 != mine)).otherwise(F.col("ids"))
    found = found.select("query_id", "a", "b", "score", F.explode(others).alias("vec_id"))
    order = Window.partitionBy("query_id", "a", "b").orderBy("score", F.col("vec_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    again = asked.filter("copies > 1").select("query_id", "a", "b", "copies")
    best = best.join(again, ["query_id", "a", "b"], "left").withColumn("_n", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
