"""Helpers shared by the training-data operators.

Conventions that hold for every operator of the package:

* a null text is read as the empty text;
* columns are found by their exact name, so further columns of the input (also
  ones that differ from ours in case only) never disturb an operator;
* repeated rows are separate rows unless an operator's docstring says otherwise.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.session import ensure_checkpoint_dir


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else ``df`` holds (names match by case)."""
    places = [df.columns.index(n) for n in names]
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(places, names)])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use, in any case."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def with_result(df: DataFrame, udf, source: str) -> tuple[DataFrame, str]:
    """``df`` with one more column, ``udf`` of the column ``source``; and its name.

    The other columns stay in the JVM, unchanged and in place.
    """
    name = fresh(df, "_result")
    place = df.columns.index(source)
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    flat = flat.withColumn("_r", udf(F.coalesce(F.col(f"_c{place}"), F.lit(""))))
    return flat.toDF(*df.columns, name), name


_HELD: list = [None, None]


def held(owner: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from batch to batch for ``owner``, made when first asked for.

    Workers serve one operator after another; what an earlier one kept is let go
    when another asks, so that memory doesn't add up along a pipeline.
    """
    if _HELD[0] != owner:
        _HELD[:] = [None, None]
        _release()
        _HELD[:] = [owner, make()]
    return _HELD[1]


def _release() -> None:
    """Give freed memory back to the machine: the C library and Arrow keep it for later otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table, under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)  # the session's; a new local one in an unconfigured local session
    return f"{base.rstrip('/')}/lattica-{name}-{uuid.uuid4().hex}"


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read again.

    Cuts the lineage: a lost executor costs a new read, not a new computation,
    and Python work below runs once.  The write's own shuffle files have no reader
    after it; Spark removes them when it ends, not when the driver's garbage is
    collected.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")  # read when the write is planned
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of an iteration."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % modulus).cast("int")


def by_hash(key: Column, n_rows: int, bound: int) -> Column:
    """True for about ``bound`` of ``n_rows`` rows, chosen by the hash of a key."""
    if n_rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * bound / n_rows)


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def by_group(rows: DataFrame, keys: list[str], task: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``task`` of the rows of each key, which may run over several Arrow batches.

    Keys must not be null, and the caller keeps the groups bounded: one group
    and one batch are in a worker's memory at a time.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            at = _edges(table, keys)
            yield from (task(table.slice(lo, hi - lo)) for lo, hi in zip(at[:-2], at[1:-1]))
            held = table.slice(at[-2]).to_batches() if len(at) > 1 else []
        if held:
            yield task(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_in_large(stream), schema)


def _in_large(stream: Callable) -> Callable:
    """``stream`` whose many small batches leave as few larger ones."""

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in stream(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= 10_000 or len(held) >= 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return large


def _edges(table: pa.Table, keys: list[str]) -> list[int]:
    """Where a new key begins, and the end."""
    n = table.num_rows
    if not n:
        return [0]
    new = np.ones(n + 1, bool)
    values = [table.column(k).to_numpy() for k in keys]
    new[1:-1] = np.any([v[1:] != v[:-1] for v in values], axis=0)
    return np.flatnonzero(new).tolist()


class Union:
    """Union-find over places 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def add(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def forest(self) -> list[tuple[int, int]]:
        """A link from every place that is not its class's first to that first."""
        return [(x, r) for x in range(len(self.up)) if (r := self.root(x)) != x]
