"""Session helpers: a local session for tests and benches, and lineage cuts.

Lineage is cut with reliable ``DataFrame.checkpoint()`` into the shared folder
the cluster names in ``spark.checkpoint.dir``.  A folder of our own is only set
when the session has none (local tests); on a cluster it must be configured.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Confs the solver relies on.  AQE re-plans joins from runtime sizes (so the
# per-problem tables are broadcast only when they really are small) and
# splits skewed join partitions.
SOLVER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lattica") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LATTICA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SOLVER_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a fresh one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder and
    is used as is.  Only an unconfigured session of one process (``local[...]``: a
    test, bench or tool) gets a new local folder; on a cluster this raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lattica-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage (survives executor loss).

    Needs the session's shared checkpoint folder: ``spark.checkpoint.dir`` on a
    cluster, ``ensure_checkpoint_dir`` in tests, benches and tools.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(configured)
    # An eager reliable checkpoint computes the plan once and writes it.
    return df.checkpoint(eager=True)


#: While a table of a run is written: its shuffle files go when the write ends, and tables dealt by
#: one key meet as they lie on disk, also for joins on that key and others.
_DEALT_CONF = {
    # Arrow batches are bounded by their rows (``Tables.batch``): a bound in bytes sums up the whole batch anew for each row.
    "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
HOT_BYTES, HOT_TIMES = 64 << 20, 4  # a part's files of so many bytes, and so many times the mean


BATCH_BYTES = 64 << 20  # of an Arrow batch, about
BATCH_ROWS = 10_000


@contextmanager
def as_dealt(spark: SparkSession, batch: int = BATCH_ROWS) -> Iterator[None]:
    """What is planned inside meets dealt tables without a shuffle; Arrow batches have ``batch`` rows."""
    conf = _DEALT_CONF | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Tables:
    """The tables of one run: compressed Parquet in the shared checkpoint folder, dealt to ``parts``
    by ``key`` as bucketed tables, so that they join and aggregate by it without a shuffle.

    Like ``cut`` they hold the lineage off: a lost executor costs a new read.  ``drop`` deletes a
    table's files as soon as nothing reads it any more.  The catalog holds no entry
    of them after the write.
    """

    def __init__(self, spark: SparkSession, parts: int, key: str = "problem_id"):
        self.spark, self.parts, self.key = spark, parts, key
        self.batch = BATCH_ROWS  # rows of an Arrow batch
        self.folders: dict[int, tuple[DataFrame, str]] = {}

    def put(self, *tables: DataFrame) -> DataFrame:
        """The rows of ``tables``, which are written one after the other."""
        name = f"lattica_{uuid.uuid4().hex}"
        folder = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{name}"
        with as_dealt(self.spark, self.batch):
            try:
                for df in tables:
                    df.write.mode("append").format("parquet").option("path", folder).option("compression", "zstd").bucketBy(self.parts, self.key).saveAsTable(name)
                out = self.spark.table(name)
            finally:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if self._hot(folder):  # read as plain files: adaptive execution splits the rows of a hot key
            out = self.spark.read.schema(out.schema).parquet(folder)
        self.folders[id(out)] = (out, folder)
        return out

    def widest(self, numbers: int) -> None:
        """Rows of up to so many numbers go into Arrow batches from now on."""
        self.batch = max(1, min(BATCH_ROWS, BATCH_BYTES // (8 * max(numbers, 1))))

    def deal(self, df: DataFrame) -> DataFrame:
        """``put`` of rows that lie anywhere."""
        return self.put(df.repartition(self.parts, self.key))

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of those of ``tables`` that this run wrote."""
        for df in tables:
            if (found := self.folders.pop(id(df), None)) is not None:
                path, fs = self._path(found[1])
                fs.delete(path, True)

    def _path(self, folder: str):
        spark = self.spark.sparkContext
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _hot(self, folder: str) -> bool:
        path, fs = self._path(folder)
        size: dict[str, int] = defaultdict(int)
        for file in fs.listStatus(path):
            if part := re.search(r"_(\d+)\.c\d+", file.getPath().getName()):
                size[part[1]] += file.getLen()
        return bool(size) and max(size.values()) > max(HOT_BYTES, HOT_TIMES * sum(size.values()) / self.parts)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
