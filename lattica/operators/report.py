"""Solutions and progress as tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import schemas
from lattica.operators.balance import rank_within
from lattica.sources.program import PID

ROWS_PER_LIST = 1 << 16  # longest node list kept in one result row


def assemble_solution(values: DataFrame, key: str = PID) -> DataFrame:
    """Long ``(problem_id, var, value)`` rows → one ``values`` map per problem."""
    return values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("var", "value"))).alias("values"))


def variable_value(values: str = "values", var: str = "var"):
    """Value of one variable in a solution map; null when absent (P9 getter)."""
    return F.try_element_at(F.col(values), F.col(var) if isinstance(var, str) else var)


def solution_rows(incumbent: DataFrame) -> DataFrame:
    """Final incumbent as rows ``(problem_id, objective, status, var, value)``."""
    return incumbent.select(PID, "objective", "status", F.explode_outer("values").alias("var", "value"))


def write_solution(incumbent: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink: the solution rows as Parquet."""
    solution_rows(incumbent).write.mode(mode).parquet(path)


def metrics_row(spark: SparkSession, iteration: int, counts: DataFrame, phase: str,
                n_pruned: int | None = None, n_completed: int | None = None) -> DataFrame:
    """``run_metrics`` rows of one iteration: one per bucket from ``bucket_counts``
    plus a total row with ``bucket`` null (S7, D11)."""
    per = counts.select(F.lit(iteration).alias("iteration"), F.col("bucket").cast("int"),
                        "n_easy", "n_hard", "n_trees",
                        (F.col("n_easy") + F.col("n_hard")).alias("n_open"),
                        F.lit(n_pruned).cast("bigint").alias("n_pruned"),
                        F.lit(n_completed).cast("bigint").alias("n_completed"),
                        F.lit(phase).alias("phase"))
    tot = counts.agg(F.sum("n_easy").alias("n_easy"), F.sum("n_hard").alias("n_hard"),
                     F.sum("n_trees").alias("n_trees")).select(
        F.lit(iteration).alias("iteration"), F.lit(None).cast("int").alias("bucket"),
        "n_easy", "n_hard", "n_trees", (F.col("n_easy") + F.col("n_hard")).alias("n_open"),
        F.lit(n_pruned).cast("bigint").alias("n_pruned"), F.lit(n_completed).cast("bigint").alias("n_completed"),
        F.lit(phase).alias("phase"))
    return per.unionByName(tot).select(*[f.name for f in schemas.RUN_METRICS.fields])


# ------------------------------------------------------- state of a run on disk
_COMMITS = "level int, attempt string, at timestamp"
_STATE = {"frontier": schemas.FRONTIER, "incumbent": schemas.INCUMBENT, "metrics": schemas.RUN_METRICS}


def write_level(path: str, level: int, frontier: DataFrame, incumbent: DataFrame, metrics: DataFrame) -> str:
    """Sink of a run's state after ``level`` levels (S6, S7); the name of this attempt.

    Each table goes to a folder of its own for the level and attempt, and a commit
    row is appended last.  Readers go by the first commit of a level, so a half
    written attempt is never read, and one that is written again counts once.
    """
    attempt = uuid.uuid4().hex
    for name, table in (("frontier", frontier), ("incumbent", incumbent), ("metrics", metrics)):
        table.select(*[f.name for f in _STATE[name].fields]).write.parquet(_folder(path, name, level, attempt))
    commit_level(frontier.sparkSession, path, level, attempt)
    return attempt


def commit_level(spark: SparkSession, path: str, level: int, attempt: str) -> None:
    """Declare an attempt whole; a repeated commit changes nothing."""
    row = spark.range(1).select(F.lit(level).cast("int").alias("level"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{path.rstrip('/')}/commits")


def _folder(path: str, name: str, level: int, attempt: str) -> str:
    return f"{path.rstrip('/')}/{name}/level={level}/attempt={attempt}"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(level, attempt) of the whole levels of a run, the first attempt of each."""
    try:
        commits = spark.read.schema(_COMMITS).parquet(f"{path.rstrip('/')}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        commits = spark.createDataFrame([], _COMMITS)
    first = F.min(F.struct("at", "attempt")).alias("c")
    return commits.groupBy("level").agg(first).select("level", F.col("c.attempt").alias("attempt"))


def last_level(spark: SparkSession, path: str) -> int | None:
    """The last whole level of a run, or None."""
    return committed(spark, path).agg(F.max("level")).first()[0]


def read_level(spark: SparkSession, path: str, level: int) -> dict[str, DataFrame]:
    """The tables frontier, incumbent and metrics that the run held after a whole level."""
    row = committed(spark, path).where(F.col("level") == level).first()
    if row is None:
        raise ValueError(f"level {level} of {path} is not whole")
    return {name: spark.read.schema(schema).parquet(_folder(path, name, level, row["attempt"])) for name, schema in _STATE.items()}


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The progress rows of all whole levels of a run (one committed row per level is listed)."""
    folders = [_folder(path, "metrics", r["level"], r["attempt"]) for r in committed(spark, path).collect()]
    return spark.read.schema(schemas.RUN_METRICS).parquet(*folders) if folders else spark.createDataFrame([], schemas.RUN_METRICS)


def bucket_results(solutions: DataFrame, nodes: DataFrame, sense: str = "min", key: str | tuple[str, ...] | None = None,
                   rows_per_list: int = ROWS_PER_LIST) -> DataFrame:
    """Per bucket its best solution and its node list (A9), as a reporting view.

    Part 0 of a bucket holds its best solution (the smallest problem id among
    equal ones), if it has any; parts from 1 on hold its nodes in the order of
    ``key`` (all columns by default), at most ``rows_per_list`` in each, so a hot
    bucket is never collected into one row or one task.
    """
    s = 1.0 if sense == "min" else -1.0
    one = F.struct("problem_id", "objective", "status")
    best = solutions.groupBy("bucket").agg(F.min_by(one, F.when(
        F.col("objective").isNotNull(), F.struct((F.lit(s) * F.col("objective")).alias("o"), F.col("problem_id")))).alias("solution"))
    cols = [c for c in nodes.columns if c != "bucket"]
    ranked = rank_within(nodes, "bucket", key or tuple(cols))
    part = F.ceil(F.col("rank") / rows_per_list).cast("int").alias("part")
    lists = ranked.groupBy("bucket", part).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("nodes") if key is None
                                               else F.collect_list(F.struct(*cols)).alias("nodes"))
    heads = best.where("solution is not null").select("bucket", F.lit(0).alias("part"), "solution")
    both = heads.unionByName(lists, allowMissingColumns=True)
    return both.select("bucket", "part", F.struct("solution", "nodes").alias("result"))


def solution_of(results: DataFrame) -> DataFrame:
    """The solution out of a result (P6), once per bucket that has one."""
    return results.where("result.solution is not null").select("bucket", "result.solution.*")


def nodes_of(results: DataFrame) -> DataFrame:
    """The node list out of a result."""
    return results.where("result.nodes is not null").select("bucket", "part", F.col("result.nodes").alias("nodes"))


def flatten_nodes(results: DataFrame) -> DataFrame:
    """Node lists exploded back to rows, keeping the bucket."""
    return results.select("bucket", F.explode("result.nodes").alias("n")).select("bucket", "n.*")

