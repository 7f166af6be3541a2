"""Work tables and program batches derived by Spark from the driver's tables.

* ``work_items``: one row per line item with a bucket, a hard flag, a movable
  flag and a group, for the balancing operators.
* ``selection_program``: one 0/1 knapsack per order (maximise value within half
  of the order's quantity).
* ``mix_program``: one program per order, 0..2 units per line, exactly n
  units, at least 70 % of the quantity covered, least value.

Item identity is ``row_key`` (file position), which needs no global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.program import Program, program_from_tables
from lattica.sources.tables import table, with_row_key

# Fixed fixture parameters.
N_BUCKETS = 40          # bucket = l_suppkey % 40
HARD_QTY = 25           # is_hard = l_quantity >= 25
N_GROUPS = 24           # grp = l_partkey % 24
MIX_MAX_UNITS = 2
MIX_COVER_NUM, MIX_COVER_DEN = 7, 10   # ceil(70 %) as (7 * W + 9) div 10


def cents(col: str = "l_extendedprice") -> F.Column:
    return F.round(F.col(col) * 100).cast("bigint")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their stable key ``item_id`` and integer value/weight."""
    li = with_row_key(table(spark, sf_dir, "lineitem"), "item_id")
    return li.select(
        "item_id", "l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity",
        cents().alias("v"), F.col("l_quantity").cast("bigint").alias("w"))


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, bucket, is_hard, movable, grp, l_orderkey)`` (FIXTURES §3)."""
    return items(spark, sf_dir).select(
        "item_id", "l_orderkey",
        F.pmod(F.col("l_suppkey"), F.lit(N_BUCKETS)).cast("int").alias("bucket"),
        (F.col("l_quantity") >= HARD_QTY).alias("is_hard"),
        (F.col("l_linestatus") == "O").alias("movable"),
        F.pmod(F.col("l_partkey"), F.lit(N_GROUPS)).cast("int").alias("grp"),
    )


def selection_program(spark: SparkSession, sf_dir: str) -> Program:
    """One binary knapsack per order: max Σ v·x s.t. Σ w·x <= floor(Σ w / 2)."""
    it = items(spark, sf_dir)
    vars = it.select(F.col("l_orderkey").alias("problem_id"), F.col("item_id").alias("var"),
                     F.lit(0.0).alias("lb"), F.lit(1.0).alias("ub"), F.col("v").cast("double").alias("obj"),
                     F.lit(True).alias("is_int"))
    cons = it.groupBy("l_orderkey").agg(F.floor(F.sum("w") / 2).cast("double").alias("rhs")).select(
        F.col("l_orderkey").alias("problem_id"), F.lit("cap").alias("con"), F.lit("<=").alias("sense"), "rhs")
    coefs = it.select(F.col("l_orderkey").alias("problem_id"), F.lit("cap").alias("con"),
                      F.col("item_id").alias("var"), F.col("w").cast("double").alias("coef"))
    return program_from_tables(vars, cons, coefs, "max")


def mix_program(spark: SparkSession, sf_dir: str) -> Program:
    """One program per order: x in 0..2; min Σ v·x; Σ w·x >= ceil(0.7 Σ w); Σ x = n."""
    it = items(spark, sf_dir)
    per_order = it.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("W"))
    vars = it.select(F.col("l_orderkey").alias("problem_id"), F.col("item_id").alias("var"),
                     F.lit(0.0).alias("lb"), F.lit(float(MIX_MAX_UNITS)).alias("ub"),
                     F.col("v").cast("double").alias("obj"), F.lit(True).alias("is_int"))
    cover = per_order.select(
        F.col("l_orderkey").alias("problem_id"), F.lit("cover").alias("con"), F.lit(">=").alias("sense"),
        F.floor((F.col("W") * MIX_COVER_NUM + (MIX_COVER_DEN - 1)) / MIX_COVER_DEN).cast("double").alias("rhs"))
    count = per_order.select(
        F.col("l_orderkey").alias("problem_id"), F.lit("count").alias("con"), F.lit("=").alias("sense"),
        F.col("n").cast("double").alias("rhs"))
    coefs = it.select(F.col("l_orderkey").alias("problem_id"), F.explode(F.array(
        F.struct(F.lit("cover").alias("con"), F.col("w").cast("double").alias("coef")),
        F.struct(F.lit("count").alias("con"), F.lit(1.0).alias("coef")))).alias("k"), "item_id") \
        .select("problem_id", F.col("k.con").alias("con"), F.col("item_id").alias("var"), F.col("k.coef").alias("coef"))
    return program_from_tables(vars, cover.unionByName(count), coefs, "min")


def one_line_program(spark: SparkSession, sf_dir: str) -> Program:
    """One program per order: exactly one line, of at least the average quantity, of least value."""
    it = items(spark, sf_dir).withColumnRenamed("l_orderkey", "problem_id")
    vars = it.select("problem_id", F.col("item_id").alias("var"), F.lit(0.0).alias("lb"), F.lit(1.0).alias("ub"),
                     F.col("v").cast("double").alias("obj"), F.lit(True).alias("is_int"))
    need = it.groupBy("problem_id").agg(F.sum("w").alias("W"), F.count(F.lit(1)).alias("n"))
    rows = need.select("problem_id", F.inline(F.array(
        F.struct(F.lit("one").alias("con"), F.lit("=").alias("sense"), F.lit(1.0).alias("rhs")),
        F.struct(F.lit("enough").alias("con"), F.lit(">=").alias("sense"), F.ceil(F.col("W") / F.col("n")).cast("double").alias("rhs")))))
    coefs = it.select("problem_id", F.col("item_id").alias("var"), F.inline(F.array(
        F.struct(F.lit("one").alias("con"), F.lit(1.0).alias("coef")), F.struct(F.lit("enough").alias("con"), F.col("w").cast("double").alias("coef")))))
    return program_from_tables(vars, rows, coefs, "min")
