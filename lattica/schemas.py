"""Explicit schemas of the engine's tables (no inference anywhere)."""

from pyspark.sql import types as T

BOUND_MAP = T.MapType(T.StringType(), T.DoubleType())

VARS = T.StructType([
    T.StructField("problem_id", T.LongType(), False),
    T.StructField("var", T.StringType(), False),
    T.StructField("lb", T.DoubleType(), False),
    T.StructField("ub", T.DoubleType(), False),
    T.StructField("obj", T.DoubleType(), False),
    T.StructField("is_int", T.BooleanType(), False),
])

CONS = T.StructType([
    T.StructField("problem_id", T.LongType(), False),
    T.StructField("con", T.StringType(), False),
    T.StructField("sense", T.StringType(), False),  # '<=', '>=', '='
    T.StructField("rhs", T.DoubleType(), False),
])

COEFS = T.StructType([
    T.StructField("problem_id", T.LongType(), False),
    T.StructField("con", T.StringType(), False),
    T.StructField("var", T.StringType(), False),
    T.StructField("coef", T.DoubleType(), False),
])

FRONTIER = T.StructType([
    T.StructField("problem_id", T.LongType(), False),
    T.StructField("node_id", T.StringType(), False),
    T.StructField("parent_id", T.StringType(), True),
    T.StructField("subtree_id", T.StringType(), False),
    T.StructField("subtree_root_depth", T.IntegerType(), False),
    T.StructField("bucket", T.IntegerType(), False),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("is_easy", T.BooleanType(), False),
    T.StructField("lower", BOUND_MAP, False),
    T.StructField("upper", BOUND_MAP, False),
    T.StructField("bound", T.DoubleType(), True),
    T.StructField("status", T.StringType(), False),
])

INCUMBENT = T.StructType([
    T.StructField("problem_id", T.LongType(), False),
    T.StructField("objective", T.DoubleType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("values", BOUND_MAP, True),
])

BUCKET_COUNTS = T.StructType([
    T.StructField("bucket", T.IntegerType(), False),
    T.StructField("n_easy", T.LongType(), False),
    T.StructField("n_hard", T.LongType(), False),
    T.StructField("n_trees", T.LongType(), False),
])

MOVES = T.StructType([
    T.StructField("src", T.IntegerType(), False),
    T.StructField("dst", T.IntegerType(), False),
    T.StructField("n", T.LongType(), False),
])

RUN_METRICS = T.StructType([
    T.StructField("iteration", T.IntegerType(), False),
    T.StructField("bucket", T.IntegerType(), True),
    T.StructField("n_easy", T.LongType(), True),
    T.StructField("n_hard", T.LongType(), True),
    T.StructField("n_trees", T.LongType(), True),
    T.StructField("n_open", T.LongType(), True),
    T.StructField("n_pruned", T.LongType(), True),
    T.StructField("n_completed", T.LongType(), True),
    T.StructField("phase", T.StringType(), True),
])

# Solve status values (one column instead of the reference's five flags).
OPTIMAL, FEASIBLE, INFEASIBLE, UNBOUNDED, ERROR, UNKNOWN = (
    "optimal", "feasible", "infeasible", "unbounded", "error", "unknown")
# Node status values.
OPEN, ABORTED = "open", "aborted"
