"""Programs as long tables: ``vars``, ``cons``, ``coefs`` keyed by ``problem_id``.

Many bounded integer programs live side by side in the same three DataFrames;
the reference's single program is the case of one ``problem_id``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica import schemas

PID = "problem_id"


@dataclass(frozen=True)
class Program:
    """A batch of integer programs.  ``sense`` is ``"min"`` or ``"max"`` for all, or
    a DataFrame (problem_id, sense) with the sense of each problem."""

    vars: DataFrame
    cons: DataFrame
    coefs: DataFrame
    sense: str | DataFrame = "min"

    def __post_init__(self) -> None:
        if isinstance(self.sense, str) and self.sense not in ("min", "max"):
            raise ValueError(f"sense must be 'min' or 'max', not {self.sense!r}")

    def with_sign(self, problems: DataFrame) -> DataFrame:
        """``problems`` with ``sign``: 1 where a problem is minimised, -1 where it is
        maximised.  Internally everything is minimised: ``c = sign * obj``."""
        if isinstance(self.sense, str):
            return problems.withColumn("sign", F.lit(1.0 if self.sense == "min" else -1.0))
        signs = self.sense.select(PID, F.when(F.col("sense") == "max", F.lit(-1.0)).otherwise(F.lit(1.0)).alias("sign"))
        return problems.join(signs, PID)


def program_from_tables(vars: DataFrame, cons: DataFrame, coefs: DataFrame, sense: str | DataFrame = "min") -> Program:
    """Type the three tables (and the senses) to the engine's schemas (casts only, no inference)."""
    v = vars.select(
        F.col(PID).cast("bigint").alias(PID),
        F.col("var").cast("string").alias("var"),
        F.col("lb").cast("double").alias("lb"),
        F.col("ub").cast("double").alias("ub"),
        F.col("obj").cast("double").alias("obj"),
        F.coalesce(F.col("is_int").cast("boolean"), F.lit(True)).alias("is_int") if "is_int" in vars.columns
        else F.lit(True).alias("is_int"),
    )
    c = cons.select(
        F.col(PID).cast("bigint").alias(PID),
        F.col("con").cast("string").alias("con"),
        F.col("sense").cast("string").alias("sense"),
        F.col("rhs").cast("double").alias("rhs"),
    )
    k = coefs.select(
        F.col(PID).cast("bigint").alias(PID),
        F.col("con").cast("string").alias("con"),
        F.col("var").cast("string").alias("var"),
        F.col("coef").cast("double").alias("coef"),
    )
    if not isinstance(sense, str):
        sense = sense.select(F.col(PID).cast("bigint").alias(PID), F.lower(F.col("sense").cast("string")).alias("sense"))
    return Program(v, c, k, sense)


def normalized_rows(program: Program) -> DataFrame:
    """All rows as ``a·x <= b``: ``>=`` rows negated, ``=`` rows split in two.

    Output ``(problem_id, row, var, a, b)``; ``row`` is ``con#le`` or ``con#ge``; a
    constraint without coefficients has one row with a null variable.
    """
    joined = program.cons.join(program.coefs, [PID, "con"], "left")
    le = joined.where(F.col("sense").isin("<=", "=")).select(
        PID, F.concat(F.col("con"), F.lit("#le")).alias("row"), "var",
        F.col("coef").alias("a"), F.col("rhs").alias("b"))
    ge = joined.where(F.col("sense").isin(">=", "=")).select(
        PID, F.concat(F.col("con"), F.lit("#ge")).alias("row"), "var",
        (-F.col("coef")).alias("a"), (-F.col("rhs")).alias("b"))
    return le.unionByName(ge)


#: Rows of the program's tables that one task takes, about.
ROWS_PER_TASK = 500_000


def _tasks(*tables: DataFrame) -> int | None:
    """Tasks for the rows of ``tables``; none if they are few enough for Spark to deal them."""
    rows = sum(t.count() for t in tables)
    tasks = -(-rows // ROWS_PER_TASK)
    return tasks if tasks > tables[0].sparkSession.sparkContext.defaultParallelism else None


def check_program(program: Program) -> DataFrame:
    """Problems that break the engine's assumptions, one row per finding.

    Output ``(problem_id, kind, name)``.  Kinds: ``uncovered_var`` (a variable in
    no row, the reference's coverage assumption), ``unknown_var`` / ``unknown_con`` (a
    coefficient on an undeclared variable or row), ``duplicate_var``, ``duplicate_con``,
    ``duplicate_coef``, ``duplicate_objective_sense``, ``bad_sense``, ``bad_objective_sense`` (neither
    min nor max, or none), ``null_value`` (a null name, bound, objective, sense,
    right-hand side or coefficient), ``not_finite`` (NaN or infinite objective,
    right-hand side or coefficient, NaN bound), ``continuous_var`` / ``infinite_bound`` (need
    an LP per node, out of scope), ``empty_domain`` (lb > ub).  Every finding comes from
    the long tables by filters, counts and anti joins, so a broken problem never
    reaches the folds to arrays and maps.  Large tables (their rows are counted first)
    are dealt by their keys over as many tasks as they need.
    """
    v, c, k = program.vars, program.cons, program.coefs

    def found(rows: DataFrame, kind: str, name: Column | str) -> DataFrame:
        return rows.select(PID, F.lit(kind).alias("kind"), (F.col(name) if isinstance(name, str) else name).alias("name"))

    def each(rows: DataFrame, name: Column | str, **kinds: Column) -> DataFrame:
        """The findings of single rows, from one scan; a kind holds where its column is true."""
        hits = F.filter(F.array(*[F.when(holds, F.lit(kind)) for kind, holds in kinds.items()]), lambda x: x.isNotNull())
        return rows.select(PID, F.explode(hits).alias("kind"), (F.col(name) if isinstance(name, str) else name).alias("name"))

    def twice(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(PID, *key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")

    nulls = lambda *names: F.exists(F.array(*[F.col(n).isNull() for n in names]), lambda x: x)
    odd = lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
    bounds = F.coalesce(F.isnan("lb") | F.isnan("ub"), F.lit(False))
    infinite = F.coalesce((F.abs("lb") == float("inf")) | (F.abs("ub") == float("inf")), F.lit(False))
    entry = F.concat_ws("/", "con", "var")
    tasks = _tasks(v, k)
    deal = lambda rows, *key: rows.repartition(tasks, PID, *key) if tasks else rows

    # Declared and used names side by side: one aggregate finds absent and repeated ones.  Rows
    # that name no problem meet no others; a null name is declared but never used.
    declared = lambda rows, role: rows.select(PID, F.lit(role).alias("role"), F.col(role).alias("name"), F.lit(1).alias("declared"), F.lit(0).alias("used"))
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.col(role).alias("name")) for role in ("var", "con")])
    used = k.select(PID, F.inline(roles)).where(F.col("name").isNotNull()).select("*", F.lit(0).alias("declared"), F.lit(1).alias("used"))
    names = deal(declared(v, "var").unionByName(declared(c, "con")).unionByName(used), "role", "name").groupBy(PID, "role", "name").agg(
        F.sum("declared").cast("int").alias("declared"), F.max("used").alias("used"))
    meet = F.col(PID).isNotNull() & (F.col("declared") > 0) & (F.col("used") > 0)
    some = lambda holds, kind, n: F.array_repeat(kind, F.when(holds, n).otherwise(0))
    kinds = F.concat(some((F.col("role") == "var") & ~meet, F.lit("uncovered_var"), F.col("declared")),
                     some((F.col("used") > 0) & ~meet, F.concat(F.lit("unknown_"), "role"), F.lit(1)),
                     some(F.col("declared") > 1, F.concat(F.lit("duplicate_"), "role"), F.lit(1)))
    parts = [
        names.select(PID, F.explode(kinds).alias("kind"), "name"),
        found(twice(deal(k, "con", "var"), "con", "var"), "duplicate_coef", entry),
        each(c, "con", bad_sense=~F.coalesce(F.col("sense").isin("<=", ">=", "="), F.lit(True)), null_value=nulls("con", "sense", "rhs"), not_finite=odd(F.col("rhs"))),
        each(v, "var", continuous_var=~F.col("is_int"), infinite_bound=infinite, empty_domain=(F.col("lb") > F.col("ub")) & ~bounds,
             null_value=nulls("var", "lb", "ub", "obj"), not_finite=odd(F.col("obj")) | bounds),
        each(k, entry, null_value=nulls("con", "var", "coef"), not_finite=odd(F.col("coef"))),
    ]
    if not isinstance(program.sense, str):
        none = F.lit(None).cast("string")
        senses = program.sense
        bad = senses.where(~F.coalesce(F.col("sense").isin("min", "max"), F.lit(False)))
        absent = v.select(PID).distinct().join(senses.select(PID), PID, "left_anti")
        parts += [found(bad, "bad_objective_sense", "sense"), found(absent, "bad_objective_sense", none), found(twice(senses), "duplicate_objective_sense", none)]
    return reduce(DataFrame.unionByName, parts)


#: Findings that make a problem unsolvable here; the others are remarks.
UNSUPPORTED = ("unknown_var", "unknown_con", "duplicate_var", "duplicate_con", "duplicate_coef", "duplicate_objective_sense", "bad_sense",
               "bad_objective_sense", "null_value", "not_finite", "continuous_var", "infinite_bound")


def unsupported_problems(program: Program) -> DataFrame:
    """(problem_id) of the problems that the solver must not touch."""
    return check_program(program).where(F.col("kind").isin(*UNSUPPORTED) & F.col(PID).isNotNull()).select(PID).distinct()


def without_problems(program: Program, problems: DataFrame) -> Program:
    """The program batch without the given problems (anti join, no collect), nor
    rows that name no problem."""
    gone = problems.select(PID)
    left = lambda t: t.where(F.col(PID).isNotNull()).join(gone, PID, "left_anti")
    sense = program.sense if isinstance(program.sense, str) else left(program.sense)
    return Program(left(program.vars), left(program.cons), left(program.coefs), sense)


def bucket_of(problem_id: Column | str, n_buckets: int) -> Column:
    """Home bucket of a problem: ``pmod(problem_id, n)`` (not Spark's hash), so the
    bucket number is the partition number under ``repartitionById``."""
    return F.pmod(F.col(problem_id) if isinstance(problem_id, str) else problem_id, F.lit(n_buckets)).cast("int")


def root_nodes(vars: DataFrame, n_buckets: int = 40) -> DataFrame:
    """One root node per problem: the whole box, empty override maps."""
    empty = F.create_map().cast(schemas.BOUND_MAP)
    return vars.select(PID).distinct().select(
        F.col(PID),
        F.lit("r").alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("r").alias("subtree_id"),
        F.lit(0).alias("subtree_root_depth"),
        bucket_of(PID, n_buckets).alias("bucket"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("is_easy"),
        empty.alias("lower"),
        empty.alias("upper"),
        F.lit(None).cast("double").alias("bound"),
        F.lit(schemas.OPEN).alias("status"),
    )


__all__ = [
    "Program", "program_from_tables", "normalized_rows", "check_program", "root_nodes",
    "bucket_of", "unsupported_problems", "without_problems", "UNSUPPORTED", "PID", "T",
]
