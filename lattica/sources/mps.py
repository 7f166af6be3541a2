"""MPS model files as a Spark job (S2): many files, one program per file.

Files are read line by line with ``spark.read.text`` (split like any text
file, never whole into one task).  A line's order key is (split start,
position in the split); the section of a line is the last section header
before it, found by a chunked scan: the last header inside the line's own
chunk (a window over one split) or else the last header of the earlier
chunks (a prefix over the small per-chunk table).  Records are split on
whitespace and typed by section into the ``vars`` / ``cons`` / ``coefs`` tables.

Supported: NAME, OBJSENSE (per file), ROWS (N/L/G/E), COLUMNS with INTORG/INTEND
markers, RHS, RANGES (turns a row into two), BOUNDS (UP LO FX FR MI PL BV LI UI),
ENDATA.  The first N row in the file is the objective, further ones are left
out.  RHS, RANGES and BOUNDS lines may lack the set name.  A right-hand side of
the objective is the negative of a constant, kept as a variable ``#constant``
fixed at 1.  Default bounds are [0, +inf); a negative UP without a lower bound
frees the lower one.  The engine needs finite integer boxes, which
``check_program`` reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.session import cut
from lattica.sources.program import Program, program_from_tables

SECTIONS = ("NAME", "ROWS", "COLUMNS", "RHS", "RANGES", "BOUNDS", "ENDATA", "OBJSENSE")


def mps_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, chunk, line_no, line)`` for every MPS file under ``path``.

    ``chunk`` is the start offset of the file split holding the line and
    ``line_no`` increases within a split, so (chunk, line_no) orders a file.
    """
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").cast("bigint").alias("chunk"),
                      F.monotonically_increasing_id().alias("line_no"),
                      F.regexp_replace("value", "\r$", "").alias("line"))


def last_before(df: DataFrame, value, out: str, key: str = "file") -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row of ``key``, in
    (chunk, line_no) order.  Inside a chunk a window does it; across chunks the
    last value of every earlier chunk is carried in from the per-chunk table."""
    d = df.withColumn("_v", value)
    w = Window.partitionBy(key, "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    per = d.where(F.col("_v").isNotNull()).groupBy(key, "chunk").agg(F.max_by("_v", "line_no").alias("_lastv"))
    chunks = d.select(key, "chunk").distinct().join(per, [key, "chunk"], "left")
    wc = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(key, "chunk", F.last("_lastv", ignorenulls=True).over(wc).alias("_carry"))
    return d.join(carry, [key, "chunk"], "left").withColumn(out, F.coalesce("_in", "_carry")) \
            .drop("_v", "_in", "_carry")


def _pairs(s: DataFrame) -> DataFrame:
    """(problem_id, con, val) of RHS or RANGES lines, with or without a set name:
    one or two (row, value) pairs; an odd number of fields means a name leads."""
    named = F.size("tok") % 2 == 1
    at = lambda k: F.when(named, F.get(F.col("tok"), F.lit(k + 1))).otherwise(F.get(F.col("tok"), F.lit(k)))
    both = s.select("problem_id", F.explode(F.array(
        F.struct(at(0).alias("con"), at(1).alias("val")), F.struct(at(2).alias("con"), at(3).alias("val")))).alias("e"))
    return both.where(F.col("e.val").isNotNull()).select("problem_id", F.col("e.con").alias("con"), F.col("e.val").cast("double").alias("val"))


def parse_mps(lines: DataFrame, problem_id=None, sense: str = "min") -> Program:
    """MPS lines ``(file, [chunk,] line_no, line)`` → a program batch, one problem per file.

    ``problem_id`` defaults to ``xxhash64(file)``; pass a Column to override.
    ``sense`` is that of files without an OBJSENSE; the program has the sense of each file.
    Without a ``chunk`` column, lines are chunked by ``line_no div 2^20``.
    """
    if "chunk" not in lines.columns:
        lines = lines.withColumn("chunk", F.floor(F.col("line_no") / F.lit(1 << 20)).cast("bigint"))
    l = lines.where(~F.col("line").startswith("*") & (F.trim("line") != ""))
    head = F.split(F.trim("line"), r"\s+").getItem(0)
    is_header = ~F.col("line").rlike(r"^\s") & head.isin(*SECTIONS)
    l = last_before(l, F.when(is_header, head), "section")
    # "OBJSENSE MAX" on one line is a header with its value.
    inline = is_header & (head == "OBJSENSE") & (F.size(F.split(F.trim("line"), r"\s+")) > 1)
    text = F.when(inline, F.regexp_replace(F.trim("line"), r"^\S+\s+", "")).otherwise(F.trim("line"))
    l = l.where(~is_header | inline).withColumn("tok", F.split(text, r"\s+"))
    pid = problem_id if problem_id is not None else F.xxhash64("file")
    # The classified lines feed five readers (rows, columns, rhs, ranges,
    # bounds): one reliable checkpoint instead of five recomputations.
    l = cut(l.select("file", "chunk", "line_no", "section", "tok", pid.cast("bigint").alias("problem_id")))

    rows = l.where(F.col("section") == "ROWS").select(
        "problem_id", F.upper(F.get(F.col("tok"), 0)).alias("type"), F.get(F.col("tok"), 1).alias("con"), "chunk", "line_no")
    # The first N row of the file is the objective; others are free rows without effect.
    obj_row = rows.where(F.col("type") == "N").groupBy("problem_id").agg(F.min_by("con", F.struct("chunk", "line_no")).alias("obj_row"))
    # MAX, MAXIMIZE and the like; the last OBJSENSE line of a file counts.
    told = l.where(F.col("section") == "OBJSENSE").groupBy("problem_id").agg(
        F.max_by(F.lower(F.substring(F.get(F.col("tok"), F.lit(0)), 1, 3)), F.struct("chunk", "line_no")).alias("told"))

    col = l.where(F.col("section") == "COLUMNS")
    marker = F.get(F.col("tok"), 1) == "'MARKER'"
    # Integer marker state per line: the last INTORG/INTEND at or before it.
    mk = F.when(marker & (F.get(F.col("tok"), 2) == "'INTORG'"), F.lit(True)) \
          .when(marker & (F.get(F.col("tok"), 2) == "'INTEND'"), F.lit(False))
    col = last_before(col, mk, "is_int").withColumn("is_int", F.coalesce("is_int", F.lit(False))).where(~marker)
    # A COLUMNS record holds one or two (row, value) pairs after the column name.
    entries = col.select("problem_id", F.get(F.col("tok"), 0).alias("var"), "is_int", F.explode(F.array(
        F.struct(F.get(F.col("tok"), 1).alias("con"), F.get(F.col("tok"), 2).alias("val")),
        F.struct(F.get(F.col("tok"), 3).alias("con"), F.get(F.col("tok"), 4).alias("val")))).alias("e")) \
        .where(F.col("e.con").isNotNull()) \
        .select("problem_id", "var", "is_int", F.col("e.con").alias("con"), F.col("e.val").cast("double").alias("coef"))
    e = entries.join(obj_row, "problem_id", "left")
    obj = e.where(F.col("con") == F.col("obj_row")).groupBy("problem_id", "var").agg(F.sum("coef").alias("obj"))
    free_rows = rows.where(F.col("type") == "N").select("problem_id", "con")
    coefs = e.join(free_rows, ["problem_id", "con"], "left_anti").select("problem_id", "con", "var", "coef")
    var_int = entries.groupBy("problem_id", "var").agg(F.max("is_int").alias("is_int"))

    all_rhs = _pairs(l.where(F.col("section") == "RHS"))
    rhs = all_rhs.groupBy("problem_id", "con").agg(F.sum("val").alias("rhs"))
    ranges = _pairs(l.where(F.col("section") == "RANGES")).groupBy("problem_id", "con").agg(F.sum("val").alias("rng"))
    constant = rhs.join(obj_row, "problem_id").where((F.col("con") == F.col("obj_row")) & (F.col("rhs") != 0)).select(
        "problem_id", F.lit("#constant").alias("var"), F.lit(1.0).alias("lb"), F.lit(1.0).alias("ub"), (-F.col("rhs")).alias("obj"), F.lit(True).alias("is_int"))
    base = rows.where(F.col("type") != "N").join(rhs, ["problem_id", "con"], "left") \
               .join(ranges, ["problem_id", "con"], "left") \
               .withColumn("rhs", F.coalesce("rhs", F.lit(0.0)))
    sense_of = {"L": "<=", "G": ">=", "E": "="}
    # Without a range a row keeps its sense; with one it becomes two rows.
    plain = base.where(F.col("rng").isNull()).select(
        "problem_id", "con", F.create_map(*[x for kv in sense_of.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        [F.col("type")].alias("sense"), "rhs")
    rng = base.where(F.col("rng").isNotNull())
    lo = F.when(F.col("type") == "G", F.col("rhs")).when(F.col("type") == "L", F.col("rhs") - F.abs("rng")) \
          .when(F.col("rng") < 0, F.col("rhs") + F.col("rng")).otherwise(F.col("rhs"))
    hi = F.when(F.col("type") == "G", F.col("rhs") + F.abs("rng")).when(F.col("type") == "L", F.col("rhs")) \
          .when(F.col("rng") > 0, F.col("rhs") + F.col("rng")).otherwise(F.col("rhs"))
    ranged = rng.select("problem_id", "con", lo.alias("lo"), hi.alias("hi")).select(
        "problem_id", F.explode(F.array(
            F.struct(F.concat("con", F.lit("#lo")).alias("con"), F.lit(">=").alias("sense"), F.col("lo").alias("rhs")),
            F.struct(F.concat("con", F.lit("#hi")).alias("con"), F.lit("<=").alias("sense"), F.col("hi").alias("rhs")))).alias("r")
    ).select("problem_id", "r.*")
    ranged_names = rng.select("problem_id", "con")
    coefs_r = coefs.join(ranged_names, ["problem_id", "con"], "left_anti").unionByName(
        coefs.join(ranged_names, ["problem_id", "con"]).select(
            "problem_id", F.explode(F.array(F.concat("con", F.lit("#lo")), F.concat("con", F.lit("#hi")))).alias("con"),
            "var", "coef"))
    cons = plain.unionByName(ranged)

    # Type, [set,] variable, [value]: types without a value have two or three fields.
    bt = F.upper(F.get(F.col("tok"), F.lit(0)))
    valued = ~bt.isin("FR", "MI", "PL", "BV")
    fields = F.size("tok") - F.when(valued, F.lit(1)).otherwise(F.lit(0))
    b = l.where(F.col("section") == "BOUNDS").select(
        "problem_id", bt.alias("bt"),
        # A value may follow BV and the like all the same: then there are four fields.
        F.when(~valued & (F.size("tok") >= 4), F.get(F.col("tok"), F.lit(2))).otherwise(F.get(F.col("tok"), fields - 1)).alias("var"),
        F.when(valued, F.get(F.col("tok"), F.size("tok") - 1)).cast("double").alias("val"))
    bb = b.groupBy("problem_id", "var").agg(
        F.max(F.when(F.col("bt").isin("LO", "LI", "FX"), F.col("val"))
              .when(F.col("bt").isin("FR", "MI"), F.lit(float("-inf")))
              .when(F.col("bt") == "BV", F.lit(0.0))).alias("blb"),
        F.min(F.when(F.col("bt").isin("UP", "UI", "FX"), F.col("val"))
              .when(F.col("bt").isin("FR", "PL"), F.lit(float("inf")))
              .when(F.col("bt") == "BV", F.lit(1.0))).alias("bub"),
        F.max(F.col("bt").isin("BV", "LI", "UI")).alias("bint"))
    lower = F.coalesce("blb", F.when(F.col("bub") < 0, F.lit(float("-inf"))), F.lit(0.0))
    vars = var_int.join(obj, ["problem_id", "var"], "left").join(bb, ["problem_id", "var"], "left").select(
        "problem_id", "var", lower.alias("lb"),
        F.coalesce("bub", F.lit(float("inf"))).alias("ub"),
        F.coalesce("obj", F.lit(0.0)).alias("obj"),
        (F.col("is_int") | F.coalesce("bint", F.lit(False))).alias("is_int"))
    senses = l.select("problem_id").distinct().join(told, "problem_id", "left").select("problem_id", F.coalesce("told", F.lit(sense)).alias("sense"))
    return program_from_tables(vars.unionByName(constant), cons, coefs_r, senses)


def read_mps(spark: SparkSession, path: str, sense: str = "min") -> Program:
    """Read every MPS file under ``path`` into one program batch."""
    return parse_mps(mps_lines(spark, path), sense=sense)
