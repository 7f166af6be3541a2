from pyspark.sql import functions as F

from lattica.plans.solve import solve
from lattica.sources.mps import parse_mps, read_mps

MPS = """NAME          TINY
ROWS
 N  obj
 L  c1
 G  c2
 E  c3
COLUMNS
    MARKER                 'MARKER'                 'INTORG'
    x         obj       -3.0   c1        1.0
    x         c2         1.0
    y         obj       -2.0   c1        1.0
    y         c3         1.0
    MARKER                 'MARKER'                 'INTEND'
RHS
    RHS       c1         4.0   c2        1.0
    RHS       c3         2.0
BOUNDS
 UP BND       x          3.0
 UP BND       y          5.0
ENDATA"""


def test_parse_and_solve(spark):
    lines = spark.createDataFrame([("f", i, l) for i, l in enumerate(MPS.split("\n"))], "file string, line_no long, line string")
    p = parse_mps(lines, problem_id=F.lit(1).cast("bigint"))
    v = {r["var"]: (r["lb"], r["ub"], r["obj"], r["is_int"]) for r in p.vars.collect()}
    assert v == {"x": (0.0, 3.0, -3.0, True), "y": (0.0, 5.0, -2.0, True)}
    cons = {r["con"]: (r["sense"], r["rhs"]) for r in p.cons.collect()}
    assert cons == {"c1": ("<=", 4.0), "c2": (">=", 1.0), "c3": ("=", 2.0)}
    r = solve(p).incumbent.first()
    # y = 2 (row c3), x <= 2 (row c1): min -3x - 2y = -10.
    assert r["status"] == "optimal" and r["objective"] == -10.0


FULL = """* every record type
NAME          FULL
OBJSENSE
    MAX
ROWS
 N  zcost
 N  aother
 L  c1
 G  c2
 E  c3
COLUMNS
    x         zcost     2.0   c1        1.0
    x         aother    9.0   c2        1.0
    MARKER                 'MARKER'                 'INTORG'
    y         zcost     1.0   c3        1.0
    z         zcost     1.0   c1        1.0
    u         c3        1.0   c2        1.0
    v         c3        1.0
    w         c1        2.0
    MARKER                 'MARKER'                 'INTEND'
RHS
    zcost     -7.0  c1        4.0
    c2        1.0
    c3        2.0
RANGES
    RNG       c1        3.0   c2        2.5
    c3        -1.0
BOUNDS
 UP x 3.0
 LO BND       x         -2.0
 UP BND       y         -5.0
 BV BND       z
 MI u
 UP BND       u         4.0
 FX v 2.0
 FR BND       w
ENDATA"""

WANT_VARS = {"x": (-2.0, 3.0, 2.0, False), "y": (float("-inf"), -5.0, 1.0, True), "z": (0.0, 1.0, 1.0, True), "u": (float("-inf"), 4.0, 0.0, True),
             "v": (2.0, 2.0, 0.0, True), "w": (float("-inf"), float("inf"), 0.0, True), "#constant": (1.0, 1.0, 7.0, True)}
WANT_CONS = {"c1#lo": (">=", 1.0), "c1#hi": ("<=", 4.0), "c2#lo": (">=", 1.0), "c2#hi": ("<=", 3.5), "c3#lo": (">=", 1.0), "c3#hi": ("<=", 2.0)}


def _parts(p):
    return ({r["var"]: (r["lb"], r["ub"], r["obj"], r["is_int"]) for r in p.vars.collect()},
            {r["con"]: (r["sense"], r["rhs"]) for r in p.cons.collect()})


def test_every_record_type(spark):
    lines = spark.createDataFrame([("f", i, l) for i, l in enumerate(FULL.split("\n"))], "file string, line_no long, line string")
    p = parse_mps(lines)
    assert _parts(p) == (WANT_VARS, WANT_CONS)
    assert {r["con"] for r in p.coefs.collect()} == set(WANT_CONS)
    own = parse_mps(lines.withColumn("line", F.when(F.trim("line") == "MAX", "    MIN").otherwise(F.col("line"))))
    assert _parts(own)[0]["x"][2] == 2.0


def test_read_files_in_several_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"m{k}.mps").write_text(FULL.replace("\n", "\r\n" if k == 1 else "\n") + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        p = read_mps(spark, str(tmp_path))
        assert p.vars.select("problem_id").distinct().count() == 3
        for (pid,) in p.vars.select("problem_id").distinct().collect():
            vars_ = {r["var"]: (r["lb"], r["ub"], r["obj"], r["is_int"]) for r in p.vars.where(F.col("problem_id") == pid).collect()}
            assert vars_ == WANT_VARS
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
