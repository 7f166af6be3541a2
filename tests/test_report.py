from pyspark.sql import functions as F

from lattica.operators import balance as B
from lattica.operators import report as R
from lattica.sources.program import check_program, program_from_tables


def test_solution_rows_and_assemble_round_trip(spark):
    inc = spark.createDataFrame([(1, 5.0, "optimal", {"x": 1.0, "y": 0.0}), (2, None, "infeasible", None)],
                                "problem_id long, objective double, status string, values map<string,double>")
    rows = R.solution_rows(inc)
    assert rows.count() == 3  # two values for problem 1, one empty row for problem 2
    back = R.assemble_solution(rows.where(F.col("var").isNotNull())).collect()
    assert [(r["problem_id"], r["values"]) for r in back] == [(1, {"x": 1.0, "y": 0.0})]
    got = R.assemble_solution(rows.where(F.col("var").isNotNull())).select(
        R.variable_value("values", F.lit("x")).alias("x")).first()["x"]
    assert got == 1.0


def test_plan_accessors(spark):
    moves = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (3, 1, 4)], "src int, dst int, n bigint")
    assert sorted(r["src"] for r in B.makes_donations(moves).collect()) == [0, 3]
    assert sorted((r["dst"], r["n"]) for r in B.receivers(moves, 0).collect()) == [(1, 2), (2, 1)]
    pairs = spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int")
    assert sorted((r["src"], r["dst"], r["n"]) for r in B.donation(moves, pairs).collect()) == [(0, 1, 2), (1, 0, 0)]
    m2 = B.add_donation(moves, 0, 1, 7)
    assert sorted((r["src"], r["dst"], r["n"]) for r in m2.collect()) == [(0, 1, 7), (0, 2, 1), (3, 1, 4)]


def test_check_program_findings(spark):
    vars = spark.createDataFrame([(1, "x", 0.0, 1.0, 1.0, True), (1, "y", 0.0, 1.0, 1.0, True),
                                  (1, "z", 2.0, 1.0, 1.0, False)],
                                 "problem_id long, var string, lb double, ub double, obj double, is_int boolean")
    cons = spark.createDataFrame([(1, "c", "<=", 1.0), (1, "d", "<>", 1.0)], "problem_id long, con string, sense string, rhs double")
    coefs = spark.createDataFrame([(1, "c", "x", 1.0), (1, "c", "x", 2.0), (1, "c", "w", 1.0), (1, "d", "z", 1.0)],
                                  "problem_id long, con string, var string, coef double")
    got = {(r["kind"], r["name"]) for r in check_program(program_from_tables(vars, cons, coefs)).collect()}
    assert got == {("uncovered_var", "y"), ("unknown_var", "w"), ("duplicate_coef", "c/x"), ("bad_sense", "d"),
                   ("continuous_var", "z"), ("empty_domain", "z")}
