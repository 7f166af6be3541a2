"""Findings of a program's tables, dealt over tasks or not."""

import pytest

from lattica.sources import program as P

VARS = "problem_id long, var string, lb double, ub double, obj double, is_int boolean"
NAN, INF = float("nan"), float("inf")


def _odd(spark):
    vs = [(1, "x", 0.0, 1.0, 1.0, True), (1, "x", 0.0, 1.0, 1.0, True), (1, "y", 0.0, 1.0, 1.0, True), (1, "y", 0.0, 1.0, 1.0, True), (1, None, 0.0, 1.0, 1.0, True),
          (None, "x", 0.0, 1.0, 1.0, True), (2, "x", 3.0, 1.0, NAN, False), (2, "z", 0.0, INF, 1.0, True), (2, "w", NAN, 1.0, None, True)]
    cs = [(1, "c", "<=", 1.0), (1, "c", "<=", 1.0), (None, "c", "<=", 1.0), (2, "c", "<", NAN), (2, None, None, 1.0)]
    ks = [(1, "c", "x", 1.0), (1, "c", "x", 2.0), (1, "d", "q", 1.0), (1, "d", "q", 1.0), (1, None, "x", 1.0), (None, "c", "x", 1.0), (2, "c", "x", None), (2, "c", None, INF)]
    return P.Program(spark.createDataFrame(vs, VARS), spark.createDataFrame(cs, "problem_id long, con string, sense string, rhs double"),
                     spark.createDataFrame(ks, "problem_id long, con string, var string, coef double"))


WANT = sorted([
    (1, "uncovered_var", "y"), (1, "uncovered_var", "y"), (1, "uncovered_var", None), (None, "uncovered_var", "x"), (2, "uncovered_var", "z"), (2, "uncovered_var", "w"),
    (1, "unknown_var", "q"), (None, "unknown_var", "x"), (1, "unknown_con", "d"), (None, "unknown_con", "c"),
    (1, "duplicate_var", "x"), (1, "duplicate_var", "y"), (1, "duplicate_con", "c"), (1, "duplicate_coef", "c/x"), (1, "duplicate_coef", "d/q"),
    (2, "bad_sense", "c"), (2, "continuous_var", "x"), (2, "infinite_bound", "z"), (2, "empty_domain", "x"),
    (1, "null_value", None), (2, "null_value", "w"), (2, "null_value", None), (1, "null_value", "x"), (2, "null_value", "c/x"), (2, "null_value", "c"),
    (2, "not_finite", "x"), (2, "not_finite", "w"), (2, "not_finite", "c"), (2, "not_finite", "c")], key=str)


@pytest.mark.parametrize("rows", [1, 500_000])
def test_findings_are_the_same_over_any_number_of_tasks(spark, monkeypatch, rows):
    monkeypatch.setattr(P, "ROWS_PER_TASK", rows, raising=True)
    found = P.check_program(_odd(spark))
    assert sorted((tuple(r) for r in found.collect()), key=str) == WANT


def test_large_tables_get_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_TASK", 100)
    assert P._tasks(spark.range(2_000), spark.range(3_050)) == 51
    monkeypatch.setattr(P, "ROWS_PER_TASK", 10_000)
    assert P._tasks(spark.range(2_000), spark.range(3_050)) is None
