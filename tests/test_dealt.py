"""The checked model from one shuffle, tables dealt by problem, and nodes solved by listing their points."""

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica import session
from lattica.operators import model as M
from lattica.operators import nodes as K
from lattica.operators.bounds import effective_bounds, prepare_model
from lattica.operators.search import best_solution, prune_nodes
from lattica.plans import solve as S
from lattica.sources.program import Program, program_from_tables, root_nodes, unsupported_problems
from test_solve import brute, random_programs

VARS = "problem_id long, var string, lb double, ub double, obj double, is_int boolean"
CONS = "problem_id long, con string, sense string, rhs double"
COEFS = "problem_id long, con string, var string, coef double"
NAN, INF = float("nan"), float("inf")


def _rows(n=40):
    """Random programs of which every second has one defect, in turn, and one problem without rows."""
    vs, cs, ks = random_programs(seed=3, n=n)
    vs = [(p, f"{v}#é" if p % 5 == 0 else v, lb - 0.25, ub + 0.5, obj, i) for p, v, lb, ub, obj, i in vs] + [(n, "alone", 0.0, 1.0, 1.0, True)]
    ks = [(p, c, f"{v}#é" if p % 5 == 0 else v, a) for p, c, v, a in ks]
    v0, c0, k0 = ({r[0]: r for r in reversed(t)} for t in (vs, cs, ks))
    defects = [lambda p: vs.append(v0[p]), lambda p: cs.append(c0[p]), lambda p: ks.append(k0[p]), lambda p: ks.append((p, "c0", "nobody", 1.0)),
               lambda p: ks.append((p, "nowhere", v0[p][1], 1.0)), lambda p: vs.append((p, None, 0.0, 1.0, 1.0, True)), lambda p: cs.append((p, "z", "<", 1.0)),
               lambda p: cs.append((p, "z", None, 1.0)), lambda p: cs.append((p, None, "<=", 1.0)), lambda p: cs.append((p, "z", "<=", NAN)),
               lambda p: cs.append((p, "z", "<=", None)), lambda p: ks.append((p, None, v0[p][1], 1.0)), lambda p: ks.append((p, "c0", None, 1.0)),
               lambda p: vs.append((p, "z", 0.0, 1.0, None, True)), lambda p: vs.append((p, "z", None, 1.0, 1.0, True)), lambda p: vs.append((p, "z", 0.0, INF, 1.0, True)),
               lambda p: vs.append((p, "z", NAN, 1.0, 1.0, True)), lambda p: vs.append((p, "z", 0.0, 1.0, -INF, True)), lambda p: vs.append((p, "z", 0.0, 1.0, 1.0, False)),
               lambda p: vs.append((p, "z", 3.0, 1.0, 1.0, True))]
    for i, defect in enumerate(defects):
        defect(2 * i)
    vs.append((None, "x", 0.0, 1.0, 1.0, True)), cs.append((n + 1, "c", "<=", 1.0)), ks.append((n + 1, "c", "x", 1.0))
    return vs, cs, ks


def _program(spark, senses=None, n=40):
    vs, cs, ks = _rows(n)
    tables = spark.createDataFrame(vs, VARS), spark.createDataFrame(cs, CONS), spark.createDataFrame(ks, COEFS)
    return program_from_tables(*tables, "max" if senses is None else spark.createDataFrame(senses, "problem_id long, sense string"))


SENSES = [(p, s) for p in range(41) for s in (["MIN", "max"][p % 2],) if p != 7] + [(9, "max"), (11, "most"), (13, None), (77, "min")]


@pytest.mark.parametrize("senses", [None, SENSES])
@pytest.mark.parametrize("method", ["lagrangian", "box"])
def test_one_shuffle_finds_and_folds_what_the_operators_do(spark, monkeypatch, senses, method):
    program = _program(spark, senses)
    monkeypatch.setattr(M, "ROWS_PER_FOLD", 7)
    monkeypatch.setattr(M, "ROWS_PER_SLICE", 60)
    model, n_sound, n_bad = M.checked_model(program, session.Tables(spark, 3), M.rows_of(program), method)
    bad = {r[0] for r in unsupported_problems(program).collect()}
    there = {r[0] for r in program.vars.where("problem_id is not null").select("problem_id").distinct().collect()}
    got = {r["problem_id"]: r for r in model.collect()}
    assert set(got) == there and {p for p, r in got.items() if r["bad"]} == bad & there
    assert (n_sound, n_bad) == (len(there - bad), len(bad & there)) and n_bad > 15 and n_sound > 15
    keep = spark.createDataFrame([(p,) for p in bad], "problem_id long")
    left = lambda t: t.where("problem_id is not null").join(keep, "problem_id", "left_anti")
    clean = Program(left(program.vars), left(program.cons), left(program.coefs), program.sense if isinstance(program.sense, str) else left(program.sense))
    for want in prepare_model(clean, method).collect():
        for k in want.asDict():
            assert np.allclose(got[want["problem_id"]][k], want[k]) if k == "lam" else got[want["problem_id"]][k] == want[k], (want["problem_id"], k)


def test_dealt_tables_meet_without_a_shuffle_and_go_when_dropped(spark):
    tables = session.Tables(spark, 3)
    program = program_from_tables(*(spark.createDataFrame(t, s) for t, s in zip(random_programs(seed=5, n=30), (VARS, CONS, COEFS))))
    known = S.prepare(program)
    nodes = tables.deal(root_nodes(program.vars).withColumns({"var": F.lit("x0"), "cand_obj": F.lit(1.0)}))
    points = nodes.select("problem_id", F.col("cand_obj").alias("objective"), F.lit("feasible").alias("status"), F.array(F.lit(1.0)).alias("values"), "node_id")
    best = tables.put(best_solution(points))
    with session.as_dealt(spark):
        for df in (best_solution(points), prune_nodes(nodes, best), nodes.groupBy("problem_id", "node_id").count()):
            assert "Exchange hash" not in df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in effective_bounds(root_nodes(known.model), S._variables(known.sound()))._jdf.queryExecution().executedPlan().toString()
    assert best.count() == 30 and not [t for t in spark.catalog.listTables() if t.name.startswith("lattica")]
    folder = tables.folders[id(best)][1].removeprefix("file:")
    assert os.path.isdir(folder)
    tables.drop(best)
    assert not os.path.exists(folder)


def test_a_hot_problem_is_read_as_plain_files(spark, monkeypatch):
    rows = spark.range(4000).select(F.when(F.col("id") < 3900, 1).otherwise(F.col("id")).alias("problem_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    even = session.Tables(spark, 8).deal(rows)
    plan = lambda table: table.groupBy("problem_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan(even) and "Exchange" not in plan(even)
    monkeypatch.setattr(session, "HOT_BYTES", 1000)
    table = session.Tables(spark, 8).deal(rows)
    assert "Bucketed: true" not in plan(table) and "Exchange" in plan(table) and table.count() == 4000


def test_a_search_leaves_only_its_last_tables(spark):
    vs, cs, ks = random_programs(seed=11, n=40)
    program = program_from_tables(spark.createDataFrame(vs, VARS), spark.createDataFrame(cs, CONS), spark.createDataFrame(ks, COEFS))
    known = S.prepare(program)
    res = S.solve(program, prepared=known, list_points=0)
    assert res.levels > 2 and {r["problem_id"]: r["objective"] for r in res.incumbent.collect()} == brute(vs, cs, ks, "min")
    # The checked model, the open nodes (none) and the incumbents of the problems set aside at each halving.
    assert len(known.tables.folders) <= 3 + 6 < 3 * res.levels + 2


def _lists(rows):
    return pa.array([[float(x) for x in r] for r in rows], pa.list_(pa.float64()))


def test_listed_nodes_have_the_optimum_of_their_box():
    rnd = random.Random(8)
    c, l, u, a, b, want = [], [], [], [], [], []
    for _ in range(200):
        n, m = rnd.randint(1, 5), rnd.randint(0, 3)
        c.append([rnd.randint(-9, 9) for _ in range(n)]), l.append([rnd.randint(-2, 1) for _ in range(n)])
        u.append([x + rnd.choice((0, 1, 1, 2, 6)) for x in l[-1]])
        rows = [[rnd.randint(-5, 5) for _ in range(n)] for _ in range(m)]
        a.append([x for r in rows for x in r]), b.append([rnd.randint(-4, 9) for _ in range(m)])
        points = [x for x in itertools.product(*[range(i, j + 1) for i, j in zip(l[-1], u[-1])]) if all(sum(p * q for p, q in zip(r, x)) <= s for r, s in zip(rows, b[-1]))]
        want.append(min((sum(p * q for p, q in zip(c[-1], x)) for x in points), default=None))
    n = len(c)
    args = [_lists(t) for t in (c, l, u, a, b, [[0.0] * len(x) for x in b])] + [pa.array([None] * n, pa.list_(pa.float64())), pa.array([None] * n, pa.float64()), pa.array([1.0] * n)] + [pa.array([True] * n)] * 2
    small = [np.prod([j - i + 1.0 for i, j in zip(x, y)]) <= 64 for x, y in zip(l, u)]
    out = K.relaxed(0, K.NODE_STEPS, *args, score="least reduced cost", points=64).to_pylist()
    assert 20 < sum(small) < n
    for i, (r, best) in enumerate(zip(out, want)):
        if small[i]:
            assert r["infeasible"] == (best is None) and r["cand_obj"] == r["bound"] == best and (best is None or r["cand_kind"] is not None)
            if best is not None:
                assert sum(p * q for p, q in zip(c[i], r["cand_x"])) == best
        elif not r["infeasible"]:
            assert best is None or r["bound"] <= best <= (r["cand_obj"] if r["cand_obj"] is not None else 1e300)


def test_small_programs_take_one_level(spark):
    vs, cs, ks = random_programs(seed=11, n=40)
    program = program_from_tables(spark.createDataFrame(vs, VARS), spark.createDataFrame(cs, CONS), spark.createDataFrame(ks, COEFS), "max")
    res = S.solve(program, list_points=10_000)
    assert (res.levels, res.nodes) == (1, 40)
    assert {r["problem_id"]: r["objective"] for r in res.incumbent.collect()} == brute(vs, cs, ks, "max")
