"""Random small integer programs, solved in one batch, against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from lattica.operators.bounds import bound_nodes, by_cost
from lattica.plans.solve import solve
from lattica.sources.program import program_from_tables, root_nodes

N_PROBLEMS = 60


def random_programs(seed=7, n=N_PROBLEMS):
    rnd = random.Random(seed)
    vs, cs, ks = [], [], []
    for pid in range(n):
        nv = rnd.randint(2, 5)
        for j in range(nv):
            vs.append((pid, f"x{j}", float(rnd.choice([-1, 0])), float(rnd.choice([1, 2, 3])),
                       float(rnd.randint(-9, 9)), True))
        for r in range(rnd.randint(1, 3)):
            cs.append((pid, f"c{r}", rnd.choice(["<=", ">=", "="]), float(rnd.randint(-6, 8))))
            for j in range(nv):
                a = rnd.randint(-5, 5)
                if a:
                    ks.append((pid, f"c{r}", f"x{j}", float(a)))
    return vs, cs, ks


def brute(vs, cs, ks, sense):
    out = {}
    for pid in {v[0] for v in vs}:
        var = [v for v in vs if v[0] == pid]
        names = [v[1] for v in var]
        rows = [c for c in cs if c[0] == pid]
        coef = {(k[1], k[2]): k[3] for k in ks if k[0] == pid}
        best = None
        for xs in itertools.product(*[range(int(v[2]), int(v[3]) + 1) for v in var]):
            x = dict(zip(names, xs))
            ok = True
            for _, con, s, rhs in rows:
                act = sum(coef.get((con, n), 0.0) * x[n] for n in names)
                ok &= (act <= rhs) if s == "<=" else (act >= rhs) if s == ">=" else (act == rhs)
            if ok:
                obj = sum(v[4] * x[v[1]] for v in var)
                if best is None or (obj < best if sense == "min" else obj > best):
                    best = obj
        out[pid] = best
    return out


def _check(spark, sense, method):
    vs, cs, ks = random_programs(seed=11 if sense == "min" else 5)
    p = program_from_tables(
        spark.createDataFrame(vs, "problem_id long, var string, lb double, ub double, obj double, is_int boolean"),
        spark.createDataFrame(cs, "problem_id long, con string, sense string, rhs double"),
        spark.createDataFrame(ks, "problem_id long, con string, var string, coef double"), sense)
    res = solve(p, method=method)
    got = {r["problem_id"]: (r["objective"], r["status"]) for r in res.incumbent.collect()}
    want = brute(vs, cs, ks, sense)
    assert set(got) == set(want)
    n_inf = 0
    for pid, best in want.items():
        obj, status = got[pid]
        if best is None:
            n_inf += 1
            assert status == "infeasible" and obj is None, pid
        else:
            assert status == "optimal" and abs(obj - best) < 1e-9, (pid, obj, best)
    assert 0 < n_inf < len(want)
    # Solution maps satisfy their own objective.
    vals = res.incumbent.where("status = 'optimal'").select("problem_id", "objective", F.explode("values").alias("var", "x"))
    v = spark.createDataFrame(vs, "problem_id long, var string, lb double, ub double, obj double, is_int boolean")
    chk = vals.join(v, ["problem_id", "var"]).groupBy("problem_id").agg(
        F.first("objective").alias("o"), F.sum(F.col("obj") * F.col("x")).alias("s"))
    assert chk.where(F.abs(F.col("o") - F.col("s")) > 1e-9).count() == 0


def test_random_min_lagrangian(spark):
    _check(spark, "min", "lagrangian")


def test_random_max_box(spark):
    _check(spark, "max", "box")


def _program(spark, sense="min", seed=11, n=12):
    vs, cs, ks = random_programs(seed=seed, n=n)
    p = program_from_tables(
        spark.createDataFrame(vs, "problem_id long, var string, lb double, ub double, obj double, is_int boolean"),
        spark.createDataFrame(cs, "problem_id long, con string, sense string, rhs double"),
        spark.createDataFrame(ks, "problem_id long, con string, var string, coef double"), sense)
    return p, brute(vs, cs, ks, sense)


def _values(res):
    return {r["problem_id"]: r["objective"] for r in res.incumbent.collect()}


def test_budget_order_and_resume_keep_the_optimum(spark):
    p, want = _program(spark)
    whole = solve(p, budget=2, n_buckets=3, depth_first=True, branch_rule=by_cost, easy_when=F.col("depth") > 1)
    assert _values(whole) == want
    part = solve(p, max_iterations=2)
    states = {r["status"] for r in part.incumbent.collect()}
    assert part.levels == 2 and states <= {"optimal", "feasible", "unknown", "infeasible"}
    rest = solve(p, frontier=part.frontier, incumbent=part.incumbent)
    assert _values(rest) == want
    assert {r["status"] for r in rest.incumbent.collect()} == {"optimal", "infeasible"}


def test_gap_halts_subtrees_within_it(spark):
    p, want = _program(spark, "max", seed=5)
    res = solve(p, rel_gap=0.5)
    for r in res.incumbent.collect():
        best = want[r["problem_id"]]
        if best is None:
            assert r["status"] == "infeasible"
        else:
            assert r["status"] == "feasible" and r["objective"] <= best and best - r["objective"] <= 0.5 * abs(r["objective"]) + 1e-6
    m = res.metrics.collect()
    assert len(m) == res.levels and all(r["n_open"] == r["n_easy"] + r["n_hard"] for r in m)
    assert all(r["n_pruned"] >= 0 and r["n_completed"] >= 0 for r in m)


def test_unsupported_problems_are_refused_and_boxes_rounded(spark):
    vs = [(1, "x", 0.0, 2.7, 1.0, True), (2, "x", 0.0, 9.0, 1.0, False), (3, "x", 0.0, float("inf"), 1.0, True),
          (4, "x", 0.0, 1.0, 1.0, True), (4, "x", 0.0, 1.0, 1.0, True), (5, "x", 0.0, 1.0, 1.0, True), (6, "x", 0.2, 0.9, 1.0, True),
          (7, "x", 0.0, 3.0, 1.0, True)]
    cs = [(1, "c", "<=", 9.0), (2, "c", "<=", 3.0), (5, "c", "<=", 1.0), (7, "empty", ">=", 1.0)]
    ks = [(1, "c", "x", 1.0), (2, "c", "x", 2.0), (5, "c", "y", 1.0)]
    p = program_from_tables(
        spark.createDataFrame(vs, "problem_id long, var string, lb double, ub double, obj double, is_int boolean"),
        spark.createDataFrame(cs, "problem_id long, con string, sense string, rhs double"),
        spark.createDataFrame(ks, "problem_id long, con string, var string, coef double"), "max")
    got = {r["problem_id"]: (r["status"], r["objective"], r["values"]) for r in solve(p).incumbent.collect()}
    assert got[1] == ("optimal", 2.0, {"x": 2.0})
    assert {k: got[k][0] for k in (2, 3, 4, 5)} == dict.fromkeys((2, 3, 4, 5), "error")
    assert got[6][0] == got[7][0] == "infeasible"  # no integer in the box; an empty row that cannot hold


def test_root_multipliers_give_valid_and_better_bounds(spark):
    p, want = _program(spark, seed=3, n=40)
    roots = root_nodes(p.vars)
    box = {r["problem_id"]: r["bound"] for r in bound_nodes(roots, p, "box", rounds=0).collect() if not r["infeasible"]}
    lag = {r["problem_id"]: r["bound"] for r in bound_nodes(roots, p, "lagrangian", rounds=0).collect() if not r["infeasible"]}
    assert all(lag[k] >= box[k] for k in lag) and any(lag[k] > box[k] for k in lag)
    assert all(want[k] is None or lag[k] <= want[k] for k in lag)
