"""Node arithmetic on batches: sizes mixed in one batch, small trees, brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa

from lattica.operators import nodes as K
from lattica.plans.solve import solve
from lattica.sources.program import program_from_tables


def _programs(seed, sizes):
    """Orders of so many lines: 0 to 2 units of each, as many units as lines, seven tenths of the weight."""
    rnd = random.Random(seed)
    return [([rnd.randint(900, 90_000) for _ in range(n)], [rnd.randint(1, 50) for _ in range(n)]) for n in sizes]


def _best(v, w):
    need = -(-7 * sum(w) // 10)
    points = (x for x in itertools.product(range(3), repeat=len(v)) if sum(x) == len(v) and sum(a * b for a, b in zip(w, x)) >= need)
    return min(sum(a * b for a, b in zip(v, x)) for x in points)


def test_trees_of_several_rows_stay_small(spark):
    programs = _programs(4, [6] * 12)
    vs = [(p, f"x{j}", 0.0, 2.0, float(c), True) for p, (v, _) in enumerate(programs) for j, c in enumerate(v)]
    cs = [row for p, (v, w) in enumerate(programs) for row in ((p, "cover", ">=", float(-(-7 * sum(w) // 10))), (p, "count", "=", float(len(v))))]
    ks = [row for p, (v, w) in enumerate(programs) for j in range(len(v)) for row in ((p, "cover", f"x{j}", float(w[j])), (p, "count", f"x{j}", 1.0))]
    program = program_from_tables(
        spark.createDataFrame(vs, "problem_id long, var string, lb double, ub double, obj double, is_int boolean"),
        spark.createDataFrame(cs, "problem_id long, con string, sense string, rhs double"),
        spark.createDataFrame(ks, "problem_id long, con string, var string, coef double"), "min")
    res = solve(program)
    assert {r["problem_id"]: r["objective"] for r in res.incumbent.collect()} == {p: _best(v, w) for p, (v, w) in enumerate(programs)}
    assert res.nodes <= 20 * len(programs)  # 48 a problem on Q23 with steps only and branches on the greatest reduced cost


def _batch(programs):
    lists = lambda rows: pa.array([[float(x) for x in r] for r in rows], pa.list_(pa.float64()))
    n = len(programs)
    a = [[-x for x in w] + [-1] * len(w) + [1] * len(w) for _, w in programs]
    b = [(7 * sum(w) // -10, -len(w), len(w)) for _, w in programs]
    return [lists(v for v, _ in programs), lists([0] * len(v) for v, _ in programs), lists([2] * len(v) for v, _ in programs), lists(a), lists(b),
            lists([[0, 0, 0]] * n), lists([[1, 1, 1]] * n), pa.array([None] * n, pa.float64()), pa.array([1.0] * n), pa.array([True] * n), pa.array([True] * n)]


def test_a_batch_of_many_sizes_equals_its_nodes_alone(monkeypatch):
    programs = _programs(9, [1, 6, 3, 40, 6, 17, 2, 5])
    whole = K.relaxed(2, K.NODE_STEPS, *_batch(programs)).to_pylist()
    monkeypatch.setattr(K, "CELLS", 1)
    assert whole == K.relaxed(2, K.NODE_STEPS, *_batch(programs)).to_pylist()
    alone = [K.relaxed(2, K.NODE_STEPS, *_batch([p])).to_pylist()[0] for p in programs]
    for got, want, (v, w) in zip(whole, alone, programs):
        assert got["cand_x"] == want["cand_x"] and np.isclose(got["bound"], want["bound"])
        if len(v) < 7:
            assert got["bound"] <= _best(v, w) <= (got["cand_obj"] or 1e300)
    assert K.relaxed(2, K.NODE_STEPS, *[x.slice(0, 0) for x in _batch(programs)]).to_pylist() == []
