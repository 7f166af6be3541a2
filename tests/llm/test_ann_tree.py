"""Nearest neighbours: exact against brute force when all leaves are visited, recall when calibrated."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from lattica.llm import ann_tree, queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int"


def _takes_part(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)


def _brute(rows, step, k):
    """(query_id, rank, vec_id, score) with every row a row of its own."""
    usable = [(i, np.array(v, np.float64)) for i, v, *_ in rows if _takes_part(v)]
    out = []
    for place, (q, x) in enumerate(usable):
        if q is None or q % step:
            continue
        with np.errstate(over="ignore"):
            near = [(float(np.linalg.norm(x - y)), i is None, i) for other, (i, y) in enumerate(usable) if other != place and len(y) == len(x)]
        near.sort(key=lambda n: (n[0], n[1], n[2] or 0))
        out += [(q, rank, i, d) for rank, (d, _, i) in enumerate(near[:k], 1)]
    return out


def _same(got, want):
    key = lambda r: (r[0], r[1], r[3], str(r[2]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-12, abs_tol=1e-300), (g, w)


def _awkward():
    rng = np.random.default_rng(4)
    f = lambda v: [float(np.float32(c)) for c in v]
    rows = [(i, f(rng.standard_normal(8) + 3 * (i % 5)), i % 3) for i in range(400)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, 0) for i in range(200)]                     # a third of all rows hold one vector
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 0), (40, rows[40][1], 0), (60, rows[61][1], 0), (50, rows[51][1], 1)]
    rows += [(3000 + i, f(rng.standard_normal(3)), 0) for i in range(30)]  # another length
    rows += [(4000, [1.0, 2.0], 0)]                                       # the only one of its length
    rows += [(5000, None, 0), (5010, [], 0), (5020, [0.0] * 8, 0), (5030, [1.0] * 7 + [None], 0), (5040, [float("nan")] * 8, 0),
             (5050, [float("inf")] + [1.0] * 7, 0), (None, rows[3][1], 0), (None, None, None), (5060, [-0.0] * 7 + [1.0], 0), (5070, [0.0] * 7 + [1.0], 0)]
    rows += [(6000 + i, [float(i % 2), float(i // 2 % 2), 9.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(40)]  # ties
    return rows


def test_all_leaves_visited_equals_brute_force(spark):
    rows = _awkward()
    df = spark.createDataFrame(rows, SCHEMA).toDF("vec_id", "embedding", "Vec_ID2").withColumns({"a": F.lit(1), "leaf": F.lit(2), "score": F.lit("x")})
    want = _brute(rows, 10, 5)
    for leaf, tile in ((16, 64), (10_000, 64)):
        _same(ann_tree.nearest(df, F.col("vec_id") % 10 == 0, k=5, leaf=leaf, tile=tile, visits=10**6).collect(), want)
    assert len(want) > 300


def test_integers_doubles_and_extreme_values(spark):
    rows = [(i, [float(3 * i % 7), float(i % 5), 1.0]) for i in range(60)]
    ints = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in rows], "vec_id long, embedding array<int>")
    _same(ann_tree.nearest(ints, F.col("vec_id") % 10 == 0, k=4, visits=99).collect(), _brute(rows, 10, 4))
    rows = [(i, [s * 10.0 ** e, 1.0]) for i, (s, e) in enumerate((s, e) for e in (-300, -160, 0, 160, 300) for s in (1, 2, 3))]
    got = ann_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 14, k=2).collect()
    assert [(r["vec_id"], round(r["score"] / 1e300, 9)) for r in sorted(got, key=lambda r: r["rank"])] == [(13, 1.0), (12, 2.0)]


def test_fewer_candidates_no_queries_and_an_empty_table(spark, tmp_path):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (100, [0.0, 1.0], 0), (7, [1.0, 1.0], 0)], SCHEMA)
    few.write.parquet(str(tmp_path / "few" / "embeddings.parquet"))
    _same(queries.op12_nearest_neighbours(spark, str(tmp_path / "few")).collect(), _brute([tuple(r) for r in few.collect()], 100, 10))
    assert ann_tree.nearest(few, F.col("vec_id") == 5).count() == 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    out = queries.op12_nearest_neighbours(spark, str(tmp_path / "none"))
    assert out.count() == 0 and out.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("spread", [0.15, 1.0])
def test_calibrated_visits_reach_the_recall(spark, spread):
    rng = np.random.default_rng(8)
    topics = rng.standard_normal((12, 24))
    own = rng.integers(0, 12, 6_000)
    own[:2_000] = 0  # a topic with a third of all rows
    x = (topics[own] + spread * rng.standard_normal((6_000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    got = ann_tree.nearest(df, F.col("vec_id") % 20 == 0, leaf=64).collect()
    x = x.astype(np.float64)
    found = {}
    for r in got:
        assert math.isclose(r["score"], float(np.linalg.norm(x[r["query_id"]] - x[r["vec_id"]])), rel_tol=1e-12)
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = 0
    for q in range(0, 6_000, 20):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        assert sorted(found[q]) == list(range(1, 11))
        hits += len({*found[q].values()} & {*np.argsort(d, kind="stable")[:10].tolist()})
    assert hits / 3_000 >= 0.94


def test_visits_are_few_where_vectors_cluster(spark):
    """Calibration does not simply visit everything."""
    rng = np.random.default_rng(3)
    topics = 4 * rng.standard_normal((40, 16))
    x = topics[rng.integers(0, 40, 8_000)] + 0.3 * rng.standard_normal((8_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    vectors, asked = ann_tree.vectors_of(df, F.col("vec_id") % 50 == 0, 10)
    trees = ann_tree.fit_trees(vectors, 64)
    visits = ann_tree.calibrated_visits(ann_tree.place(vectors, trees), asked, trees, 10, 0.96)
    assert trees[16].n_leaves > 60 and 1 < visits < trees[16].n_leaves / 3


def test_best_first_meets_every_leaf_once_nearest_first():
    rng = random.Random(2)
    x = np.array([[rng.gauss(0, 1) for _ in range(6)] for _ in range(900)])
    tree = ann_tree.KMeansTree(x, 10, branch=5, first_leaf=3)
    leaves = list(tree.best_first(x[0]))
    assert sorted(leaves) == list(range(3, 3 + tree.n_leaves)) and tree.n_leaves > 80
    assert leaves[0] == tree.assign(x[:1])[0]
    same = ann_tree.KMeansTree(np.ones((50, 4)), 10)
    assert same.n_leaves == 1 and list(same.best_first(np.zeros(4))) == [0]
