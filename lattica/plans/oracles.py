"""DuckDB oracle SQL for the test queries (same column names and types)."""

from __future__ import annotations

LINE_VAR = "concat_ws(':', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT))"
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
WI = f"""wi AS (
    SELECT CAST(l_suppkey % 40 AS INTEGER) AS bucket, l_quantity >= 25 AS hard, l_linestatus = 'O' AS mov,
           CAST(l_partkey % 24 AS INTEGER) AS grp, {CENTS} AS v
    FROM lineitem)"""
BUCKETS = "bk AS (SELECT CAST(range AS INTEGER) AS bucket FROM range(40))"
# Item order inside an order (for brute force): every distinguishing column.
ITEM_ORDER = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
              "l_shipdate, l_returnflag, l_linestatus")


def _pass_sql(p: str, src: str, t: str) -> str:
    """One greedy donation pass as a unit-level rank join (slots vs units)."""
    return f"""
r{p} AS (SELECT bucket, unnest(generate_series(load, {t} - 1)) AS lvl FROM {src} WHERE load < {t}),
rr{p} AS (SELECT bucket, row_number() OVER (ORDER BY lvl, bucket) AS k FROM r{p}),
d{p} AS (SELECT bucket, unnest(generate_series(load, load - least(mov, load - {t}) + 1, -1)) AS lvl
         FROM {src} WHERE load > {t} AND mov > 0),
dd{p} AS (SELECT bucket, row_number() OVER (ORDER BY lvl DESC, bucket) AS k FROM d{p}),
m{p} AS (SELECT dd{p}.bucket AS src, rr{p}.bucket AS dst, count(*) AS n FROM rr{p} JOIN dd{p} USING (k) GROUP BY 1, 2)"""


PLAN_CTES = f"""{WI}, {BUCKETS},
c0 AS (SELECT bk.bucket,
              CAST(coalesce(sum(CASE WHEN hard THEN 1 ELSE 0 END), 0) AS BIGINT) AS load,
              CAST(coalesce(sum(CASE WHEN hard AND mov THEN 1 ELSE 0 END), 0) AS BIGINT) AS mov
       FROM bk LEFT JOIN wi USING (bucket) GROUP BY bk.bucket),
{_pass_sql('1', 'c0', '5')},
c1 AS (SELECT c0.bucket, c0.load - coalesce(o.n, 0) + coalesce(i.n, 0) AS load,
              c0.mov - coalesce(o.n, 0) + coalesce(i.n, 0) AS mov
       FROM c0 LEFT JOIN (SELECT src AS bucket, CAST(sum(n) AS BIGINT) AS n FROM m1 GROUP BY 1) o USING (bucket)
               LEFT JOIN (SELECT dst AS bucket, CAST(sum(n) AS BIGINT) AS n FROM m1 GROUP BY 1) i USING (bucket)),
{_pass_sql('2', 'c1', '(SELECT CAST(floor(sum(load) / 40) AS BIGINT) FROM c1)')},
moves AS (SELECT src, dst, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) GROUP BY 1, 2)"""


ORACLE: dict[str, str] = {
    "q01_root_nodes": """
SELECT DISTINCT l_orderkey AS problem_id, 'r' AS node_id, CAST(l_orderkey % 40 AS INTEGER) AS bucket, 0 AS depth
FROM lineitem""",

    "q02_read_mps": """
WITH b AS (SELECT p_brand, floor(sum(p_size) / 2) AS rhs FROM part GROUP BY 1)
SELECT CAST(regexp_extract(p.p_brand, '#(\\d+)', 1) AS BIGINT) AS problem_id, 'P' || p_partkey AS var,
       p_retailprice AS obj, 1.0::DOUBLE AS ub, true AS is_int, CAST(p_size AS DOUBLE) AS coef,
       CAST(b.rhs AS DOUBLE) AS rhs, '<=' AS sense
FROM part p JOIN b USING (p_brand)""",

    "q03_check_program": """
WITH v AS (SELECT CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS BIGINT) AS problem_id, p_partkey FROM part),
k AS (SELECT v.problem_id, l_orderkey, l_partkey FROM lineitem JOIN v ON l_partkey = v.p_partkey)
SELECT problem_id, 'uncovered_var' AS kind, 'P' || p_partkey AS name FROM v
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.problem_id = v.problem_id AND k.l_partkey = v.p_partkey)
UNION ALL
SELECT problem_id, 'duplicate_coef' AS kind, 'o' || l_orderkey || '/P' || l_partkey AS name
FROM k GROUP BY problem_id, l_orderkey, l_partkey HAVING count(*) > 1""",

    "q04_place": """
SELECT CAST(l_suppkey % 40 AS INTEGER) AS part, count(*) AS n FROM lineitem GROUP BY 1""",

    "q06_metrics_row": f"""
WITH {WI}, {BUCKETS},
c AS (SELECT bk.bucket, CAST(count(*) FILTER (WHERE NOT hard) AS BIGINT) AS n_easy,
             CAST(count(*) FILTER (WHERE hard) AS BIGINT) AS n_hard, CAST(count(DISTINCT grp) AS BIGINT) AS n_trees
      FROM bk LEFT JOIN wi USING (bucket) GROUP BY bk.bucket)
SELECT 0 AS iteration, bucket, n_easy, n_hard, n_trees, n_easy + n_hard AS n_open,
       CAST(NULL AS BIGINT) AS n_pruned, CAST(NULL AS BIGINT) AS n_completed, 'solve' AS phase FROM c
UNION ALL
SELECT 0, CAST(NULL AS INTEGER), CAST(sum(n_easy) AS BIGINT), CAST(sum(n_hard) AS BIGINT), CAST(sum(n_trees) AS BIGINT),
       CAST(sum(n_easy) + sum(n_hard) AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'solve' FROM c""",

    "q07_effective_bounds": f"""
SELECT l_orderkey AS problem_id, 'r' AS node_id, {LINE_VAR} AS var, 0.0::DOUBLE AS lb, l_quantity AS ub FROM lineitem
UNION ALL
SELECT l_orderkey, 'n1', {LINE_VAR},
       CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE,
       least(l_quantity, CAST(floor(l_quantity * (1 - l_discount)) AS DOUBLE))
FROM lineitem""",

    "q08_merge_bounds": """
WITH a AS (SELECT l_orderkey, 'P' || l_partkey AS var, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey, 'P' || l_partkey AS var, max(round(l_tax * 100)) AS t FROM lineitem
      WHERE l_discount >= 0.05 GROUP BY 1, 2),
j AS (SELECT a.l_orderkey, a.var, a.q, b.t FROM a LEFT JOIN b USING (l_orderkey, var))
SELECT l_orderkey AS problem_id, var, least(q, coalesce(t, q)) AS up, greatest(q, coalesce(t, q)) AS lo,
       bool_or(coalesce(t < q, false)) OVER (PARTITION BY l_orderkey) AS changed
FROM j""",

    "q09_branch": f"""
WITH c AS (SELECT l_orderkey, {LINE_VAR} AS var,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY {CENTS} DESC, {LINE_VAR}) AS rn
           FROM lineitem),
ch AS (SELECT l_orderkey, var FROM c WHERE rn = 1)
SELECT l_orderkey AS problem_id, 'r0' AS node_id, 'r' AS parent_id, 1 AS depth, var,
       CAST(NULL AS DOUBLE) AS lower_v, 0.0::DOUBLE AS upper_v FROM ch
UNION ALL
SELECT l_orderkey, 'r1', 'r', 1, var, 1.0::DOUBLE, CAST(NULL AS DOUBLE) FROM ch""",

    "q12_drop_completed": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'feasible' ELSE 'open' END AS status
FROM orders WHERE o_orderstatus <> 'F'""",

    "q14_halt_subtrees": """
WITH n AS (SELECT CAST(c_nationkey AS BIGINT) AS problem_id, o_custkey, o_orderkey, o_totalprice, o_orderpriority
           FROM orders JOIN customer ON o_custkey = c_custkey),
inc AS (SELECT problem_id, min(o_totalprice) AS obj FROM n WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
best AS (SELECT problem_id, o_custkey, min(o_totalprice) AS b FROM n GROUP BY 1, 2),
halted AS (SELECT best.problem_id, o_custkey FROM best JOIN inc USING (problem_id)
           WHERE abs((b - obj) / (abs(obj) + 1e-10)) <= 0.05 OR b >= obj)
SELECT o_orderkey FROM n WHERE NOT EXISTS (
  SELECT 1 FROM halted h WHERE h.problem_id = n.problem_id AND h.o_custkey = n.o_custkey)""",

    "q16_count_by_bucket": f"""
WITH {WI}, {BUCKETS}
SELECT bk.bucket, CAST(count(wi.bucket) FILTER (WHERE NOT hard) AS BIGINT) AS n_easy,
       CAST(count(wi.bucket) FILTER (WHERE hard) AS BIGINT) AS n_hard, CAST(count(DISTINCT grp) AS BIGINT) AS n_trees
FROM bk LEFT JOIN wi USING (bucket) GROUP BY bk.bucket""",

    "q20_plan_moves": f"""
WITH {PLAN_CTES}
SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, n FROM moves""",

}

ORACLE["q24_leaves_by_subtree"] = f"""
WITH {WI}
SELECT CAST(bucket AS BIGINT) AS problem_id, grp, count(*) FILTER (WHERE NOT hard) AS n_easy,
       count(*) FILTER (WHERE hard) AS n_hard
FROM wi GROUP BY 1, 2"""

ORACLE["q25_bound_nodes"] = f"""
WITH it AS (SELECT l_orderkey, {CENTS} AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
cap AS (SELECT l_orderkey, sum(w) // 2 AS cap FROM it GROUP BY 1),
fit AS (SELECT it.l_orderkey, v, w, cap FROM it JOIN cap USING (l_orderkey) WHERE w <= cap),
ord AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey ORDER BY v / w DESC, v DESC
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw FROM fit),
lp AS (SELECT l_orderkey,
              sum(CASE WHEN cw <= cap THEN v
                       WHEN cw - w < cap THEN (cap - (cw - w)) * (v / w) ELSE 0 END) AS lp
       FROM ord GROUP BY 1)
SELECT cap.l_orderkey AS problem_id, CAST(floor(coalesce(lp.lp, 0) + 1e-6) AS BIGINT) AS root_bound
FROM cap LEFT JOIN lp USING (l_orderkey)"""


ORACLE["q10_bucket_results"] = f"""
WITH best AS (SELECT bucket, o_orderkey AS best_order, o_totalprice AS best_price FROM (
  SELECT CAST(o_orderkey % 40 AS INTEGER) AS bucket, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_orderkey % 40 ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1),
li AS (SELECT CAST(l_suppkey % 40 AS INTEGER) AS bucket, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)
SELECT li.*, best_order, best_price FROM li LEFT JOIN best USING (bucket)"""

ORACLE["q11_best_solution"] = f"""
WITH o AS (SELECT o_custkey AS problem_id, o_totalprice AS objective,
                  CASE WHEN o_orderstatus = 'F' THEN 'optimal' WHEN o_orderstatus = 'O' THEN 'feasible'
                       ELSE 'infeasible' END AS status,
                  CAST(o_orderkey AS VARCHAR) AS tie, year(o_orderdate) <= 1997 AS old FROM orders),
inc AS (SELECT problem_id, objective, status FROM (
          SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY objective, tie) AS rn
          FROM o WHERE old AND status IN ('optimal', 'feasible')) WHERE rn = 1),
al AS (SELECT problem_id, objective, status, 0 AS nw, '' AS tie FROM inc
       UNION ALL
       SELECT problem_id, objective, status, 1, tie FROM o WHERE NOT old AND status IN ('optimal', 'feasible'))
SELECT problem_id, objective, status FROM (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY objective, nw, tie) AS rn FROM al) WHERE rn = 1"""


def _prune_sql(best: str, op: str) -> str:
    return f"""SELECT o.o_orderkey, o.o_custkey AS problem_id FROM orders o
LEFT JOIN (SELECT o_custkey, {best}(o_totalprice) AS obj FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) inc USING (o_custkey)
WHERE inc.obj IS NULL OR o.o_totalprice {op} inc.obj"""


def _halt_sql(best: str, op: str) -> str:
    return f"""SELECT n.o_orderkey FROM (SELECT c_nationkey, o_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) n
JOIN (SELECT c_nationkey, o_custkey, {best}(o_totalprice) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) t
  USING (c_nationkey, o_custkey)
LEFT JOIN (SELECT c_nationkey, {best}(o_totalprice) AS obj FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE o_orderpriority = '1-URGENT' GROUP BY 1) inc USING (c_nationkey)
WHERE obj IS NULL OR NOT (abs((b - obj) / (abs(obj) + 1e-10)) <= 0.05 OR b {op} obj)"""


ORACLE["q13_prune_nodes"] = _prune_sql("min", "<")
ORACLE["q34_prune_halt_max"] = f"""
SELECT o_orderkey, 'pruned' AS step FROM ({_prune_sql("max", ">")})
UNION ALL SELECT o_orderkey, 'halted' FROM ({_halt_sql("max", "<=")})"""

ORACLE["q15_split_groups"] = f"""
WITH n AS (SELECT CAST(l_suppkey % 40 AS INTEGER) AS bucket, CAST(l_partkey % 24 AS INTEGER) AS grp, l_quantity >= 25 AS hard,
                  CAST({CENTS} % 3 AS INTEGER) <= CAST((l_partkey % 24) % 2 AS INTEGER) AS root FROM lineitem),
g AS (SELECT *, count(*) FILTER (WHERE hard) OVER (PARTITION BY bucket, grp) AS n_group FROM n),
f AS (SELECT unnest([false, true]) AS farm_all)
SELECT farm_all, bucket, grp, count(*) AS n_rows, count(*) FILTER (WHERE hard) AS n_hard,
       count(*) FILTER (WHERE NOT root AND hard AND (n_group > 32 OR farm_all)) AS n_farmed FROM g, f GROUP BY 1, 2, 3"""

ORACLE["q17_needs_rebalance"] = f"""
WITH {WI}, {BUCKETS},
c AS (SELECT bk.bucket, count(wi.bucket) FILTER (WHERE hard) AS n_hard FROM bk LEFT JOIN wi USING (bucket) GROUP BY 1),
t AS (SELECT CAST(unnest([5, 1000000000]) AS INTEGER) AS threshold)
SELECT threshold, CAST(min(n_hard) AS BIGINT) AS min_hard, min(n_hard) > threshold AS solution_phase, NOT (min(n_hard) > threshold) AS needs_rebalance
FROM c, t GROUP BY threshold"""

ORACLE["q18_iteration_budget"] = f"""
WITH {WI}, {BUCKETS},
c AS (SELECT bk.bucket, count(wi.bucket) FILTER (WHERE NOT hard) AS n_easy, count(wi.bucket) FILTER (WHERE hard) AS n_hard
      FROM bk LEFT JOIN wi USING (bucket) GROUP BY 1)
SELECT avg(n_easy) AS avg_easy, avg(n_hard) AS avg_hard,
       least(greatest(10 * avg(n_hard) + 1 * avg(n_easy), 50), 100)::DOUBLE AS budget,
       (10 * avg(n_hard) + 1 * avg(n_easy))::DOUBLE AS free_budget FROM c"""

ORACLE["q19_allocate_budget"] = f"""
WITH {WI},
st AS (SELECT bucket, grp, grp % 4 AS tier, count(*) FILTER (WHERE NOT hard) AS n_easy, count(*) FILTER (WHERE hard) AS n_hard,
              min(v) AS best FROM wi GROUP BY 1, 2),
a AS (SELECT *, n_easy + 10 * n_hard AS w FROM st),
b AS (SELECT *, sum(w) OVER (PARTITION BY bucket) AS demand,
             sum(w) OVER (PARTITION BY bucket ORDER BY tier DESC, grp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS remaining,
             row_number() OVER (PARTITION BY bucket ORDER BY tier, grp) AS place,
             min(best) OVER (PARTITION BY bucket ORDER BY tier, grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_best,
             row_number() OVER (PARTITION BY bucket ORDER BY best, grp) AS rk
      FROM a)
SELECT bucket, grp, CAST(w AS BIGINT) AS w, CAST(demand AS BIGINT) AS demand, CAST(remaining AS BIGINT) AS remaining,
       CASE WHEN 5000.0 > demand THEN CAST(w AS DOUBLE) + CASE WHEN place = 1 THEN 5000.0 - demand ELSE 0.0 END
            ELSE greatest(1.0, 5000.0 * w / demand) END::DOUBLE AS share,
       CAST(running_best AS BIGINT) AS running_best, rk <= 3 AS selected
FROM b"""

ORACLE["q33_select_depth_first"] = f"""
WITH {WI}, st AS (SELECT DISTINCT bucket, grp, grp % 7 AS depth FROM wi)
SELECT bucket, grp, depth FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY depth DESC, grp) AS rk FROM st) WHERE rk <= 3"""

ORACLE["q21_apply_moves"] = f"""
WITH {PLAN_CTES},
iv AS (SELECT src, dst, sum(n) OVER (PARTITION BY src ORDER BY dst) - n AS lo, sum(n) OVER (PARTITION BY src ORDER BY dst) AS hi FROM moves),
li AS (SELECT *, CAST(l_suppkey % 40 AS INTEGER) AS b0, l_quantity >= 25 AND l_linestatus = 'O' AS may FROM lineitem),
rk AS (SELECT *, CASE WHEN may THEN row_number() OVER (PARTITION BY b0, may ORDER BY l_orderkey, {ITEM_ORDER}) END AS k FROM li)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       CAST(coalesce(dst, b0) AS INTEGER) AS bucket, dst IS NOT NULL AS moved
FROM rk LEFT JOIN iv ON b0 = src AND k > lo AND k <= hi"""

ORACLE["q32_plan_accessors"] = f"""
WITH {PLAN_CTES}, p AS (SELECT a.bucket AS src, b.bucket AS dst FROM bk a, bk b)
SELECT p.src, p.dst, CAST(coalesce(m.n, 0) AS BIGINT) AS n, p.src IN (SELECT src FROM moves WHERE n > 0) AS gives
FROM p LEFT JOIN moves m ON m.src = p.src AND m.dst = p.dst"""

ORACLE["q22_solve_selection"] = f"""
WITH it AS (SELECT l_orderkey, {CENTS} AS v, CAST(l_quantity AS BIGINT) AS w,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) - 1 AS j
            FROM lineitem),
po AS (SELECT l_orderkey, count(*) AS n, sum(w) // 2 AS cap FROM it GROUP BY 1),
masks AS (SELECT l_orderkey, cap, unnest(generate_series(1, (1 << n) - 1)) AS m FROM po),
sel AS (SELECT masks.l_orderkey, m, cap, sum(v) AS sv, sum(w) AS sw
        FROM masks JOIN it ON it.l_orderkey = masks.l_orderkey AND ((m >> j) & 1) = 1 GROUP BY 1, 2, 3)
SELECT po.l_orderkey AS problem_id, CAST(coalesce(max(sv) FILTER (WHERE sw <= sel.cap), 0) AS BIGINT) AS best_v, 'optimal' AS status
FROM po LEFT JOIN sel USING (l_orderkey) GROUP BY 1"""

ORACLE["q23_solve_mix"] = f"""
WITH RECURSIVE it AS (SELECT l_orderkey, {CENTS} AS v, CAST(l_quantity AS BIGINT) AS w,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY {ITEM_ORDER}) AS j
            FROM lineitem),
po AS (SELECT l_orderkey, count(*) AS n, (7 * sum(w) + 9) // 10 AS need FROM it GROUP BY 1),
x AS (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS x),
dp AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS units, CAST(0 AS BIGINT) AS weight, CAST(0 AS BIGINT) AS cost FROM po
       UNION ALL
       SELECT dp.l_orderkey, dp.j + 1, dp.units + x, CAST(least(dp.weight + it.w * x, po.need) AS BIGINT), CAST(min(dp.cost + it.v * x) AS BIGINT)
       FROM dp JOIN it ON it.l_orderkey = dp.l_orderkey AND it.j = dp.j + 1 JOIN po ON po.l_orderkey = dp.l_orderkey, x
       WHERE dp.units + x <= po.n
       GROUP BY 1, 2, 3, 4)
SELECT dp.l_orderkey AS problem_id, min(cost) AS best_v, 'optimal' AS status
FROM dp JOIN po ON po.l_orderkey = dp.l_orderkey AND dp.j = po.n AND dp.units = po.n AND dp.weight = po.need GROUP BY 1"""

ORACLE["q05_solution_rows"] = f"""
WITH best AS ({ORACLE['q22_solve_selection']})
SELECT problem_id, best_v AS chosen_v, true AS fits FROM best"""

ORACLE["q35_mix_bounds"] = f"""SELECT problem_id, best_v, true AS not_worse, true AS valid FROM ({ORACLE['q23_solve_mix']})"""

ORACLE["q26_solver_metrics"] = f"""
WITH {BUCKETS}, o AS (SELECT DISTINCT l_orderkey, CAST(l_orderkey % 40 AS INTEGER) AS bucket FROM lineitem),
c AS (SELECT bk.bucket, count(l_orderkey) AS n FROM bk LEFT JOIN o USING (bucket) GROUP BY 1)
SELECT 0 AS iteration, bucket, CAST(0 AS BIGINT) AS n_easy, CAST(sum(n) AS BIGINT) AS n_hard, CAST(sum(n) AS BIGINT) AS n_trees,
       CAST(sum(n) AS BIGINT) AS n_open, 'solve' AS phase, true AS adds_up, true AS by_bucket FROM c GROUP BY ROLLUP (bucket)"""

ORACLE["q27_solve_refused"] = f"""
WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 5 AS k FROM part),
b AS (SELECT p_partkey, least(floor(s / 3.0), floor(s / 2.0)) AS x, floor(s / 2.0) AS cap, k FROM p)
SELECT p_partkey AS problem_id, CASE WHEN k = 0 THEN CAST(3 * x + 2 * least(2, cap - x) AS BIGINT) END AS best,
       CASE k WHEN 0 THEN 'optimal' WHEN 4 THEN 'infeasible' ELSE 'error' END AS status FROM b"""

ORACLE["q28_nodes_of"] = f"""
WITH r AS (SELECT CAST(l_suppkey % 40 AS INTEGER) AS bucket, row_number() OVER (PARTITION BY l_suppkey % 40) - 1 AS k FROM lineitem)
SELECT bucket, CAST(k // 100 + 1 AS INTEGER) AS part, count(*) AS n FROM r GROUP BY 1, 2"""

ORACLE["q29_assemble_solution"] = f"""
SELECT l_orderkey AS problem_id, 'P' || l_partkey AS var, max(l_quantity) AS value, CAST(NULL AS DOUBLE) AS absent FROM lineitem GROUP BY 1, 2"""

ORACLE["q30_branch_easy"] = f"""
SELECT DISTINCT l_orderkey AS problem_id, 'r' || side AS node_id, side = '0' AS is_easy FROM lineitem, (SELECT unnest(['0', '1']) AS side)"""

ORACLE["q31_replace_farmed"] = f"""
WITH o AS (SELECT l_orderkey, count(*) > 5 AS farmed FROM lineitem GROUP BY 1)
SELECT l_orderkey AS problem_id, 'r' AS node_id, 'r' AS subtree_id, 0 AS subtree_root_depth, 0 AS depth FROM o WHERE NOT farmed
UNION ALL SELECT l_orderkey, 'r' || side, 'r' || side, 1, 1 FROM o, (SELECT unnest(['0', '1']) AS side) WHERE farmed"""

ORACLE["q36_quarantine"] = """
WITH p AS (SELECT p_partkey, p_size // 2 AS best, p_partkey % 16 AS k FROM part)
SELECT p_partkey AS problem_id, CASE WHEN k = 0 THEN CAST(best AS BIGINT) END AS best, CASE WHEN k = 0 THEN 'optimal' ELSE 'error' END AS status,
       CASE WHEN k = 0 THEN '' WHEN k IN (1, 2, 4, 5, 7) THEN 'null_value' WHEN k IN (3, 6, 11, 12) THEN 'not_finite' WHEN k = 8 THEN 'unknown_con'
            WHEN k = 9 THEN 'duplicate_con' WHEN k = 10 THEN 'duplicate_var' WHEN k = 13 THEN 'duplicate_coef' ELSE 'bad_objective_sense' END AS findings FROM p"""

ORACLE["q37_mixed_senses"] = f"""
SELECT * FROM ({ORACLE['q22_solve_selection']}) WHERE problem_id % 2 = 0
UNION ALL SELECT problem_id, CAST(best_v AS BIGINT), status FROM ({ORACLE['q23_solve_mix']}) WHERE problem_id % 2 = 1"""

ORACLE["q41_set_branching"] = f"""
WITH it AS (SELECT l_orderkey, {CENTS} AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
po AS (SELECT l_orderkey, (sum(w) + count(*) - 1) // count(*) AS need FROM it GROUP BY 1)
SELECT it.l_orderkey AS problem_id, min(v) AS best_v, 'optimal' AS status, CAST(1 AS BIGINT) AS n_chosen
FROM it JOIN po ON po.l_orderkey = it.l_orderkey AND w >= need GROUP BY 1"""

ORACLE["q42_mps_records"] = """
WITH p AS (SELECT CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS BIGINT) AS b, p_partkey AS k, p_size AS s, 'P' || p_partkey AS name FROM part),
brand AS (SELECT DISTINCT b FROM p),
other AS (SELECT b, name, s, ['least', 'up', 'down', 'plain'][CAST(k % 4 AS INTEGER) + 1] AS con FROM p),
rows AS (SELECT unnest([{'name': 'most#lo', 'a': 70, 'note': '>='}, {'name': 'most#hi', 'a': 100, 'note': '<='}, {'name': 'least#lo', 'a': 5, 'note': '>='}, {'name': 'least#hi', 'a': 45, 'note': '<='},
  {'name': 'up#lo', 'a': 10, 'note': '>='}, {'name': 'up#hi', 'a': 13, 'note': '<='}, {'name': 'down#lo', 'a': 16, 'note': '>='}, {'name': 'down#hi', 'a': 20, 'note': '<='},
  {'name': 'plain', 'a': 0, 'note': '<='}]) AS r),
entries AS (SELECT b, name, 'most' AS con, s AS v FROM p UNION ALL SELECT b, name, con, s + 1 FROM other)
SELECT b AS problem_id, 'sense' AS kind, '' AS name, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c, CASE WHEN b % 2 = 1 THEN 'max' ELSE 'min' END AS note FROM brand
UNION ALL SELECT b, 'var', '#constant', 1, 1, 50, 'true' FROM brand
UNION ALL SELECT b, 'var', name, CASE k % 11 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN '-inf'::DOUBLE WHEN 4 THEN '-inf'::DOUBLE WHEN 7 THEN 3 WHEN 9 THEN '-inf'::DOUBLE ELSE 0 END,
  CASE k % 11 WHEN 0 THEN 9 WHEN 2 THEN 4 WHEN 6 THEN 1 WHEN 8 THEN 8 WHEN 9 THEN -5 ELSE 'inf'::DOUBLE END, 2 * s, CASE WHEN k % 2 = 0 OR k % 11 IN (6, 7, 8) THEN 'true' ELSE 'false' END FROM p
UNION ALL SELECT b, 'row', r.name, r.a, NULL, NULL, r.note FROM brand, rows
UNION ALL SELECT b, 'entry', con || side || '/' || name, v, NULL, NULL, '' FROM entries, (SELECT unnest(['#lo', '#hi']) AS side) WHERE con <> 'plain'
UNION ALL SELECT b, 'entry', 'plain/' || name, v, NULL, NULL, '' FROM entries WHERE con = 'plain'"""
