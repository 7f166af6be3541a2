"""Test queries: at least one per operator family, each with a DuckDB oracle.

Every query reads the driver's tables (or tables Spark derives from them) in
full.  Money is integer cents and quantities BIGINT on both sides, so sums are
exact.  Column names and types match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.bounds import bounds_changed, merge_lower, merge_upper, status_of
from lattica.operators import balance as B
from lattica.operators import report as R
from lattica.operators import search as S
from lattica.operators.bounds import bound_nodes, by_cost, effective_bounds
from lattica.plans import fixtures as X
from lattica.plans.solve import prepare, solve
from lattica.sources.mps import parse_mps
from lattica.sources.program import Program, check_program, program_from_tables, root_nodes
from lattica.sources.tables import table

# Fixed query parameters.
N_BUCKETS = 40
BUDGET = 5000.0
TOP_K = 3
GAP = 0.05


def _li(spark, sf):
    return table(spark, sf, "lineitem")


def _line_var() -> F.Column:
    """Content name of a line, unique inside its order (used where the oracle
    must name variables too)."""
    return F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"))


def _line_program(spark, sf):
    """Selection-program variables named by content (for Q01, Q09)."""
    li = _li(spark, sf)
    vars = li.select(F.col("l_orderkey").alias("problem_id"), _line_var().alias("var"), F.lit(0.0).alias("lb"),
                     F.lit(1.0).alias("ub"), X.cents().cast("double").alias("obj"), F.lit(True).alias("is_int"))
    return vars


# ---------------------------------------------------------------- Q01 – Q06
def q01_root_nodes(spark: SparkSession, sf: str) -> DataFrame:
    roots = root_nodes(_line_program(spark, sf), N_BUCKETS)
    return roots.select("problem_id", "node_id", "bucket", "depth")


def q02_read_mps(spark: SparkSession, sf: str) -> DataFrame:
    """MPS text built from ``part`` (one file per brand) parsed back by ``parse_mps``."""
    p = table(spark, sf, "part")
    brand = F.col("p_brand")
    head = p.select(brand.alias("file")).distinct()
    lines = [
        head.select("file", F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("NAME          "), "file").alias("line")),
        head.select("file", F.lit(1).cast("bigint").alias("line_no"), F.lit("ROWS").alias("line")),
        head.select("file", F.lit(2).cast("bigint").alias("line_no"), F.lit(" N  obj").alias("line")),
        head.select("file", F.lit(3).cast("bigint").alias("line_no"), F.lit(" L  cap").alias("line")),
        head.select("file", F.lit(4).cast("bigint").alias("line_no"), F.lit("COLUMNS").alias("line")),
        head.select("file", F.lit(5).cast("bigint").alias("line_no"),
                    F.lit("    MARKER                 'MARKER'                 'INTORG'").alias("line")),
        p.select(brand.alias("file"), (F.lit(10) + F.col("p_partkey")).alias("line_no"),
                 F.format_string("    P%d  obj  %s  cap  %d", "p_partkey", F.col("p_retailprice").cast("string"),
                                 "p_size").alias("line")),
        head.select("file", F.lit(10 ** 12).cast("bigint").alias("line_no"),
                    F.lit("    MARKER                 'MARKER'                 'INTEND'").alias("line")),
        head.select("file", F.lit(2 * 10 ** 12).cast("bigint").alias("line_no"), F.lit("RHS").alias("line")),
        p.groupBy(brand.alias("file")).agg(F.sum("p_size").alias("s")).select(
            "file", F.lit(2 * 10 ** 12 + 1).cast("bigint").alias("line_no"),
            F.format_string("    RHS  cap  %d", F.floor(F.col("s") / 2)).alias("line")),
        head.select("file", F.lit(3 * 10 ** 12).cast("bigint").alias("line_no"), F.lit("BOUNDS").alias("line")),
        p.select(brand.alias("file"), (F.lit(3 * 10 ** 12 + 1) + F.col("p_partkey")).alias("line_no"),
                 F.format_string(" UP BND       P%d  1", "p_partkey").alias("line")),
        head.select("file", F.lit(4 * 10 ** 12).cast("bigint").alias("line_no"), F.lit("ENDATA").alias("line")),
    ]
    all_lines = lines[0]
    for l in lines[1:]:
        all_lines = all_lines.unionByName(l)
    prog = parse_mps(all_lines, problem_id=F.regexp_extract("file", r"#(\d+)", 1).cast("bigint"), sense="max")
    v = prog.vars.select("problem_id", "var", "obj", "ub", "is_int")
    k = prog.coefs.select("problem_id", "var", F.col("coef"))
    rhs = prog.cons.select("problem_id", "rhs", "sense")
    return v.join(k, ["problem_id", "var"]).join(rhs, "problem_id")


def q03_check_program(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as variables per brand, line quantities per order as rows."""
    p = table(spark, sf, "part")
    bid = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("bigint")
    vars = p.select(bid.alias("problem_id"), F.concat(F.lit("P"), "p_partkey").alias("var"), F.lit(0.0).alias("lb"),
                    F.col("p_size").cast("double").alias("ub"), F.col("p_retailprice").alias("obj"),
                    F.lit(True).alias("is_int"))
    li = _li(spark, sf).join(p.select("p_partkey", bid.alias("problem_id")), F.col("l_partkey") == F.col("p_partkey"))
    coefs = li.select("problem_id", F.concat(F.lit("o"), "l_orderkey").alias("con"),
                      F.concat(F.lit("P"), "l_partkey").alias("var"), F.col("l_quantity").alias("coef"))
    cons = coefs.select("problem_id", "con").distinct().select("problem_id", "con", F.lit("<=").alias("sense"),
                                                               F.lit(100.0).alias("rhs"))
    return check_program(program_from_tables(vars, cons, coefs))


def q04_place(spark: SparkSession, sf: str) -> DataFrame:
    placed = B.place(X.work_items(spark, sf), N_BUCKETS)
    return placed.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def q05_solution_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen items of Q22 as rows, objective and capacity recomputed from the items."""
    prog = X.selection_program(spark, sf)
    res = solve(prog)
    rows = R.solution_rows(res.incumbent).where(F.col("value") > 0.5)
    it = X.items(spark, sf).select(F.col("l_orderkey").alias("problem_id"), F.col("item_id").alias("var"), "v", "w")
    cap = prog.cons.select("problem_id", "rhs")
    chosen = rows.join(it, ["problem_id", "var"]).groupBy("problem_id").agg(
        F.sum("v").cast("bigint").alias("chosen_v"), F.sum("w").alias("chosen_w"))
    every = res.incumbent.select("problem_id").join(chosen, "problem_id", "left").join(cap, "problem_id")
    return every.select("problem_id", F.coalesce("chosen_v", F.lit(0)).cast("bigint").alias("chosen_v"),
                        (F.coalesce("chosen_w", F.lit(0)) <= F.col("rhs")).alias("fits"))


def _wi_nodes(spark, sf):
    wi = X.work_items(spark, sf)
    return wi.select("item_id", "bucket", (~F.col("is_hard")).alias("is_easy"), "is_hard", "movable",
                     F.col("grp").cast("string").alias("subtree_id"), "grp")


def q06_metrics_row(spark: SparkSession, sf: str) -> DataFrame:
    counts = B.count_by_bucket(_wi_nodes(spark, sf), N_BUCKETS)
    return R.metrics_row(spark, 0, counts, "solve")


# ---------------------------------------------------------------- Q07 – Q10
def _line_maps(spark, sf):
    """Per order: upper map from quantities (min per part) and a second map from
    taxes (max per part) over discounted lines only."""
    li = _li(spark, sf)
    k = F.concat(F.lit("P"), "l_partkey")
    a = li.groupBy("l_orderkey", k.alias("k")).agg(F.min("l_quantity").alias("q"))
    b = li.where(F.col("l_discount") >= 0.05).groupBy("l_orderkey", k.alias("k")).agg(
        F.max(F.round(F.col("l_tax") * 100)).alias("t"))
    am = a.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "q"))).alias("a"))
    bm = b.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "t"))).alias("b"))
    return am.join(bm, "l_orderkey", "left").select(
        "l_orderkey", "a", F.coalesce("b", F.create_map().cast("map<string,double>")).alias("b"))


def q07_effective_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Base bounds by line (0..quantity); node 'n1' of each order overrides the
    upper bound by the discounted quantity and the lower bound by 1 on lines
    with a discount above 5 %."""
    li = _li(spark, sf)
    vars = li.select(F.col("l_orderkey").alias("problem_id"), _line_var().alias("var"), F.lit(0.0).alias("lb"),
                     F.col("l_quantity").alias("ub"), F.lit(1.0).alias("obj"), F.lit(True).alias("is_int"))
    up = li.select("l_orderkey", _line_var().alias("k"), F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).cast("double").alias("u"))
    lo = li.where(F.col("l_discount") > 0.05).select("l_orderkey", _line_var().alias("k"), F.lit(1.0).alias("l"))
    upm = up.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "u"))).alias("upper"))
    lom = lo.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "l"))).alias("lower"))
    roots = root_nodes(vars, N_BUCKETS)
    n1 = roots.drop("lower", "upper").join(upm.withColumnRenamed("l_orderkey", "problem_id"), "problem_id") \
        .join(lom.withColumnRenamed("l_orderkey", "problem_id"), "problem_id", "left") \
        .withColumn("lower", F.coalesce("lower", F.create_map().cast("map<string,double>"))) \
        .withColumn("node_id", F.lit("n1"))
    frontier = roots.unionByName(n1.select(*roots.columns))
    return effective_bounds(frontier, vars).select("problem_id", "node_id", "var", "lb", "ub")


def q08_merge_bounds(spark: SparkSession, sf: str) -> DataFrame:
    m = _line_maps(spark, sf)
    m = m.select("l_orderkey", merge_upper("a", "b").alias("up"), merge_lower("a", "b").alias("lo"),
                 bounds_changed("a", merge_upper("a", "b")).alias("changed"))
    return m.select(F.col("l_orderkey").alias("problem_id"), "changed", F.explode("up").alias("var", "up"), "lo") \
            .select("problem_id", "var", "up", F.try_element_at("lo", F.col("var")).alias("lo"), "changed")


def _roots_with_choice(spark, sf):
    """Root node of every order with its branching choice by cost (no rows)."""
    vars = _line_program(spark, sf)
    none = vars.select("problem_id", F.lit("c").alias("con"), F.lit("<=").alias("sense"), F.lit(0.0).alias("rhs"), "var", F.lit(0.0).alias("coef")).limit(0)
    prog = Program(vars, none.select("problem_id", "con", "sense", "rhs"), none.select("problem_id", "con", "var", "coef"), "max")
    return bound_nodes(root_nodes(vars, N_BUCKETS), prog, rounds=0, branch_rule=by_cost)


def q09_branch(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _roots_with_choice(spark, sf)
    kids = S.branch(nodes)
    return kids.join(nodes.select("problem_id", "var"), "problem_id").select(
        "problem_id", "node_id", "parent_id", "depth", "var",
        F.try_element_at("lower", F.col("var")).alias("lower_v"),
        F.try_element_at("upper", F.col("var")).alias("upper_v"))


def _bucket_results(spark, sf, rows_per_list=R.ROWS_PER_LIST):
    li = _li(spark, sf)
    nodes = li.select(F.pmod("l_suppkey", F.lit(N_BUCKETS)).cast("int").alias("bucket"),
                      "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    sols = table(spark, sf, "orders").select(
        F.pmod("o_orderkey", F.lit(N_BUCKETS)).cast("int").alias("bucket"),
        F.col("o_orderkey").alias("problem_id"), F.col("o_totalprice").alias("objective"),
        F.lit("feasible").alias("status"))
    return R.bucket_results(sols, nodes, rows_per_list=rows_per_list)


def q10_bucket_results(spark: SparkSession, sf: str) -> DataFrame:
    """Line items collected per bucket with the bucket's cheapest order, then
    flattened back beside that order."""
    res = _bucket_results(spark, sf)
    best = B.small_side(R.solution_of(res).select("bucket", F.col("problem_id").alias("best_order"), F.col("objective").alias("best_price")))
    return R.flatten_nodes(res).join(best, "bucket", "left")


def q28_nodes_of(spark: SparkSession, sf: str) -> DataFrame:
    """Node lists of at most 100 rows (P7): their number and sizes per bucket."""
    lists = R.nodes_of(_bucket_results(spark, sf, 100))
    return lists.select("bucket", "part", F.size("nodes").cast("bigint").alias("n"))


def q29_assemble_solution(spark: SparkSession, sf: str) -> DataFrame:
    """Values folded to one map per order and read back by name."""
    rows = _li(spark, sf).select(F.col("l_orderkey").alias("problem_id"), F.concat(F.lit("P"), "l_partkey").alias("var"), "l_quantity")
    rows = rows.groupBy("problem_id", "var").agg(F.max("l_quantity").alias("value"))
    maps = R.assemble_solution(rows)
    return rows.select("problem_id", "var").join(maps, "problem_id").select(
        "problem_id", "var", R.variable_value("values", "var").alias("value"), R.variable_value("values", F.lit("none")).alias("absent"))


# ---------------------------------------------------------------- Q11 – Q15
def _order_solutions(spark, sf, old: bool):
    """Orders up to 1997 (old) or later as solutions of their customer's problem."""
    o = table(spark, sf, "orders").where((F.year("o_orderdate") <= 1997) == old)
    st = status_of(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus") == "F")
    return o.select(F.col("o_custkey").alias("problem_id"), F.col("o_totalprice").alias("objective"),
                    st.alias("status"), F.lit(None).cast("map<string,double>").alias("values"),
                    F.col("o_orderkey").cast("string").alias("node_id"))


def q11_best_solution(spark: SparkSession, sf: str) -> DataFrame:
    inc = S.best_solution(_order_solutions(spark, sf, True))
    best = S.best_solution(_order_solutions(spark, sf, False), inc)
    return best.select("problem_id", "objective", "status")


def q12_drop_completed(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    st = F.when(F.col("o_orderstatus") == "F", "optimal").when(F.col("o_orderstatus") == "O", "feasible") \
          .otherwise("open")
    return S.drop_completed(o.select("o_orderkey", st.alias("status")))


def _prune(spark, sf, sense):
    o = table(spark, sf, "orders")
    nodes = o.select(F.col("o_custkey").alias("problem_id"), F.col("o_orderkey").cast("string").alias("node_id"),
                     "o_orderkey", F.col("o_totalprice").alias("bound"))
    best = F.min if sense == "min" else F.max
    inc = o.where(F.col("o_orderstatus") == "P").groupBy(F.col("o_custkey").alias("problem_id")).agg(best("o_totalprice").alias("objective"))
    return S.prune_nodes(nodes, inc, sense).select("o_orderkey", "problem_id")


def q13_prune_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _prune(spark, sf, "min")


def _halt(spark, sf, sense):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("problem_id"))
    nodes = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "problem_id", F.col("o_custkey").cast("string").alias("subtree_id"), "o_orderkey",
        F.col("o_totalprice").alias("bound"))
    best = F.min if sense == "min" else F.max
    inc = o.where(F.col("o_orderpriority") == "1-URGENT").join(c, F.col("o_custkey") == F.col("c_custkey")) \
        .groupBy("problem_id").agg(best("o_totalprice").alias("objective"))
    return S.halt_subtrees(nodes, inc, GAP, sense).select("o_orderkey")


def q14_halt_subtrees(spark: SparkSession, sf: str) -> DataFrame:
    return _halt(spark, sf, "min")


def q34_prune_halt_max(spark: SparkSession, sf: str) -> DataFrame:
    """The same two with the greatest objective as the best."""
    pruned = _prune(spark, sf, "max").select("o_orderkey", F.lit("pruned").alias("step"))
    return pruned.unionByName(_halt(spark, sf, "max").select("o_orderkey", F.lit("halted").alias("step")))


def _farm_nodes(spark, sf):
    """Lines as nodes of their supplier's bucket, at depths 0 to 2 of subtrees whose root is at 0 or 1."""
    it = X.items(spark, sf)
    grp = F.pmod("l_partkey", F.lit(X.N_GROUPS)).cast("int")
    return it.select(F.pmod("l_suppkey", F.lit(N_BUCKETS)).cast("bigint").alias("problem_id"), grp.alias("grp"),
                     F.col("item_id").alias("node_id"), grp.cast("string").alias("subtree_id"),
                     (F.col("l_quantity") < X.HARD_QTY).alias("is_easy"), F.pmod("v", F.lit(3)).cast("int").alias("depth"),
                     F.pmod(grp, F.lit(2)).alias("subtree_root_depth"))


def q15_split_groups(spark: SparkSession, sf: str) -> DataFrame:
    n = _farm_nodes(spark, sf)
    parts = [S.split_groups(n, S.MAX_HARD_LEAVES, farm_all).withColumn("farm_all", F.lit(farm_all)) for farm_all in (False, True)]
    return parts[0].unionByName(parts[1]).groupBy("farm_all", F.col("problem_id").cast("int").alias("bucket"), "grp").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("is_easy")).alias("n_hard"),
        F.count_if("farmed").alias("n_farmed"))


def q30_branch_easy(spark: SparkSession, sf: str) -> DataFrame:
    """Children with a variable fixed at 0 are easy, the others hard."""
    kids = S.branch(_roots_with_choice(spark, sf), easy_when=F.exists(F.map_values("upper"), lambda u: u == 0))
    return kids.select("problem_id", "node_id", "is_easy")


def q31_replace_farmed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of over five lines are farmed: two subtrees each instead of the root."""
    nodes = _roots_with_choice(spark, sf)
    n_lines = _li(spark, sf).groupBy(F.col("l_orderkey").alias("problem_id")).agg((F.count(F.lit(1)) > 5).alias("farmed"))
    out = S.replace_farmed(nodes.join(n_lines, "problem_id"))
    return out.select("problem_id", "node_id", "subtree_id", "subtree_root_depth", "depth")


# ---------------------------------------------------------------- Q16 – Q21
def q16_count_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return B.count_by_bucket(_wi_nodes(spark, sf), N_BUCKETS)


def q17_needs_rebalance(spark: SparkSession, sf: str) -> DataFrame:
    """Against the fixed threshold and a high one, for either outcome."""
    counts = B.count_by_bucket(_wi_nodes(spark, sf), N_BUCKETS)
    parts = [B.needs_rebalance(counts, t).withColumn("threshold", F.lit(t)) for t in (B.MIN_HARD_PER_BUCKET, 10**9)]
    return parts[0].unionByName(parts[1])


def q18_iteration_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Clamped to the fixed limits, and without limits."""
    counts = B.count_by_bucket(_wi_nodes(spark, sf), N_BUCKETS)
    free = B.iteration_budget(counts, lo=0, hi=1e12).select(F.col("budget").alias("free_budget"))
    return B.iteration_budget(counts).join(F.broadcast(free))  # one row each


def _subtrees(spark, sf):
    it = X.items(spark, sf).select(F.pmod("l_suppkey", F.lit(N_BUCKETS)).cast("int").alias("bucket"),
                                   F.pmod("l_partkey", F.lit(X.N_GROUPS)).cast("int").alias("grp"),
                                   (F.col("l_quantity") >= X.HARD_QTY).alias("is_hard"), "v")
    return it.groupBy("bucket", "grp").agg(F.count_if(~F.col("is_hard")).alias("n_easy"),
                                           F.count_if("is_hard").alias("n_hard"), F.min("v").alias("best"))


def q19_allocate_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Subtrees walked by tier, ties by group: budget, running best and the best three."""
    st = _subtrees(spark, sf).withColumn("tier", F.pmod("grp", F.lit(4)))
    a = B.allocate_budget(st, BUDGET, part="bucket", order="tier", tie="grp")
    a = B.running_best(a, part="bucket", order="tier", value="best", tie="grp")
    top = B.select_nodes(st, TOP_K, part="bucket", order="best", tie="grp").select(
        "bucket", "grp", F.lit(True).alias("selected"))
    a = a.join(top, ["bucket", "grp"], "left")
    return a.select("bucket", "grp", F.col("w").cast("bigint").alias("w"), F.col("demand").cast("bigint").alias("demand"),
                    F.col("remaining").cast("bigint").alias("remaining"), "share",
                    F.col("running_best").cast("bigint").alias("running_best"),
                    F.coalesce("selected", F.lit(False)).alias("selected"))


def q33_select_depth_first(spark: SparkSession, sf: str) -> DataFrame:
    """The three deepest subtrees of each bucket (W4): depth = group modulo 7."""
    st = _subtrees(spark, sf).withColumn("depth", F.pmod("grp", F.lit(7)))
    return B.select_nodes(st, TOP_K, part="bucket", tie="grp", depth_first=True).select("bucket", "grp", "depth")


def _wi_counts(spark, sf):
    n = _wi_nodes(spark, sf)
    hard = n.where("is_hard")
    existing = B.count_by_bucket(hard.where(~F.col("movable")), N_BUCKETS, trees=False)
    movable = B.count_by_bucket(hard.where("movable"), N_BUCKETS, trees=False)
    return n, existing, movable


def q20_plan_moves(spark: SparkSession, sf: str) -> DataFrame:
    _, existing, movable = _wi_counts(spark, sf)
    return B.plan_moves(existing, movable, B.MIN_HARD_PER_BUCKET)


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_shipdate", "l_returnflag", "l_linestatus")


def q21_apply_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Every line after the moves: easy and unmovable lines stay, the first movable
    ones of a donor (by all their columns) go."""
    _, existing, movable = _wi_counts(spark, sf)
    moves = B.plan_moves(existing, movable, B.MIN_HARD_PER_BUCKET)
    rows = _li(spark, sf).withColumn("bucket", F.pmod("l_suppkey", F.lit(N_BUCKETS)).cast("int"))
    may = (F.col("l_quantity") >= X.HARD_QTY) & (F.col("l_linestatus") == "O")
    moved = B.apply_moves(rows, moves, movable=may, key=LINE_KEY)
    frontier = B.grow_frontier(moved.where(~F.col("moved")), moved.where("moved"))
    return frontier.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "bucket", "moved")


def q32_plan_accessors(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of buckets: what the plan moves, and whether its source gives at all."""
    _, existing, movable = _wi_counts(spark, sf)
    moves = B.plan_moves(existing, movable, B.MIN_HARD_PER_BUCKET)
    ids = B.all_buckets(spark, N_BUCKETS)  # n_buckets squared pairs: bounded by the parameter
    pairs = ids.select(F.col("bucket").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(N_BUCKETS - 1))).alias("dst"))
    gives = B.makes_donations(moves).withColumn("gives", F.lit(True))
    return B.donation(moves, pairs).join(gives, "src", "left").select("src", "dst", "n", F.coalesce("gives", F.lit(False)).alias("gives"))


def q24_leaves_by_subtree(spark: SparkSession, sf: str) -> DataFrame:
    """Live leaves per subtree (A3): work items as nodes, (bucket, grp) as subtree."""
    n = _wi_nodes(spark, sf).select(F.col("bucket").cast("bigint").alias("problem_id"), "subtree_id", "is_easy")
    return B.leaves_by_subtree(n).select(
        "problem_id", F.col("subtree_id").cast("int").alias("grp"), "n_easy", "n_hard")


def q25_bound_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Root bound of every order's knapsack (U4): propagation drops items
    heavier than the capacity, then the node's critical ratio gives the LP bound,
    rounded down for integral values."""
    prog = X.selection_program(spark, sf)
    roots = root_nodes(prog.vars, N_BUCKETS)
    b = bound_nodes(roots, prog, method="lagrangian")
    return b.select("problem_id", F.col("bound").cast("bigint").alias("root_bound"))


# ---------------------------------------------------------------- Q22 – Q23
def q22_solve_selection(spark: SparkSession, sf: str) -> DataFrame:
    res = solve(X.selection_program(spark, sf))
    return res.incumbent.select("problem_id", F.col("objective").cast("bigint").alias("best_v"), "status")


def q23_solve_mix(spark: SparkSession, sf: str) -> DataFrame:
    res = solve(X.mix_program(spark, sf))
    return res.incumbent.select("problem_id", F.col("objective").cast("bigint").alias("best_v"), "status")


def q26_solver_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Progress rows of a whole search (S7): those of its first level, per bucket and in
    total, and whether all levels add up: a level's open nodes are two for each
    node of the level before that was neither pruned nor done, and the last leaves none."""
    m = solve(X.selection_program(spark, sf), track=True).metrics
    total = m.where("bucket is null").select("iteration", "n_open", "n_pruned", "n_completed")
    after = total.select((F.col("iteration") - 1).alias("iteration"), F.col("n_open").alias("n_next"))
    left = 2 * (F.col("n_open") - F.col("n_pruned") - F.col("n_completed"))
    ends = total.join(after, "iteration", "left").agg(F.bool_and(left == F.coalesce("n_next", F.lit(0))).alias("adds_up"))
    parts = m.groupBy("iteration").agg(F.sum(F.when(F.col("bucket").isNull(), F.col("n_open")).otherwise(-F.col("n_open"))).alias("d")).agg((F.max(F.abs("d")) == 0).alias("by_bucket"))
    first = m.where("iteration = 0").select("iteration", "bucket", "n_easy", "n_hard", "n_trees", "n_open", "phase")
    return first.join(F.broadcast(ends.join(F.broadcast(parts))))  # one row each


def q27_solve_refused(spark: SparkSession, sf: str) -> DataFrame:
    """One problem per part: maximise x and y with x + y <= half the part's size,
    0 <= x <= size / 3 (a broken bound), 0 <= y <= 2.  By the part's key modulo 5 it
    is clean, has a continuous x, an unbounded y, a second entry for y, or an
    empty box for y; only the clean and the empty ones may be solved."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("problem_id"), F.col("p_size").cast("double").alias("s"), F.pmod("p_partkey", F.lit(5)).alias("k"))
    x = p.select("problem_id", F.lit("x").alias("var"), F.lit(0.0).alias("lb"), (F.col("s") / 3).alias("ub"), F.lit(3.0).alias("obj"), (F.col("k") != 1).alias("is_int"))
    y = p.select("problem_id", F.lit("y").alias("var"), F.when(F.col("k") == 4, F.lit(3.0)).otherwise(F.lit(0.0)).alias("lb"),
                 F.when(F.col("k") == 2, F.lit(float("inf"))).otherwise(F.lit(2.0)).alias("ub"), F.lit(2.0).alias("obj"), F.lit(True).alias("is_int"))
    cons = p.select("problem_id", F.lit("c").alias("con"), F.lit("<=").alias("sense"), (F.col("s") / 2).alias("rhs"))
    entry = p.select("problem_id", F.lit("c").alias("con"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("var"), F.lit(1.0).alias("coef"))
    twice = p.where("k = 3").select("problem_id", F.lit("c").alias("con"), F.lit("y").alias("var"), F.lit(1.0).alias("coef"))
    res = solve(program_from_tables(x.unionByName(y), cons, entry.unionByName(twice), "max"))
    return res.incumbent.select("problem_id", F.col("objective").cast("bigint").alias("best"), "status")


def q35_mix_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Root bounds of the mix program (U4): the Lagrangian one is no worse than the
    box bound and no better than the optimum."""
    prog = X.mix_program(spark, sf)
    known = prepare(prog)
    roots = root_nodes(known.model, N_BUCKETS)
    box = bound_nodes(roots, prog, "box", rounds=0, model=known.bounds_model("box")).select("problem_id", F.col("bound").alias("box"))
    lag = bound_nodes(roots, prog, "lagrangian", rounds=0, model=known.bounds_model()).select("problem_id", F.col("bound").alias("lag"))
    best = solve(prog, prepared=known).incumbent.select("problem_id", "objective")
    j = box.join(lag, "problem_id").join(best, "problem_id")
    return j.select("problem_id", F.col("objective").cast("bigint").alias("best_v"),
                    (F.col("box") <= F.col("lag")).alias("not_worse"), (F.col("lag") <= F.col("objective")).alias("valid"))


# ---------------------------------------------------------------- Q36 – Q42
#: Defects of q36, by the part's key; the first is none.
DEFECTS = ("clean", "null sense", "null coefficient", "NaN rhs", "null rhs", "null objective", "NaN coefficient", "null bound", "unknown row",
           "row twice", "variable twice", "NaN bound", "infinite objective", "entry twice", "bad objective sense", "no objective sense")


def q36_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """One problem per part with one of the DEFECTS: maximise x, 0 <= x <= size, x <= size
    div 2.  Broken problems get status error and their findings (S3); the clean
    ones beside them are solved."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("problem_id"), F.col("p_size").cast("double").alias("s"),
                                        F.element_at(F.array(*[F.lit(d) for d in DEFECTS]), F.pmod("p_partkey", F.lit(len(DEFECTS))).cast("int") + 1).alias("k"))
    is_ = lambda k: F.col("k") == k
    null, nan, inf = F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("inf"))
    vars = p.select("problem_id", F.lit("x").alias("var"), F.when(is_("NaN bound"), nan).otherwise(F.lit(0.0)).alias("lb"), F.when(~is_("null bound"), F.col("s")).alias("ub"),
                    F.when(is_("null objective"), null).when(is_("infinite objective"), inf).otherwise(F.lit(1.0)).alias("obj"), F.lit(True).alias("is_int"), "k")
    cons = p.select("problem_id", F.lit("c").alias("con"), F.when(~is_("null sense"), F.lit("<=")).alias("sense"),
                    F.when(is_("NaN rhs"), nan).when(~is_("null rhs"), F.floor(F.col("s") / 2).cast("double")).alias("rhs"), "k")
    coefs = p.select("problem_id", F.when(is_("unknown row"), F.lit("d")).otherwise(F.lit("c")).alias("con"), F.lit("x").alias("var"),
                     F.when(is_("NaN coefficient"), nan).when(~is_("null coefficient"), F.lit(1.0)).alias("coef"), "k")
    again = lambda t, k: t.unionByName(t.where(is_(k))).drop("k")
    senses = p.where(~is_("no objective sense")).select("problem_id", F.when(is_("bad objective sense"), F.lit("most")).otherwise(F.lit("max")).alias("sense"))
    prog = program_from_tables(again(vars, "variable twice"), again(cons, "row twice"), again(coefs, "entry twice"), senses)
    found = check_program(prog).groupBy("problem_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("findings"))
    best = solve(prog).incumbent.select("problem_id", F.col("objective").cast("bigint").alias("best"), "status")
    return best.join(found, "problem_id", "left").select("problem_id", "best", "status", F.coalesce("findings", F.lit("")).alias("findings"))


def q37_mixed_senses(spark: SparkSession, sf: str) -> DataFrame:
    """One batch of both senses (U3): orders of even key maximise Q22's program, the others minimise Q23's."""
    odd = F.col("problem_id") % 2 == 1
    a, b = X.selection_program(spark, sf), X.mix_program(spark, sf)
    both = [x.where(~odd).unionByName(y.where(odd)) for x, y in ((a.vars, b.vars), (a.cons, b.cons), (a.coefs, b.coefs))]
    senses = both[0].select("problem_id").distinct().withColumn("sense", F.when(odd, F.lit("min")).otherwise(F.lit("max")))
    res = solve(program_from_tables(*both, senses))
    return res.incumbent.select("problem_id", F.col("objective").cast("bigint").alias("best_v"), "status")


def _best(res) -> DataFrame:
    return res.incumbent.select("problem_id", F.col("objective").cast("bigint").alias("best_v"), "status")


def halves(bounds: DataFrame) -> DataFrame:
    """Bound changes that split a node's free lines in two (P4, P5): one of them is chosen
    at most, so either the later half or the earlier half is 0."""
    w = Window.partitionBy("problem_id", "node_id")  # the variables of one node
    free = bounds.where((F.col("lb") < F.col("ub")) & (F.col("lb") == 0)).withColumns({"k": F.row_number().over(w.orderBy("var")), "n": F.count(F.lit(1)).over(w)})
    child = F.when(F.col("k") > F.col("n") / 2, F.lit(0)).otherwise(F.lit(1))
    return free.where("n > 1").select("problem_id", "node_id", child.alias("child"), "var", F.lit(0.0).alias("value"), F.lit(True).alias("is_upper"))


def q41_set_branching(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest line of at least average quantity, found by splitting sets of lines."""
    res = solve(X.one_line_program(spark, sf), changes=halves)
    chosen = R.solution_rows(res.incumbent).where("value > 0.5").groupBy("problem_id").agg(F.count(F.lit(1)).alias("n_chosen"))
    return _best(res).join(chosen, "problem_id", "left")


def q42_mps_records(spark: SparkSession, sf: str) -> DataFrame:
    """MPS text of every record type built from ``part`` (one file per brand): both senses,
    two N rows, a constant, RANGES on each row type, all bound types, sets with and
    without names; read back as one row per sense, variable, row and coefficient."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("file"), "p_partkey", "p_size", F.regexp_extract("p_brand", r"#(\d+)", 1).cast("bigint").alias("b"))
    head = p.select("file", "b").distinct()
    text = lambda rows, no, line: rows.select("file", no.cast("bigint").alias("line_no"), line.alias("line"))
    fixed = lambda no, line: text(head, F.lit(no), F.lit(line))
    lines = [text(head, F.lit(0), F.concat(F.lit("NAME          "), "file"))]
    lines += [text(head.where("b % 2 = 1"), F.lit(1), F.lit("OBJSENSE")), text(head.where("b % 2 = 1"), F.lit(2), F.lit("    MAX")), fixed(3, "* a comment"), fixed(4, "ROWS")]
    lines += [fixed(5 + i, row) for i, row in enumerate((" N  cost", " N  other", " L  most", " G  least", " E  up", " E  down", " L  plain"))]
    lines += [fixed(20, "COLUMNS")]
    column = F.format_string("    P%d  cost  %d  most  %d", "p_partkey", F.col("p_size") * 2, "p_size")
    second = F.format_string("    P%d  other  7  %s  %d", "p_partkey", F.element_at(F.array(*[F.lit(r) for r in ("least", "up", "down", "plain")]), F.pmod("p_partkey", F.lit(4)).cast("int") + 1), F.col("p_size") + 1)
    integer = F.col("p_partkey") % 2 == 0
    lines += [text(p.where(~integer), 100 + 2 * F.col("p_partkey"), column), text(p.where(~integer), 101 + 2 * F.col("p_partkey"), second)]
    far = 10 ** 10
    lines += [fixed(far, "    M1                 'MARKER'                 'INTORG'"), text(p.where(integer), far + 100 + 2 * F.col("p_partkey"), column),
              text(p.where(integer), far + 101 + 2 * F.col("p_partkey"), second), fixed(2 * far, "    M2                 'MARKER'                 'INTEND'")]
    lines += [fixed(3 * far, "RHS"), fixed(3 * far + 1, "    SET  most  100  least  5"), fixed(3 * far + 2, "    up  10  down  20"), fixed(3 * far + 3, "    SET  cost  -50")]
    lines += [fixed(4 * far, "RANGES"), fixed(4 * far + 1, "    R  most  30  least  40"), fixed(4 * far + 2, "    up  3"), fixed(4 * far + 3, "    R  down  -4"), fixed(5 * far, "BOUNDS")]
    kinds = F.element_at(F.array(*[F.lit(f) for f in (" UP BND  P%d  9", " LO BND  P%d  2", " FX P%d  4", " FR BND  P%d", " MI P%d", " PL BND  P%d", " BV BND  P%d", " LI BND  P%d  3", " UI P%d  8", " UP BND  P%d  -5")]),
                         F.pmod("p_partkey", F.lit(11)).cast("int") + 1)
    bounded = p.where("p_partkey % 11 < 10")
    lines += [text(bounded, 5 * far + 1 + F.col("p_partkey"), F.replace(kinds, F.lit("%d"), F.col("p_partkey").cast("string"))), fixed(6 * far, "ENDATA")]
    prog = parse_mps(reduce(DataFrame.unionByName, lines), problem_id=F.regexp_extract("file", r"#(\d+)", 1).cast("bigint"))
    none = F.lit(None).cast("double")
    row = lambda t, kind, name, a, b, c, note: t.select("problem_id", F.lit(kind).alias("kind"), name.alias("name"), a.alias("a"), b.alias("b"), c.alias("c"), note.alias("note"))
    return (row(prog.sense, "sense", F.lit(""), none, none, none, F.col("sense"))
            .unionByName(row(prog.vars, "var", F.col("var"), F.col("lb"), F.col("ub"), F.col("obj"), F.col("is_int").cast("string")))
            .unionByName(row(prog.cons, "row", F.col("con"), F.col("rhs"), none, none, F.col("sense")))
            .unionByName(row(prog.coefs, "entry", F.concat_ws("/", "con", "var"), F.col("coef"), none, none, F.lit(""))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_root_nodes": q01_root_nodes,
    "q02_read_mps": q02_read_mps,
    "q03_check_program": q03_check_program,
    "q04_place": q04_place,
    "q05_solution_rows": q05_solution_rows,
    "q06_metrics_row": q06_metrics_row,
    "q07_effective_bounds": q07_effective_bounds,
    "q08_merge_bounds": q08_merge_bounds,
    "q09_branch": q09_branch,
    "q10_bucket_results": q10_bucket_results,
    "q11_best_solution": q11_best_solution,
    "q12_drop_completed": q12_drop_completed,
    "q13_prune_nodes": q13_prune_nodes,
    "q14_halt_subtrees": q14_halt_subtrees,
    "q15_split_groups": q15_split_groups,
    "q16_count_by_bucket": q16_count_by_bucket,
    "q17_needs_rebalance": q17_needs_rebalance,
    "q18_iteration_budget": q18_iteration_budget,
    "q19_allocate_budget": q19_allocate_budget,
    "q20_plan_moves": q20_plan_moves,
    "q21_apply_moves": q21_apply_moves,
    "q22_solve_selection": q22_solve_selection,
    "q23_solve_mix": q23_solve_mix,
    "q24_leaves_by_subtree": q24_leaves_by_subtree,
    "q25_bound_nodes": q25_bound_nodes,
    "q26_solver_metrics": q26_solver_metrics,
    "q27_solve_refused": q27_solve_refused,
    "q28_nodes_of": q28_nodes_of,
    "q29_assemble_solution": q29_assemble_solution,
    "q30_branch_easy": q30_branch_easy,
    "q31_replace_farmed": q31_replace_farmed,
    "q32_plan_accessors": q32_plan_accessors,
    "q33_select_depth_first": q33_select_depth_first,
    "q34_prune_halt_max": q34_prune_halt_max,
    "q35_mix_bounds": q35_mix_bounds,
    "q36_quarantine": q36_quarantine,
    "q37_mixed_senses": q37_mixed_senses,
    "q41_set_branching": q41_set_branching,
    "q42_mps_records": q42_mps_records,
}
