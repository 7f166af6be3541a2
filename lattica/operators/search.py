"""Search operators on the map-form ``frontier``.

All take and return DataFrames.  Per-problem tables (``incumbent``) are joined
with plain equi-joins: they grow with the number of problems, so no broadcast
hint is forced; AQE broadcasts them at run time when they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica import schemas
from lattica.functions.bounds import is_completed, is_feasible_or_optimal, is_subtree_root, merge_lower, merge_upper
from lattica.sources.program import PID

NODE_KEY = [PID, "node_id"]
# Fixed reference values: a subtree may hold 32 hard leaves before farming.
MAX_HARD_LEAVES = 32
GAP_EPS = 1e-10


def _sign(sense: str) -> float:
    if sense not in ("min", "max"):
        raise ValueError("sense must be 'min' or 'max'")
    return 1.0 if sense == "min" else -1.0


def _tightest(changes: Column, upper: bool) -> Column:
    """The upper (or lower) changes of one child as a map, the strictest of each variable."""
    mine = F.filter(changes, lambda c: c["is_upper"] == upper)
    best = F.array_min if upper else F.array_max
    names = F.array_distinct(F.transform(mine, lambda c: c["var"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: best(F.transform(F.filter(mine, lambda c: c["var"] == n), lambda c: c["value"]))))


def with_branches(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """``nodes`` with ``branches`` (P5): for each child, of which there are two at most,
    an array of its bound changes (var, value, is_upper).

    ``changes``: problem_id, node_id, child (0 or 1), var, value, is_upper; a child may change any
    number of bounds.  Nodes without changes keep their (var, split) branch; a
    third child is an error.
    """
    per = changes.groupBy(*NODE_KEY, "child").agg(F.sort_array(F.collect_list(F.struct("var", "value", "is_upper"))).alias("c"))
    per = per.groupBy(*NODE_KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("child", "c"))), lambda e: e["c"]).alias("branches"),
                                     F.max("child").alias("_last"), F.min("child").alias("_least"))
    out = nodes.join(per, NODE_KEY, "left")
    fits = F.col("branches").isNull() | ((F.col("_least") >= 0) & (F.col("_last") <= 1))
    return out.withColumn("branches", F.when(fits, F.col("branches")).otherwise(F.raise_error(F.lit("the children of a node are 0 and 1")))).drop("_last", "_least")


def branch(nodes: DataFrame, easy_when: Column | None = None) -> DataFrame:
    """Two children per node with a branching choice ``var`` / ``split`` (P4, P11):
    down ``upper[var] = split``, up ``lower[var] = split + 1``, merged into the
    parent's maps keeping the stricter bound (P3).  A column ``branches`` (of
    ``with_branches``) gives at most two children with any number of bound changes
    each instead, where it is not null.  ``depth + 1``; ``node_id`` = parent id + ``0``/``1``;
    children are hard unless ``easy_when`` (a Column over the child) says so.  Nodes
    without a choice are not branched (they are dropped).  Children of a node with
    ``farmed`` (a column of ``split_groups``) start a subtree each.  A column ``lam``
    (the node's multipliers) goes on to the children."""
    general = "branches" in nodes.columns
    choice = F.col("var").isNotNull()
    if general:
        j = nodes.where(choice | F.col("branches").isNotNull())
        sides = F.sequence(F.lit(0), F.coalesce(F.size("branches"), F.lit(2)) - 1)
        j = j.select("*", F.explode(sides).alias("side")).withColumn("_c", F.get("branches", F.col("side")))
    else:
        j = nodes.where(choice).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    one = F.create_map(F.col("var"), F.col("split"))
    one_up = F.create_map(F.col("var"), F.col("split") + 1)
    lower = F.when(F.col("side") == 1, merge_lower("lower", one_up)).otherwise(F.col("lower"))
    upper = F.when(F.col("side") == 0, merge_upper("upper", one)).otherwise(F.col("upper"))
    if general:
        lower = F.when(F.col("_c").isNotNull(), merge_lower("lower", _tightest(F.col("_c"), False))).otherwise(lower)
        upper = F.when(F.col("_c").isNotNull(), merge_upper("upper", _tightest(F.col("_c"), True))).otherwise(upper)
    child = F.concat(F.col("node_id"), F.col("side").cast("string"))
    farmed = F.coalesce(F.col("farmed"), F.lit(False)) if "farmed" in nodes.columns else None
    own = lambda new, old: F.col(old).alias(old) if farmed is None else F.when(farmed, new).otherwise(F.col(old)).alias(old)
    out = j.select(
        PID, child.alias("node_id"), F.col("node_id").alias("parent_id"),
        own(child, "subtree_id"), own(F.col("depth") + 1, "subtree_root_depth"), "bucket",
        (F.col("depth") + 1).alias("depth"), F.lit(False).alias("is_easy"), lower.alias("lower"), upper.alias("upper"),
        "bound", F.lit(schemas.OPEN).alias("status"), *(["lam"] if "lam" in nodes.columns else []),
    )
    if easy_when is not None:
        out = out.withColumn("is_easy", F.coalesce(easy_when, F.lit(False)))
    return out


def replace_farmed(nodes: DataFrame, easy_when: Column | None = None) -> DataFrame:
    """Farmed parents replaced by their children (F6): every child of a node with
    ``farmed`` starts a subtree of its own; the other nodes stay as they are.
    A farmed node without a branching choice stays too."""
    farmed = F.col("farmed") & F.col("var").isNotNull()
    stay = nodes.where(~farmed).select(*[f.name for f in schemas.FRONTIER.fields])
    return stay.unionByName(branch(nodes.where(farmed), easy_when))


def prune_nodes(nodes: DataFrame, incumbent: DataFrame, sense: str = "min",
                bound: str = "bound", objective: str = "objective") -> DataFrame:
    """Keep nodes whose bound can still beat their problem's incumbent.

    Discard when ``bound >= objective`` (minimise) or ``bound <= objective``
    (maximise); problems without an incumbent keep all nodes.
    """
    s = _sign(sense)
    inc = incumbent.select(PID, F.col(objective).alias("_inc"))
    j = nodes.join(inc, PID, "left")
    keep = F.col("_inc").isNull() | F.col(bound).isNull() | (F.lit(s) * F.col(bound) < F.lit(s) * F.col("_inc"))
    return j.where(keep).drop("_inc")


def halt_subtrees(nodes: DataFrame, incumbent: DataFrame, rel_gap: float = 0.05, sense: str = "min",
                  key: str = "subtree_id", bound: str = "bound", objective: str = "objective") -> DataFrame:
    """Drop every node of a subtree that should halt.

    Per (problem, subtree) the best bound (min when minimising); halt when an
    incumbent exists and either ``|best − inc| / (|inc| + 1e-10) <= rel_gap``
    (gap test, D8) or the best bound cannot beat the incumbent (inferiority).
    Partial+final aggregate, then ``left_anti``.
    """
    s = _sign(sense)
    best = nodes.groupBy(PID, key).agg(F.min(F.lit(s) * F.col(bound)).alias("_best"))
    inc = incumbent.select(PID, (F.lit(s) * F.col(objective)).alias("_inc"))
    j = best.join(inc, PID)
    gap = F.abs((F.col("_best") - F.col("_inc")) / (F.abs(F.col("_inc")) + F.lit(GAP_EPS)))
    halted = j.where(F.col("_inc").isNotNull() & ((gap <= rel_gap) | (F.col("_best") >= F.col("_inc"))))
    return nodes.join(halted.select(PID, key), [PID, key], "left_anti")


def drop_completed(df: DataFrame, status: str = "status") -> DataFrame:
    """Keep unfinished rows (F1): not error/optimal/infeasible/unbounded/aborted."""
    return df.where(~is_completed(status))


def best_solution(solutions: DataFrame, incumbent: DataFrame | None = None, sense: str = "min",
                  tie: str | None = "node_id") -> DataFrame:
    """Best solution per problem.

    Only feasible/optimal rows compete; the old incumbent wins ties (D14), then
    the smallest ``tie`` value.  Output ``(problem_id, objective, status, values)``.
    One ``min_by`` over an ordering struct per problem (partial aggregation).
    """
    s = _sign(sense)
    cand = solutions.where(is_feasible_or_optimal("status")).select(
        PID, "objective", "status", "values", F.lit(1).alias("_new"),
        (F.col(tie).cast("string") if tie else F.lit("")).alias("_tie"))
    if incumbent is not None:
        old = incumbent.where(is_feasible_or_optimal("status")).select(
            PID, "objective", "status", "values", F.lit(0).alias("_new"), F.lit("").alias("_tie"))
        cand = old.unionByName(cand)
    best = cand.groupBy(PID).agg(F.min_by(
        F.struct("objective", "status", "values"),
        F.when(F.col("objective").isNotNull(),
               F.struct((F.lit(s) * F.col("objective")).alias("o"), F.col("_new"), F.col("_tie")))).alias("b"))
    return best.select(PID, "b.objective", "b.status", "b.values")


def split_groups(nodes: DataFrame, max_hard: int = MAX_HARD_LEAVES, farm_all: bool = False,
                 key: str = "subtree_id", waiting: DataFrame | None = None) -> DataFrame:
    """Farming decision per node (F5): adds ``farmed``.

    Never for a subtree root or an easy node; always when its (problem,
    subtree) group holds more than ``max_hard`` hard nodes; otherwise
    ``farm_all``.  The group count is an aggregate joined back (no window, so a
    hot group is not sorted in one task); null keys are groups too.  ``waiting``
    are further leaves of the groups, which count but are not decided on.
    """
    leaves = nodes.select(PID, key, "is_easy")
    if waiting is not None:
        leaves = leaves.unionByName(waiting.select(PID, key, "is_easy"))
    counts = leaves.groupBy(F.col(PID).alias("_p"), F.col(key).alias("_k")).agg(F.count_if(~F.col("is_easy")).alias("n_hard_group"))
    j = nodes.join(counts, F.col(PID).eqNullSafe(F.col("_p")) & F.col(key).eqNullSafe(F.col("_k"))).drop("_p", "_k")
    farm = (F.when(is_subtree_root("depth", "subtree_root_depth") | F.col("is_easy"), F.lit(False))
            .when(F.col("n_hard_group") > max_hard, F.lit(True))
            .otherwise(F.lit(bool(farm_all))))
    return j.withColumn("farmed", F.coalesce(farm, F.lit(False)))
