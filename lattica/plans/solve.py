"""Level-synchronous branch and bound over many programs at once.

One loop turn = one tree level for the open nodes of every problem:

    [round control: phase and budget] → [the nodes that the budget pays for; the rest waits]
    → evaluate (join to the model) → best candidate per problem (incumbent)
    → prune and halt → [farming: which nodes' children start a subtree] → branch → next level

with the same operators that stand alone in ``operators``.  The frontier holds
one small row per open node (bounds that differ from the model's); model columns
never travel with it.  Model, evaluated nodes, incumbents and the next frontier are
tables in the shared folder, dealt by problem (``session.Tables``): a level's joins and
aggregates need no shuffle, a lost executor costs one step of one level, and
those of earlier levels are deleted as soon as nothing reads them.  Counters come
back through Observations (one small row each).

Inside, every problem is minimised (``sign * objective``, ``sign * bound``), so a batch
may hold both senses.  The model and the incumbents shrink with the search: when
only half of their problems are open, the others are set aside.
"""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lattica import schemas
from lattica.operators import balance as B
from lattica.operators.bounds import NODE_KEY, by_least_reduced_cost, effective_bounds, evaluate, evaluation, prepare_model
from lattica.operators.model import checked_model, parts_for, rows_of
from lattica.operators.nodes import NODE_STEPS
from lattica.operators.report import metrics_row, write_level
from lattica.operators.search import best_solution, branch, halt_subtrees, prune_nodes, split_groups, with_branches
from lattica.session import Tables, cut
from lattica.sources.program import PID, Program, root_nodes

N_BUCKETS = B.N_BUCKETS
LIST_POINTS = 256  # a node of at most so many points is solved by listing them
SUBTREE = (PID, "subtree_id")
_INCUMBENT = "problem_id bigint, objective double, status string, values array<double>"
_CONTROL = ("iteration int, phase string, min_hard bigint, avg_easy double, avg_hard double, budget double, n_open bigint, n_expanded bigint, "
            "n_farmed bigint, n_halted bigint")


@dataclass(frozen=True)
class RoundControl:
    """Phase and budget of each level from the live counts per bucket.

    A level is in the solution phase if every bucket holds more than ``threshold``
    hard nodes; otherwise it farms: every hard node that is no subtree's root
    hands its children out as subtrees of their own.  The budget per bucket is
    that of ``iteration_budget``.
    """

    threshold: int = B.MIN_HARD_PER_BUCKET
    w_easy: float = B.W_EASY
    w_hard: float = B.W_HARD
    lo: float = B.BUDGET_LO
    hi: float = B.BUDGET_HI


@dataclass(frozen=True)
class Prepared:
    """A program's checked model, which several steps of a query may share."""

    program: Program
    tables: Tables
    model: DataFrame   # checked_model
    n_sound: int
    n_bad: int

    def sound(self) -> DataFrame:
        return self.model.where(~F.col("bad")).drop("bad")

    def bounds_model(self, method: str = "lagrangian") -> DataFrame:
        """``prepare_model`` of all problems, also of those that ``solve`` refuses."""
        out = self.sound()
        if method == "box":
            out = out.withColumns({"lam": F.transform("b", lambda b: F.lit(0.0)), "single": F.lit(False), "several": F.lit(False)})
        if self.n_bad:
            bad = self.model.where("bad").select(PID)
            only = lambda t: t.join(bad, PID, "left_semi")
            p = self.program
            out = out.unionByName(prepare_model(Program(only(p.vars), only(p.cons), only(p.coefs), p.sense if isinstance(p.sense, str) else only(p.sense)), method))
        return out


def prepare(program: Program, method: str = "lagrangian") -> Prepared:
    """Check the program and fold it to its model, in one pass over its tables."""
    rows = rows_of(program)
    tables = Tables(program.vars.sparkSession, parts_for(program, rows))
    return Prepared(program, tables, *checked_model(program, tables, rows, method))


@dataclass
class SolveResult:
    incumbent: DataFrame          # problem_id, objective, status, values
    frontier: DataFrame           # open nodes left at the iteration limit (map form)
    metrics: DataFrame            # run_metrics rows, one per level (and bucket, if tracked)
    levels: int = 0
    nodes: int = 0
    level_nodes: list = field(default_factory=list)
    control: DataFrame | None = None   # phase, budget and counts of each level
    ledger: DataFrame | None = None    # share and expansions per level and subtree, if tracked
    trace: list = field(default_factory=list)  # the tables of each level, if asked for


def solve(program: Program, max_iterations: int | None = None, rel_gap: float = 0.0, method: str = "lagrangian",
          n_buckets: int = N_BUCKETS, rounds: int = 2, frontier: DataFrame | None = None, incumbent: DataFrame | None = None,
          budget: float | None = None, depth_first: bool = False, branch_rule: Callable[[Column], Column] = by_least_reduced_cost,
          easy_when: Column | None = None, track: bool = False, max_hard: int | None = None, by_subtree: bool = False,
          control: RoundControl | None = None, changes: Callable[[DataFrame], DataFrame] | None = None, sink: str | None = None,
          first_level: int = 0, keep_levels: bool = False, prepared: Prepared | None = None, list_points: int | None = None) -> SolveResult:
    """Solve every program of the batch to optimality (or to ``rel_gap``).

    Returns the incumbent per problem in the program's own sense, with status
    ``optimal`` (search finished, gap 0), ``feasible`` (open nodes left, or gap
    > 0), ``infeasible``, ``unknown`` (open nodes and no solution) or ``error`` (a
    finding of ``check_program`` that is unsupported: the problem is not touched, and
    the others are solved).

    ``max_iterations`` levels are done at most; ``frontier`` and ``incumbent`` of
    such a result go on with it.  ``budget`` expands that many nodes per bucket
    and level, best bound first or deepest first; the others wait, none is
    dropped.  With ``by_subtree`` the budget is in node costs and is shared by the
    bucket's subtrees (``fair_shares``); what a subtree cannot spend on whole nodes is
    credited to its next level.  ``max_hard``: when a subtree holds more hard
    leaves, the children of its hard nodes start subtrees of their own.
    ``control`` sets phase (farm everything or solve) and budget of each level from the
    live counts, shared by subtree.  ``rel_gap`` halts whole subtrees.

    ``branch_rule`` scores a variable; ``changes`` is a rule of another kind: from the
    open nodes' bounds (problem_id, node_id, var, lb, ub, obj, is_int) to bound
    changes (problem_id, node_id, child, var, value, is_upper).  Its children must
    cover all solutions of the node and be smaller; nodes it leaves out are split by ``branch_rule``.

    ``track`` adds metrics rows per bucket and the ledger of subtrees; ``sink`` is a
    folder for the state after each level (``report.write_level``), from which
    ``resume`` goes on; ``keep_levels`` keeps references to the tables of all levels.

    ``prepared`` is the program's ``prepare(program, method)``, if there is one already.  A node
    of at most ``list_points`` points is solved by listing them.  By default these are LIST_POINTS,
    and none where the caller steers or follows the tree itself (an argument from
    ``max_iterations`` to ``keep_levels`` other than ``rel_gap``, ``track``, ``n_buckets``, ``rounds`` and the bounds).
    """
    spark = program.vars.sparkSession
    known = prepared or prepare(program, method)
    tables = known.tables
    signs = known.model.select(PID, "bad", "sign", "names")
    own = known.sound()
    model = own.withColumn("sign", F.lit(1.0))  # inside the loop everything is minimised
    # Multipliers travel with the nodes only where some problem has several rows.
    warm = not own.where("several").isEmpty()
    variables = _variables(own)
    if list_points is None:
        steered = (max_iterations, budget, easy_when, max_hard, control, changes, sink)
        list_points = 0 if any(x is not None for x in steered) or keep_levels or first_level else LIST_POINTS
    steps = evaluation(rounds, branch_rule, NODE_STEPS if warm else 0, list_points)

    if incumbent is None:
        best = None
    else:
        held_points = incumbent.where(F.col("values").isNotNull()).join(signs, PID)
        best = tables.deal(held_points.select(PID, (F.col("sign") * F.col("objective")).alias("objective"), F.lit(schemas.FEASIBLE).alias("status"),
                                              F.transform("names", lambda n: F.try_element_at("values", n)).alias("values")))
    fields = [f.name for f in schemas.FRONTIER.fields]
    lam = [F.lit(None).cast("array<double>").alias("lam")] if warm else []
    if frontier is None:  # the roots lie with the model
        open_, n_open, n_problems = root_nodes(own, n_buckets).select(*fields, *lam), known.n_sound, known.n_sound
    else:
        start = frontier.join(signs.where(~F.col("bad")).select(PID, "sign"), PID).withColumn("bound", F.col("sign") * F.col("bound"))
        open_, n_open, n_problems = _counted(tables, start.select(*fields, *lam).repartition(tables.parts, PID), "root")
    held = n_problems  # problems in the model and the incumbents, about

    level, total, level_nodes, metrics, controls, ledgers, kept_levels, aside = first_level, 0, [], [], [], [], [], []
    credits = None
    share_out = by_subtree or control is not None
    trace = os.environ.get("LATTICA_TRACE") == "1"
    while n_open and (max_iterations is None or level - first_level < max_iterations):
        t0 = time.perf_counter()
        state = {"phase": "solve", "min_hard": None, "avg_easy": None, "avg_hard": None, "budget": None if budget is None else float(budget)}
        if control is not None:
            state = _round(open_, control, n_buckets)
        chosen, waiting, shares, passing = open_, None, None, []
        if share_out and state["budget"] is not None:
            cost = (control.w_easy, control.w_hard) if control is not None else (B.W_EASY, B.W_HARD)
            shares = cut(subtree_shares(open_, state["budget"], credits, *cost))
            chosen = cut(B.select_by_share(open_, shares, tie=tuple(NODE_KEY), depth_first=depth_first, w_easy=cost[0], w_hard=cost[1]))
            spent = chosen.groupBy(*SUBTREE).agg(F.sum(B.node_cost(*cost)).alias("spent"), F.count(F.lit(1)).alias("n_expanded"))
            shares = cut(shares.join(spent, list(SUBTREE), "left").na.fill(0, ["spent", "n_expanded"]))
            credits = shares.select(*SUBTREE, (F.col("share") - F.col("spent")).alias("credit"))
            if track:
                ledgers.append(shares.select(F.lit(level).alias("iteration"), *shares.columns))
        elif budget is not None:
            order = F.coalesce("bound", F.lit(float("-inf")))
            chosen = cut(B.select_nodes(open_.withColumn("_o", order), int(budget), order="_o", tie=tuple(NODE_KEY), depth_first=depth_first).drop("_o"))
        if chosen is not open_:
            waiting = open_.join(chosen.select(*NODE_KEY), NODE_KEY, "left_anti")
        counted = Observation(f"lattica_level_{level}")
        nodes = tables.put(evaluate(chosen, model, steps).observe(
            counted, F.count(F.lit(1)).alias("n"), F.count_if("is_easy").alias("n_easy"), F.count(F.col("cand_obj")).alias("n_candidates"),
            F.count_if(F.col("infeasible") | F.col("all_fixed")).alias("n_done")))
        at = counted.get
        if at["n_candidates"]:
            points = nodes.where("cand_obj is not null").select(
                PID, F.col("cand_obj").alias("objective"), F.lit(schemas.FEASIBLE).alias("status"), F.col("cand_x").alias("values"), "node_id")
            last, best = best, tables.put(best_solution(points, best))
            if not keep_levels:
                tables.drop(last)
        elif best is None:
            best = spark.createDataFrame([], _INCUMBENT)
        kept, n_farmed, n_halted = prune_nodes(nodes.where(~F.col("infeasible") & F.col("var").isNotNull()), best), 0, 0
        if rel_gap > 0:
            live = tables.put(kept) if track or keep_levels else kept
            kept = halt_subtrees(live, best, rel_gap)
            if track or keep_levels:
                kept = tables.put(kept)
                passing += [live, kept]
                n_halted = live.select(*SUBTREE).distinct().count() - kept.select(*SUBTREE).distinct().count()
        farm_all = state["phase"] == "farm"
        if changes is not None:
            kept = tables.put(kept)
            passing.append(kept)
            kept = with_branches(kept, changes(effective_bounds(kept, variables)))
        if max_hard is not None or farm_all:
            kept = split_groups(kept, (1 << 62) if max_hard is None else max_hard, farm_all, waiting=waiting)
        n_branched = None
        if keep_levels or changes is not None or "farmed" in kept.columns:
            seen = Observation(f"lattica_kept_{level}")
            farmed = F.col("farmed") if "farmed" in kept.columns else F.lit(False)
            kept = tables.put(kept.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(farmed).alias("farmed")))
            passing.append(kept)
            n_branched, n_farmed = seen.get["n"], seen.get["farmed"]
        children = branch(kept, easy_when)
        if waiting is not None:
            children = children.unionByName(waiting).repartition(tables.parts, PID)
        before, (open_, n_next, n_problems) = open_, _counted(tables, children, f"next_{level}")
        if n_branched is None:
            n_branched = (n_next - n_open + at["n"]) // 2
        n_pruned = at["n"] - n_branched - at["n_done"]
        if track:
            metrics.append(cut(metrics_row(spark, level, cut(B.count_by_bucket(before, n_buckets)), state["phase"], n_pruned, at["n_done"])))
        else:
            row = (level, None, at["n_easy"], at["n"] - at["n_easy"], None, n_open, n_pruned, at["n_done"], state["phase"])
            metrics.append(spark.createDataFrame([row], schemas.RUN_METRICS))
        controls.append((level, state["phase"], state["min_hard"], state["avg_easy"], state["avg_hard"], state["budget"], n_open, at["n"], n_farmed, n_halted))
        if keep_levels:
            kept_levels.append({"open": before, "shares": shares, "nodes": nodes, "best": best, "kept": kept, "next": open_})
        if trace:
            print(f"level {level}: {n_open} open, {at['n']} expanded, {n_next} next, {time.perf_counter() - t0:.2f}s", file=sys.stderr, flush=True)
        level_nodes.append(at["n"])
        total += at["n"]
        if n_problems * 2 < held:  # shrinks at most log2(number of problems) times
            alive = open_.select(PID).distinct()
            last = best, model
            aside.append(tables.put(best.join(alive, PID, "left_anti")))
            best, model = tables.put(best.join(alive, PID, "left_semi")), tables.put(model.join(alive, PID, "left_semi"))
            if not keep_levels:
                tables.drop(*last)
            held = n_problems
        if not keep_levels:
            tables.drop(before, nodes, *passing)
        level, n_open = level + 1, n_next
        if sink is not None:
            write_level(sink, level, _own_sense(open_.select(*fields), signs, "bound"),
                        _with_status(signs, reduce(DataFrame.unionByName, [*aside, best]), open_, rel_gap), metrics[-1])

    if best is None:
        best = spark.createDataFrame([], _INCUMBENT)
    best = reduce(DataFrame.unionByName, [*aside, best])
    result = _with_status(signs, best, open_ if n_open else None, rel_gap)
    table = reduce(DataFrame.unionByName, metrics) if metrics else spark.createDataFrame([], schemas.RUN_METRICS)
    ledger = reduce(DataFrame.unionByName, ledgers) if ledgers else None
    return SolveResult(result, _own_sense(open_.select(*fields), signs, "bound"), table, level - first_level, total, level_nodes,
                       spark.createDataFrame(controls, _CONTROL), ledger, kept_levels)


def _counted(tables: Tables, nodes: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """``nodes`` as a table, their number and about how many problems they are of.  They are counted
    last: adaptive execution leaves out what lies under a shuffle of no rows, and its counters."""
    seen = Observation(f"lattica_{name}")
    nodes = tables.put(nodes.observe(seen, F.count(F.lit(1)).alias("n"), F.approx_count_distinct(PID).alias("problems")))
    got = seen.get
    return nodes, got["n"], got["problems"]


def _variables(model: DataFrame) -> DataFrame:
    """The variables of a model as rows, in their own sense."""
    one = F.inline(F.arrays_zip("names", "vlb", "vub", "c"))
    return model.select(PID, "sign", one).select(PID, F.col("names").alias("var"), F.col("vlb").alias("lb"), F.col("vub").alias("ub"),
                                                 (F.col("sign") * F.col("c")).alias("obj"), F.lit(True).alias("is_int"))


def _round(nodes: DataFrame, control: RoundControl, n_buckets: int) -> dict:
    """Phase and budget from the counts of the open nodes: one row reaches the driver."""
    counts = cut(B.count_by_bucket(nodes, n_buckets, trees=False))
    phase = B.needs_rebalance(counts, control.threshold)
    budget = B.iteration_budget(counts, control.w_easy, control.w_hard, control.lo, control.hi)
    row = phase.join(F.broadcast(budget)).first()  # one row each
    return {"phase": "solve" if row["solution_phase"] else "farm", **{c: row[c] for c in ("min_hard", "avg_easy", "avg_hard", "budget")}}


def subtree_shares(nodes: DataFrame, budget: float, credits: DataFrame | None = None, w_easy: float = B.W_EASY, w_hard: float = B.W_HARD) -> DataFrame:
    """(problem_id, subtree_id, bucket, n_easy, n_hard, w, demand, share) of every subtree of ``nodes``.

    ``share`` is the fair share of the bucket's budget, one node at least, and the
    subtree's credit from the level before.  The first subtree by (problem_id,
    subtree_id) gets a bucket's surplus.
    """
    leaves = B.leaves_by_subtree(nodes, (*SUBTREE, "bucket"))
    out = B.fair_shares(leaves, budget, w_easy, w_hard, floor=max(w_easy, w_hard), order=PID, tie="subtree_id")
    if credits is not None:
        out = out.join(credits, list(SUBTREE), "left").withColumn("share", F.col("share") + F.coalesce("credit", F.lit(0.0))).drop("credit")
    return out


def resume(program: Program, path: str, **options) -> SolveResult:
    """Go on with the run whose levels ``solve(sink=path)`` wrote, from the last whole level.

    The program must be the same; ``options`` are those of ``solve``.  Credits of
    subtrees start anew.
    """
    from lattica.operators.report import last_level, read_level

    spark = program.vars.sparkSession
    level = last_level(spark, path)
    if level is None:
        return solve(program, sink=path, **options)
    state = read_level(spark, path, level)
    return solve(program, frontier=state["frontier"], incumbent=state["incumbent"], sink=path, first_level=level, **options)


def _own_sense(df: DataFrame, signs: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` turned back to the sense of each problem."""
    return df.join(signs.select(PID, "sign"), PID).withColumn(column, F.col("sign") * F.col(column)).drop("sign").select(*df.columns)


def _with_status(signs: DataFrame, best: DataFrame, open_: DataFrame | None, rel_gap: float) -> DataFrame:
    """Every problem of the batch with its objective, status and values as a map."""
    out = signs.join(best.drop("status"), PID, "left")
    if open_ is not None:
        out = out.join(open_.select(PID).distinct().withColumn("_open", F.lit(True)), PID, "left")
    still, has = F.coalesce("_open", F.lit(False)) if open_ is not None else F.lit(False), F.col("objective").isNotNull()
    status = (F.when(F.col("bad"), F.lit(schemas.ERROR))
              .when(has & ~still & F.lit(rel_gap <= 0), F.lit(schemas.OPTIMAL))
              .when(has, F.lit(schemas.FEASIBLE))
              .when(still, F.lit(schemas.UNKNOWN))
              .otherwise(F.lit(schemas.INFEASIBLE)))
    return out.select(PID, (F.col("sign") * F.col("objective")).alias("objective"), status.alias("status"), F.map_from_arrays("names", "values").alias("values"))
