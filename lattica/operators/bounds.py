"""Node relaxation: effective bounds, propagation, bounds, candidates, branching choice.

A program is one row of the *model*: its variables in name order as arrays, and
its rows as one dense row-major array, all minimised (``c = sign · obj``) with
``a·x <= b``.  A node is one row of the map-form frontier: only the bounds that
differ from the model's.  Evaluating nodes is one join on ``problem_id`` (which
adaptive execution splits for a problem with very many nodes) and the arithmetic of
``operators.nodes`` on whole Arrow batches of joined rows: no explode, sort or fold
over rows, and no model column in the frontier.  The unit of work is the node: its
arrays must fit one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.bounds import tighten_lower, tighten_upper
from lattica.operators.nodes import BOXES, CHOICE, RELAXED, ROUND_EPS, relaxed, root_multipliers
from lattica.sources.program import PID, Program, normalized_rows

NODE_KEY = [PID, "node_id"]


# --------------------------------------------------------------------------- P1
def effective_bounds(frontier: DataFrame, vars: DataFrame) -> DataFrame:
    """Each node's bounds per variable: base bounds tightened by its overrides.

    ``frontier ⋈ vars`` on ``problem_id``; ``try_element_at`` gives null for a
    missing key and ``greatest``/``least`` skip nulls, so no override = base bound.
    Output ``(problem_id, node_id, var, lb, ub, obj, is_int)``.
    """
    f = frontier.select(PID, "node_id", "lower", "upper")
    v = vars.select(PID, "var", F.col("lb").alias("vlb"), F.col("ub").alias("vub"), "obj", "is_int")
    return f.join(v, PID).select(
        PID, "node_id", "var",
        tighten_lower("vlb", F.try_element_at("lower", F.col("var"))).alias("lb"),
        tighten_upper("vub", F.try_element_at("upper", F.col("var"))).alias("ub"),
        "obj", "is_int",
    )


# --------------------------------------------------------------------- model
def prepare_model(program: Program, method: str = "lagrangian") -> DataFrame:
    """One row per problem: names, sign, c, vlb, vub, rows as ``a`` (row-major) and ``b``, lam, int_obj.

    Boxes of integer variables are rounded inward.  ``method`` is ``"box"``
    (λ = 0) or ``"lagrangian"`` (root multipliers for programs with several rows;
    a single row's are found per node).  Problems of ``check_program`` must be
    left out before.
    """
    if method not in ("box", "lagrangian"):
        raise ValueError(f"method must be 'box' or 'lagrangian', not {method!r}")
    v = program.with_sign(program.vars).groupBy(PID).agg(F.max("sign").alias("sign"), F.sort_array(F.collect_list(F.struct(
        "var", (F.col("sign") * F.col("obj")).alias("c"), F.ceil(F.col("lb") - ROUND_EPS).cast("double").alias("l"),
        F.floor(F.col("ub") + ROUND_EPS).cast("double").alias("u")))).alias("v"))
    entries = normalized_rows(program).groupBy(PID, "row").agg(
        F.max("b").alias("b"), F.sort_array(F.collect_list(F.when(F.col("var").isNotNull(), F.struct("var", "a")))).alias("e"))
    rows = entries.groupBy(PID).agg(F.sort_array(F.collect_list(F.struct("row", "b", "e"))).alias("sparse"))
    of_row = lambda m: F.transform("names", lambda n: F.coalesce(F.try_element_at(m, n), F.lit(0.0)))
    dense = F.flatten(F.transform("sparse", lambda r: F.transform(F.array(F.map_from_entries(r["e"])), of_row)[0]))
    model = (v.join(rows, PID, "left").withColumn("sparse", F.coalesce("sparse", F.array().cast(rows.schema["sparse"].dataType)))
             .select(PID, "sign", F.transform("v", lambda e: e["var"]).alias("names"), F.transform("v", lambda e: e["c"]).alias("c"),
                     F.transform("v", lambda e: e["l"]).alias("vlb"), F.transform("v", lambda e: e["u"]).alias("vub"), "sparse"))
    model = model.select(PID, "sign", "names", "c", "vlb", "vub", dense.alias("a"), F.transform("sparse", lambda r: r["b"]).alias("b"),
                         F.forall("c", lambda c: c == F.floor(c)).alias("int_obj"))
    if method == "box":
        return model.withColumns({"lam": F.transform("b", lambda b: F.lit(0.0)), "single": F.lit(False), "several": F.lit(False)})
    at_root = F.arrow_udf(lambda c, l, u, a, b: root_multipliers(c, l, u, a, b), "array<double>").asNondeterministic()
    return (model.withColumn("lam", at_root("c", "vlb", "vub", "a", "b"))
            .withColumns({"single": F.size("b") == 1, "several": F.size("b") > 1}))


# --------------------------------------------------------------- evaluation
def by_reduced_cost(v: Column) -> Column:
    """Branching score of a variable (fields c, r, l, u): ``|rc|·(ub − lb)``."""
    return F.abs(v["r"]) * (v["u"] - v["l"])


def by_least_reduced_cost(v: Column) -> Column:
    """``−|rc|``: the variable that the relaxation leaves least decided, for the smallest trees."""
    return -F.abs(v["r"])


def by_cost(v: Column) -> Column:
    """``|c|·(ub − lb)``."""
    return F.abs(v["c"]) * (v["u"] - v["l"])


#: Rules whose choice the node step makes itself, by their names there.
_KNOWN = {by_reduced_cost: "reduced cost", by_least_reduced_cost: "least reduced cost", by_cost: "cost"}


def evaluation(rounds: int = 2, branch_rule: Callable[[Column], Column] = by_reduced_cost, node_steps: int = 0, points: int = 0) -> list[dict[str, Column]]:
    """The steps of ``evaluate`` as columns over a node joined to its model.

    They are built once for all levels of a search.  ``node_steps`` dual steps improve a
    node's multipliers of several rows from its parent's.  A node whose box holds at
    most ``points`` points is solved by listing them: its bound is its optimum.
    """
    lower = F.zip_with("names", "vlb", lambda n, b: F.greatest(b, F.try_element_at(F.col("lower"), n)))
    upper = F.zip_with("names", "vub", lambda n, b: F.least(b, F.try_element_at(F.col("upper"), n)))
    lower, upper = (F.when(F.size(m) == 0, F.col(v)).otherwise(bounds) for m, v, bounds in (("lower", "vlb", lower), ("upper", "vub", upper)))

    score = _KNOWN.get(branch_rule)
    relax = F.arrow_udf(lambda *columns: relaxed(rounds, node_steps, *columns, score=score, points=points), f"{RELAXED}, {CHOICE if score else BOXES}").asNondeterministic()
    node = {"_e": relax("c", lower, upper, "a", "b", F.col("model_lam"), "_own", "bound", "sign", "int_obj", F.col("single") | F.col("several"))}
    result = {"bound": F.col("_e.bound"), **{name: F.col(f"_e.{name}") for name in ("infeasible", "all_fixed", "cand_obj", "cand_kind", "cand_x")}}
    if score:
        return [node, {"_j": F.col("_e.j")}, result | {"var": F.get("names", F.col("_j")), "split": F.col("_e.split")}]
    scores = F.transform("_v", lambda e, j: F.when(e["l"] < e["u"], F.struct((-branch_rule(e)).alias("s"), j.alias("j"))))
    chosen = F.get("_v", F.col("_j"))
    return [
        node,
        {name: F.col(f"_e.{name}") for name in ("r", "l", "u")},
        {"_v": F.arrays_zip("c", "r", "l", "u")},
        {"_j": F.array_min(scores)["j"]},
        result | {"var": F.get("names", F.col("_j")), "split": F.floor((chosen["l"] + chosen["u"]) / 2).cast("double")},
    ]


RESULT = ["infeasible", "all_fixed", "cand_obj", "cand_kind", "cand_x", "var", "split"]


def evaluate(frontier: DataFrame, model: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    """Frontier rows with their bound renewed and RESULT added (U4, P5).

    ``bound`` = max(box, Lagrangian, parent bound), rounded for integral costs, in
    the program's own sense; the Lagrangian of a single row is the node's LP
    bound.  ``cand_obj`` / ``cand_x`` are the best of the candidate points that
    hold in all rows (rounding by cost, by reduced cost, and the greedy fill or
    repair), ``var`` / ``split`` the branching choice: the free variable with the
    greatest score, ties by name; null if all are fixed.  A column ``lam`` of the
    frontier holds the parent's multipliers of several rows: the node improves them by a
    few dual steps and hands them on; without it, or where it is null, the root's are used.
    """
    carried = "lam" in frontier.columns
    own = F.col("lam") if carried else F.lit(None).cast("array<double>")
    df = frontier.withColumn("_own", own).drop("lam").join(model.withColumnRenamed("lam", "model_lam"), PID)
    for step in steps:
        df = df.withColumns(step)
    lam = [F.when(F.col("several"), F.col("_e.lam")).alias("lam")] if carried else []
    return df.select(*[c for c in frontier.columns if c != "lam"], *lam, *RESULT)


def bound_nodes(frontier: DataFrame, program: Program, method: str = "box", rounds: int = 2,
                branch_rule: Callable[[Column], Column] = by_reduced_cost, model: DataFrame | None = None) -> DataFrame:
    """Bound every node of a map-form frontier (U4): the frontier with RESULT added.
    ``model`` is the program's prepared model, if there is one already."""
    return evaluate(frontier, prepare_model(program, method) if model is None else model, evaluation(rounds, branch_rule))
