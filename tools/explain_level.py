"""Print the physical plan of one solver level on sf0.001 (evaluate, prune, branch),
built from the same operators and checkpointed tables as the loop of ``solve``."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from lattica.operators.bounds import evaluate, evaluation, prepare_model  # noqa: E402
from lattica.operators.search import best_solution, branch, prune_nodes  # noqa: E402
from lattica.plans import fixtures as X  # noqa: E402
from lattica.session import cut, local_session  # noqa: E402
from lattica.sources.program import root_nodes  # noqa: E402


def main() -> None:
    spark = local_session(8, 8)
    prog = X.selection_program(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001")
    model = cut(prepare_model(prog))
    level = evaluate(cut(root_nodes(prog.vars)), model, evaluation(prog.sign))
    level.explain("formatted")
    nodes = cut(level)
    points = nodes.where("cand_obj is not null").select(
        "problem_id", F.col("cand_obj").alias("objective"), F.lit("feasible").alias("status"), F.col("cand_x").alias("values"), "node_id")
    best = cut(best_solution(points, None, prog.sense))
    branch(prune_nodes(nodes.where("not infeasible and var is not null"), best, prog.sense)).explain("formatted")


if __name__ == "__main__":
    main()
