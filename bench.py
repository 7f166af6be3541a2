"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric": ..., "value": total seconds, "unit": "sec",
"queries": {name: seconds}, "sf": ..., ...}.  Each query is fully evaluated
through the ``noop`` sink (no collect to the driver).  Extra per-query facts
(levels and nodes of the solver runs) go under "details".
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from lattica.operators import balance as B  # noqa: E402
from lattica.plans import catalog as C  # noqa: E402
from lattica.plans import fixtures as X  # noqa: E402
from lattica.plans.solve import solve  # noqa: E402
from lattica.session import local_session  # noqa: E402

HEADLINE = ["q16_count_by_bucket", "q20_plan_moves", "q21_apply_moves", "q22_solve_selection"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    n_cores = int(cpus) if cpus.isdigit() else os.cpu_count()
    spark = local_session(cpus, shuffle_partitions=max(8, n_cores))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    # Warm the JVM (class loading, codegen caches) on a tiny query first.
    X.work_items(spark, sf_dir).select(F.count(F.lit(1))).collect()

    times, details = {}, {}
    for name in names:
        t0 = time.perf_counter()
        if name == "q22_solve_selection":
            res = solve(X.selection_program(spark, sf_dir))
            res.incumbent.write.mode("overwrite").format("noop").save()
            details[name] = {"levels": res.levels, "nodes": res.nodes}
        else:
            df = C.QUERIES[name](spark, sf_dir)
            df.write.mode("overwrite").format("noop").save()
        times[name] = round(time.perf_counter() - t0, 3)

    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "details": details,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
