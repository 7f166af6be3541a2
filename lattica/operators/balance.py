"""Work balancing over keyed tables.

Count keyed work per bucket, decide whether to rebalance, size the budget,
plan the moves that even out the load, apply them, place rows on their
bucket's partition, and split a bucket's budget over its groups.

Skew: a single bucket may hold a large share of all rows, so no operator here
sorts or collects a whole bucket in one task.  Ranks and running aggregates
range-partition the rows by (bucket, order), so a hot bucket spreads over many
partitions; each partition is scanned by itself and the counts or totals of the
partitions before it are added.  Ranks are those of the key order at any size
and for any number of partitions.  Only tables whose size is bounded by the
*parameter* ``n_buckets`` (counts, move plans) reach the driver or a broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import cut, shuffle_partitions

# Fixed reference values.
N_BUCKETS = 40            # 10 machines x 4 cores
MIN_HARD_PER_BUCKET = 5   # farm threshold per core
W_EASY, W_HARD = 1, 10    # 6 s and 60 s per easy / hard node, in units of an easy node
BUDGET_LO, BUDGET_HI = 50, 100   # 300 s .. 600 s per iteration, in the same unit
_HELD_MOVES = 1 << 23       # moves held before equal pairs are added up
BROADCAST_ROWS = 1 << 17  # small tables with more rows are joined by a shuffle


def all_buckets(spark, n_buckets: int) -> DataFrame:
    """The ``n_buckets`` bucket ids (bounded by the parameter, not the data)."""
    return spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))


def small_side(df: DataFrame) -> DataFrame:
    """``df`` materialised, with a broadcast hint if its counted size allows one."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


# ------------------------------------------------------------------ A1 A2 A3
def count_by_bucket(nodes: DataFrame, n_buckets: int = N_BUCKETS, trees: bool = True, bucket: str = "bucket",
                    easy: str = "is_easy", tree: tuple[str, ...] | None = None) -> DataFrame:
    """Easy nodes, hard nodes and distinct trees per bucket, every bucket present.

    A tree is a (problem, subtree) pair; ``tree`` names other columns.  Rows whose
    bucket is null or not in ``0 .. n_buckets - 1`` are counted in one more row,
    with a null bucket, which is there only if there are such rows.  Partial
    aggregation pre-counts a hot bucket in every map task; ``count_distinct`` is
    planned as a two-level aggregate on (bucket, tree) first.
    """
    tree = tree or tuple(c for c in ("problem_id", "subtree_id") if c in nodes.columns)
    b = F.col(bucket).cast("int")
    aggs = [F.count_if(F.col(easy)).alias("n_easy"), F.count_if(~F.col(easy)).alias("n_hard")]
    aggs.append(F.count_distinct(F.struct(*tree)).alias("n_trees") if trees else F.lit(0).cast("bigint").alias("n_trees"))
    counts = nodes.groupBy(F.when((b >= 0) & (b < n_buckets), b).alias("bucket")).agg(*aggs)
    # At most n_buckets + 1 rows; zero rows for the buckets without work.
    zeros = all_buckets(nodes.sparkSession, n_buckets).select("bucket", *[F.lit(0).cast("bigint").alias(c) for c in ("n_easy", "n_hard", "n_trees")])
    return counts.unionByName(zeros).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n_easy", "n_hard", "n_trees")])


def leaves_by_subtree(nodes: DataFrame, key: tuple[str, ...] = ("problem_id", "subtree_id"),
                      easy: str = "is_easy") -> DataFrame:
    """Live leaves per subtree (A3): an aggregate over open rows, not a counter."""
    return nodes.groupBy(*key).agg(F.count_if(F.col(easy)).alias("n_easy"),
                                   F.count_if(~F.col(easy)).alias("n_hard"))


# --------------------------------------------------------------------- A5 A6
def needs_rebalance(counts: DataFrame, threshold: int = MIN_HARD_PER_BUCKET) -> DataFrame:
    """One row: ``min_hard`` over all buckets (zero-filled) and whether the run is
    in its solution phase (``min_hard > threshold``, strict, D16); rebalance
    otherwise (A5)."""
    least = F.coalesce("min_hard", F.lit(0))
    return counts.where("bucket is not null").agg(F.min("n_hard").alias("min_hard")).select(
        least.alias("min_hard"), (least > threshold).alias("solution_phase"), (least <= threshold).alias("needs_rebalance"))


def iteration_budget(counts: DataFrame, w_easy: float = W_EASY, w_hard: float = W_HARD,
                     lo: float = BUDGET_LO, hi: float = BUDGET_HI) -> DataFrame:
    """One row: average easy/hard nodes per bucket (all buckets) and the budget
    ``least(greatest(w_hard·avg_hard + w_easy·avg_easy, lo), hi)`` in node
    expansions (A6, D7)."""
    a = counts.where("bucket is not null").agg(F.avg("n_easy").alias("avg_easy"), F.avg("n_hard").alias("avg_hard"))
    raw = F.lit(w_hard) * F.col("avg_hard") + F.lit(w_easy) * F.col("avg_easy")
    return a.select("avg_easy", "avg_hard", F.least(F.greatest(raw, F.lit(lo)), F.lit(hi)).alias("budget"))


# ---------------------------------------------------------------------- W5-W7
def _receiver_runs(ids: np.ndarray, load: np.ndarray, t: int):
    """Slots in the order they are filled: (buckets in turn, number of rounds)."""
    levels = np.append(np.unique(load[load < t]), t).tolist()
    for lo, hi in zip(levels, levels[1:]):
        yield ids[load <= lo], hi - lo


def _donor_runs(ids: np.ndarray, load: np.ndarray, mov: np.ndarray, t: int):
    """Units in the order they are given: a donor gives from its load down to
    ``t``, as far as its movable units reach."""
    gives = (load > t) & (mov > 0)
    ids, high = ids[gives], load[gives]
    low = high - np.minimum(mov[gives], high - t)
    levels = np.unique(np.concatenate([low, high]))[::-1].tolist()
    for hi, lo in zip(levels, levels[1:]):
        active = (low <= lo) & (high >= hi)
        if active.any():
            yield ids[active], hi - lo


def _plan_pass(load: dict[int, int], mov: dict[int, int], t: int) -> pd.DataFrame:
    """The greedy loop "one unit from the highest donor to the lowest receiver"
    against threshold ``t``, as (src, dst, n), by runs: the k-th slot is filled by the
    k-th unit, and between two changes of the active sets both repeat.  There a pair
    meets once in each least common multiple of their numbers, so only the
    places of one such period, or of the run if that is shorter, are looked at."""
    ids = np.array(sorted(load), np.int64)
    loads, movs = (np.array([x[b] for b in ids.tolist()], np.int64) for x in (load, mov))
    slots, units = _receiver_runs(ids, loads, t), _donor_runs(ids, loads, movs, t)
    slot, unit = next(slots, None), next(units, None)
    parts: list[pd.DataFrame] = []
    held = p = s = q = 0  # rows held, position, and where the current runs begin
    while slot is not None and unit is not None:
        (receivers, up), (donors, down) = slot, unit
        k, m = len(receivers), len(donors)
        s_end, q_end = s + k * up, q + m * down
        end = min(s_end, q_end)
        period = math.lcm(k, m)
        places = np.arange(min(end - p, period))
        n = (end - p) // period + (places < (end - p) % period)
        parts.append(pd.DataFrame({"src": donors[(p - q + places) % m], "dst": receivers[(p - s + places) % k], "n": n}))
        held += len(places)
        if held > _HELD_MOVES:
            parts = [pd.concat(parts).groupby(["src", "dst"], as_index=False)["n"].sum()]
            held = len(parts[0])
        p = end
        if s_end == end:
            slot, s = next(slots, None), end
        if q_end == end:
            unit, q = next(units, None), end
    return pd.concat(parts).groupby(["src", "dst"], as_index=False)["n"].sum() if parts else pd.DataFrame({"src": [], "dst": [], "n": []}, dtype=np.int64)


def _moved(load: dict, mov: dict, moves: pd.DataFrame) -> None:
    """Loads after a pass; units received may move again (the reference's counter update)."""
    for side, sign in (("src", -1), ("dst", 1)):
        for bucket, n in moves.groupby(side)["n"].sum().items():
            for x in (load, mov):
                x[bucket] += sign * int(n)


def plan_loads(existing: DataFrame, movable: DataFrame) -> DataFrame:
    """``(bucket, load, mov)``: hard nodes that stay plus hard nodes that may move."""
    e = existing.where("bucket is not null").select("bucket", F.col("n_hard").alias("n_old"))
    m = movable.where("bucket is not null").select("bucket", F.col("n_hard").alias("mov"))
    return e.join(m, "bucket", "full").select(
        "bucket", (F.coalesce("n_old", F.lit(0)) + F.coalesce("mov", F.lit(0))).alias("load"),
        F.coalesce("mov", F.lit(0)).alias("mov"))


def _passes(existing: DataFrame, movable: DataFrame, threshold: int, second_pass: bool):
    """(threshold, moves, loads after) of each pass, from one row per bucket."""
    rows = plan_loads(existing, movable).collect()  # bounded by the parameter n_buckets
    load, mov = {r["bucket"]: r["load"] for r in rows}, {r["bucket"]: r["mov"] for r in rows}
    for number in range(1 + second_pass):
        t = threshold if number == 0 else sum(load.values()) // max(len(load), 1)
        moves = _plan_pass(load, mov, t)
        _moved(load, mov, moves)
        yield t, moves, dict(load)


def plan_moves(existing: DataFrame, movable: DataFrame, threshold: int = MIN_HARD_PER_BUCKET,
               second_pass: bool = True) -> DataFrame:
    """Donation plan ``moves(src, dst, n)``.

    Pass 1 fills every bucket below ``threshold`` from the fullest buckets
    above it that have movable nodes; pass 2 repeats against the floor of the
    average load (D6).  Receiver = lowest load strictly below T (lowest id on
    ties), donor = highest load strictly above T with movable nodes (lowest id
    on ties), one node per step — computed in closed form per pass, so its cost
    depends on the number of buckets, not on how many units move.
    ``existing``/``movable`` are ``bucket_counts`` tables covering every bucket.
    """
    passes = pd.concat([moves for _, moves, _ in _passes(existing, movable, threshold, second_pass)])
    total = passes.groupby(["src", "dst"], as_index=False)["n"].sum().astype({"src": "int32", "dst": "int32", "n": "int64"})
    return existing.sparkSession.createDataFrame(total, "src int, dst int, n bigint")


# ---------------------------------------------------------------------- J4 S5
def _ranged(df: DataFrame, part: str, orders: list[Column], n_partitions: int | None) -> DataFrame:
    """``df`` sorted by (part, orders) over range partitions, cut, with the partition ``_p``.

    Equal sort keys share a partition; a part larger than one spreads over several.
    """
    n = n_partitions or shuffle_partitions(df.sparkSession)
    return cut(df.repartitionByRange(n, F.col(part), *orders)).withColumn("_p", F.spark_partition_id())


def _key(key: str | tuple[str, ...]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def rank_within(df: DataFrame, part: str, key: str | tuple[str, ...], flag: Column | None = None,
                n_partitions: int | None = None) -> DataFrame:
    """Exact 1-based rank of the flagged rows inside ``part``, in the order of ``key``.

    Only flagged rows are sorted; the others get a null rank.  ``key`` should be
    unique in a part; the order of equal keys is arbitrary.
    """
    flag = F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(True)
    orders = [F.col(k).asc() for k in _key(key)]
    s = _ranged(df.where(flag), part, orders, n_partitions)
    counts = s.groupBy(part, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = small_side(counts.select(F.col(part).alias("_part"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    local = F.row_number().over(Window.partitionBy(part, "_p").orderBy(*orders))
    s = s.withColumn("_local", local).join(off, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_p") == F.col("_q")))
    ranked = s.withColumn("rank", F.col("_off") + F.col("_local")).drop("_part", "_p", "_q", "_off", "_local")
    return ranked.unionByName(df.where(~flag).withColumn("rank", F.lit(None).cast("bigint")))


def move_intervals(moves: DataFrame) -> DataFrame:
    """Per source, destinations in ascending id with their rank interval
    ``[lo, hi]`` (cumulative counts) — at most n_buckets² rows."""
    w = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, 0)
    return moves.where(F.col("n") > 0).select(
        "src", "dst", (F.sum("n").over(w) - F.col("n") + 1).alias("lo"), F.sum("n").over(w).alias("hi"))


def apply_moves(nodes: DataFrame, moves: DataFrame, movable: Column | None = None,
                key: str | tuple[str, ...] = ("problem_id", "node_id"), bucket: str = "bucket",
                n_partitions: int | None = None) -> DataFrame:
    """Re-key rows by the plan (J4, D12): the k-th movable row of a source
    (ranked by ``key``) goes to the destination whose interval holds k;
    leftovers and unmovable rows stay.  Adds ``moved``; ``bucket`` becomes the
    destination.  Only the movable rows of sources are ranked and shuffled; the
    plan is matched with an equi-join on the source plus a range condition."""
    mv = F.coalesce(movable if movable is not None else ~F.col("is_easy"), F.lit(False))
    iv = small_side(move_intervals(moves))
    sources = iv.select(F.col("src").alias("_src")).distinct()
    marked = nodes.join(small_side(sources), F.col(bucket) == F.col("_src"), "left").withColumn("_f", mv & F.col("_src").isNotNull()).drop("_src")
    stay = marked.where(~F.col("_f")).drop("_f").withColumn("moved", F.lit(False))
    ranked = rank_within(marked.where("_f").drop("_f"), bucket, key, None, n_partitions)
    j = ranked.join(iv, (F.col(bucket) == iv["src"]) & F.col("rank").between(iv["lo"], iv["hi"]), "left")
    gone = j.withColumn("moved", F.col("dst").isNotNull()) \
            .withColumn(bucket, F.coalesce(F.col("dst").cast("int"), F.col(bucket))) \
            .drop("src", "dst", "lo", "hi", "rank")
    return stay.unionByName(gone)


def place(df: DataFrame, n_buckets: int = N_BUCKETS, bucket: str = "bucket") -> DataFrame:
    """Put every row in the partition numbered by its bucket.
    ``repartitionById`` lands key k in partition k; ``repartition(n, col)`` would
    hash the id instead."""
    return df.repartitionById(n_buckets, F.col(bucket).cast("int"))


def grow_frontier(surviving: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Next frontier = surviving ∪ new (bag union, U1)."""
    return surviving.unionByName(new_nodes, allowMissingColumns=True)


# ---------------------------------------------------------------------- W1-W4
_COMBINE = {"min": (F.min, F.least), "max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}


def running_agg(df: DataFrame, part: str, order: str, value: str, how: str = "min", reverse: bool = False,
                tie: str | None = None, out: str | None = None, first: str | None = None,
                n_partitions: int | None = None) -> DataFrame:
    """Running ``min``/``max``/``sum`` of ``value`` inside ``part`` in ``order``, then ``tie``
    (inclusive of the current row; ``reverse`` runs from the end).

    A prefix scan over range partitions: each is scanned by a window of its own,
    and the totals of those before it are carried in.  ``first`` names a column
    that is true for the one row that comes first in its part.
    """
    agg, combine = _COMBINE[how]
    orders = [F.col(c).desc() if reverse else F.col(c).asc() for c in [order, *([tie] if tie else [])]]
    s = _ranged(df, part, orders, n_partitions)
    w = Window.partitionBy(part, "_p").orderBy(*orders)
    s = s.withColumn("_local", agg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if first:
        s = s.withColumn("_row", F.row_number().over(w))
    totals = s.groupBy(part, "_p").agg(agg(value).alias("_total"))
    # Partition numbers follow the sort order, by part ascending.
    before = Window.partitionBy(part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = small_side(totals.select(F.col(part).alias("_part"), F.col("_p").alias("_q"), agg("_total").over(before).alias("_carry"),
                                     (F.count(F.lit(1)).over(before) == 0).alias("_head")))
    s = s.join(carry, F.col(part).eqNullSafe(F.col("_part")) & (F.col("_p") == F.col("_q")))
    s = s.withColumn(out or f"running_{how}", F.when(F.col("_carry").isNull(), F.col("_local")).otherwise(combine(F.col("_local"), F.col("_carry"))))
    if first:
        s = s.withColumn(first, F.col("_head") & (F.col("_row") == 1)).drop("_row")
    return s.drop("_part", "_p", "_q", "_local", "_carry", "_head")


def running_best(df: DataFrame, part: str = "bucket", order: str = "pos", value: str = "objective",
                 sense: str = "min", tie: str | None = None) -> DataFrame:
    """Best objective so far while a bucket walks its subtrees in ``order``."""
    return running_agg(df, part, order, value, "min" if sense == "min" else "max", tie=tie, out="running_best")


def fair_shares(df: DataFrame, budget: float | str, w_easy: float = W_EASY, w_hard: float = W_HARD,
                floor: float = 1.0, part: str = "bucket", order: str = "pos", tie: str | None = None) -> DataFrame:
    """Share of a bucket's budget per subtree (W3, D7), in node expansions, without a scan.

    ``w = w_easy·n_easy + w_hard·n_hard``; ``demand`` = Σ w in the bucket.  share = 0 if budget
    <= 0; if budget > demand: w, plus the whole surplus for the one subtree that
    comes first by (order, tie); else ``greatest(floor, budget·w/demand)``.  ``budget``
    may be a column.  (order, tie) should be unique in a bucket.
    """
    b = F.col(budget) if isinstance(budget, str) else F.lit(float(budget))
    d = df.withColumn("w", F.lit(w_easy) * F.col("n_easy") + F.lit(w_hard) * F.col("n_hard"))
    place = F.struct(*[F.col(c) for c in [order, *([tie] if tie else [])]])
    per = small_side(d.groupBy(F.col(part).alias("_of")).agg(F.sum("w").alias("demand"), F.min(place).alias("_head")))
    d = d.join(per, F.col(part).eqNullSafe(F.col("_of")))
    return d.withColumn("share", _share(b, place.eqNullSafe(F.col("_head")), floor)).drop("_of", "_head")


def _share(b: Column, first: Column, floor: float) -> Column:
    return (F.when(b <= 0, F.lit(0.0))
            .when(b > F.col("demand"), F.col("w") + F.when(first, b - F.col("demand")).otherwise(F.lit(0.0)))
            .otherwise(F.greatest(F.lit(float(floor)), b * F.col("w") / F.col("demand")))).cast("double")


def allocate_budget(df: DataFrame, budget: float | str, w_easy: float = W_EASY, w_hard: float = W_HARD,
                    floor: float = 1.0, part: str = "bucket", order: str = "pos", tie: str | None = None) -> DataFrame:
    """The shares of ``fair_shares`` with ``remaining`` = work left from this subtree on
    (suffix sum, W2); any (order, tie) may repeat, then one row comes first."""
    b = F.col(budget) if isinstance(budget, str) else F.lit(float(budget))
    d = df.withColumn("w", F.lit(w_easy) * F.col("n_easy") + F.lit(w_hard) * F.col("n_hard"))
    d = running_agg(d, part, order, "w", "sum", tie=tie, out="_upto", first="_first")
    per = small_side(d.groupBy(F.col(part).alias("_of")).agg(F.sum("w").alias("demand")))
    d = d.join(per, F.col(part).eqNullSafe(F.col("_of"))).withColumn("remaining", F.col("demand") - F.col("_upto") + F.col("w"))
    return d.withColumn("share", _share(b, F.col("_first"), floor)).drop("_first", "_upto", "_of")


def node_cost(w_easy: float = W_EASY, w_hard: float = W_HARD) -> Column:
    """What expanding a node takes from a share."""
    return F.when(F.col("is_easy"), F.lit(float(w_easy))).otherwise(F.lit(float(w_hard)))


def select_by_share(nodes: DataFrame, shares: DataFrame, order: str = "bound", tie: tuple[str, ...] = ("problem_id", "node_id"),
                    depth_first: bool = False, w_easy: float = W_EASY, w_hard: float = W_HARD,
                    key: tuple[str, ...] = ("problem_id", "subtree_id")) -> DataFrame:
    """The first nodes of every subtree that its share pays for (W4 with a k per group).

    Nodes are taken best-first by ``order`` ascending, or deepest first, while
    their costs sum up to the subtree's ``share`` at most.  No subtree takes more
    than the greatest share pays for: Spark limits each task to so many rows
    per subtree before the shuffle, so a huge subtree never meets in one task.
    """
    least = float(min(w_easy, w_hard))
    most = int((shares.agg(F.max("share")).first()[0] or 0.0) // least)
    ords = [F.col("depth").desc() if depth_first else F.col(order).asc(), *[F.col(t).asc() for t in tie]]
    w = Window.partitionBy(*key).orderBy(*ords)
    j = nodes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    j = j.withColumn("_spent", F.sum(node_cost(w_easy, w_hard)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    paid = shares.select(*[F.col(k).alias(f"_s_{k}") for k in key], F.col("share").alias("_share"))
    on = [F.col(k) == F.col(f"_s_{k}") for k in key]
    return j.join(paid, on).where(F.col("_spent") <= F.col("_share")).drop("_r", "_spent", "_share", *[f"_s_{k}" for k in key])


def select_nodes(df: DataFrame, k: int, part: str = "bucket", order: str = "bound", tie: str | tuple[str, ...] = ("problem_id", "node_id"),
                 depth_first: bool = False) -> DataFrame:
    """Top-k rows per ``part`` (W4): best-first by ``order`` ascending, or
    depth-first (deepest first), ties by ``tie``.  Spark limits each task to k
    rows per part before the shuffle (a rank filter on a window), so a hot part's
    last task reads k rows from each task, not the part."""
    ords = [F.col("depth").desc() if depth_first else F.col(order).asc(), *[F.col(t).asc() for t in _key(tie)]]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(part).orderBy(*ords))).where(F.col("_r") <= k).drop("_r")


# ------------------------------------------------------------------------- W8
def makes_donations(moves: DataFrame) -> DataFrame:
    """Sources that give at least one node (``src``)."""
    return moves.where(F.col("n") > 0).select("src").distinct()


def add_donation(moves: DataFrame, src: int, dst: int, n: int) -> DataFrame:
    """Set the count of one (src, dst) pair, replacing any previous count."""
    one = moves.sparkSession.createDataFrame([(src, dst, n)], "src int, dst int, n bigint")
    return moves.join(one.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(one)


def donation(moves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Count for each requested (src, dst) pair, 0 when the plan has none."""
    return pairs.join(moves, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def receivers(moves: DataFrame, src: int) -> DataFrame:
    """Destinations (and counts) of one source."""
    return moves.where((F.col("src") == src) & (F.col("n") > 0)).select("dst", "n")
