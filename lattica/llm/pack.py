"""Best-fit packing of documents into sequences of a fixed number of tokens.

The pieces' lengths are counted in Spark; there are at most ``capacity``
different ones, so the plan is made from their counts alone, whatever the
number of documents:

1. large lengths are sorted into groups of equal cardinality and rounded up to
   the longest of their group (linear grouping);
2. the few rounded sizes are filled into sequences by a linear program over
   configurations, with new configurations priced by a knapsack, rounded down,
   and the few left over placed largest first;
3. the actual documents take the places of their group, longest first, which
   leaves room where they are shorter;
4. the small ones go, longest first, to the fullest sequence that has room.

Every large piece has its place from a configuration.  Which lengths are large
is tried (``SMALL_SHARES``); the plan with the fewest sequences counts.  All
sequences that hold the same lengths are one *run* in the plan.  Pieces get a
rank among those of equal length and look up their place by it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, with_result, written
from .tokens import json_encoder

#: Lengths over a share of the capacity are large, and sorted into so many groups; each is tried.
SMALL_SHARES = ((1 / 4, 256), (1 / 3, 512))
#: Steps of the linear program at most (a plan is valid after any step).
MAX_STEPS = 2_000


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: a knapsack over the capacity."""
    value = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for k, (size, w) in enumerate(zip(sizes, worth)):
        if w <= 0:
            continue
        for _ in range(capacity // size):
            better = value[:-size] + w > value[size:] + 1e-12
            if not better.any():
                break
            at = np.flatnonzero(better) + size
            value[at] = value[at - size] + w
            last[at] = k
    out = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= sizes[last[c]]
    return float(out @ worth), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(number of sequences, count of each size) whose sum covers the demand.

    Column generation from sequences of one size each, rounded down; what that
    leaves is filled in largest first.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    amounts = demand / np.diag(basis)
    for _ in range(MAX_STEPS):
        worth = np.linalg.solve(basis.T, np.ones(k))
        gain, column = _best_configuration(sizes, worth, capacity)
        if gain <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column.astype(float))
        amounts = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
        ratio = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    amounts = np.linalg.solve(basis, demand.astype(float))
    out = [(int(n), basis[:, i].round().astype(np.int64)) for i, n in enumerate(np.floor(amounts + 1e-9)) if n >= 1]
    left = demand - sum((n * c for n, c in out), np.zeros(k, np.int64))
    left = np.maximum(left, 0)
    while left.any():
        room, column = capacity, np.zeros(k, np.int64)
        for i in np.argsort(-sizes):
            column[i] = min(left[i], room // sizes[i])
            room -= column[i] * sizes[i]
        used = column > 0
        n = int((left[used] // column[used]).min())
        out.append((n, column))
        left = left - n * column
    return out


def fill_configurations(large: dict[int, int], capacity: int, groups: int) -> list[tuple[int, list[int]]]:
    """(number of sequences, actual lengths in each) for the large lengths.

    At most about ``groups`` groups of equal cardinality are rounded up to their longest, configurations
    of the rounded sizes are chosen, and the group's documents, longest first,
    take the places.
    """
    lengths = sorted(large, reverse=True)
    share = -(-sum(large.values()) // groups)
    queues: dict[int, list] = {}  # rounded size -> [[length, number]], longest first
    size, filled = 0, share
    for length in lengths:
        count = large[length]
        while count:
            if filled == share:
                size, filled = length, 0
            took = min(count, share - filled)
            queues.setdefault(size, []).append([length, took])
            count, filled = count - took, filled + took
    sizes = np.array(sorted(queues, reverse=True))
    demand = np.array([sum(n for _, n in queues[s]) for s in sizes.tolist()])
    out = []
    for number, column in configurations(sizes, demand, capacity):
        runs: list = [(number, [])]
        for s, times in zip(sizes.tolist(), column.tolist()):
            queue = queues[s]
            for _ in range(times):
                longer = []
                for n, held in runs:
                    while n and queue:
                        took = min(n, queue[0][1])
                        longer.append((took, [*held, queue[0][0]]))
                        n -= took
                        queue[0][1] -= took
                        if not queue[0][1]:
                            queue.pop(0)
                    if n:
                        longer.append((n, held))
                runs = longer
        out += [(n, held) for n, held in runs if held]
    return out


class Plan:
    """Where the pieces of each length go, by their rank among equal lengths."""

    def __init__(self, counts: dict[int, int], filled: list[tuple[int, list[int]]], capacity: int):
        """``counts``: number of pieces of each length, 1 to ``capacity``.

        ``filled``: sequences from the configurations; all pieces that are in
        none of them are best-fitted.
        """
        self.capacity, self.n_sequences = capacity, 0
        self._rooms: dict[int, list] = defaultdict(list)  # room -> [(first sequence, number)]
        self._placed: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        self._next = dict.fromkeys(counts, 0)
        left = dict(counts)
        for number, held in filled:
            fill = 0
            for length in held:
                self._put(length, self.n_sequences, number, fill)
                left[length] -= number
                fill += length
            self._rooms[capacity - fill].append((self.n_sequences, number))
            self.n_sequences += number
        self._best_fit(left)
        self._placed.sort()
        table = np.array(self._placed, np.int64).reshape(-1, 4)
        self.lengths, self.ranks, self.sequences, self.offsets = table.T
        # The placements of a length lie together, ordered by their first rank.
        self._first = np.searchsorted(self.lengths, np.arange(capacity + 2))
        del self._placed, self._rooms, self._next

    def _put(self, length: int, sequence: int, number: int, offset: int) -> None:
        self._placed.append((length, self._next[length], sequence, offset))
        self._next[length] += number

    def _best_fit(self, rest: dict[int, int]) -> None:
        full = np.zeros(self.capacity + 1, bool)  # rooms that some sequence has
        for room, runs in self._rooms.items():
            full[room] = bool(runs)
        for length in sorted(rest, reverse=True):
            left = rest[length]
            while left:
                room = length + int(np.argmax(full[length:]))
                if not full[room]:  # no sequence has room: open as many as these need
                    each = self.capacity // length
                    new = max(1, left // each)
                    self._rooms[self.capacity].append((self.n_sequences, new))
                    self.n_sequences += new
                    full[self.capacity] = True
                    continue
                runs = self._rooms[room]
                first, n = runs.pop()
                # A sequence stays the fullest that has room until it has none.
                times = min(room // length, left)
                took = min(n, left // times)
                for i in range(times):
                    self._put(length, first, took, self.capacity - room + i * length)
                left -= took * times
                if took < n:
                    runs.append((first + took, n - took))
                full[room] = bool(runs)
                after = room - times * length
                self._rooms[after].append((first, took))
                full[after] = True

    @classmethod
    def fewest(cls, counts: dict[int, int], capacity: int) -> Plan:
        """The plan with the fewest sequences over SMALL_SHARES."""
        plans = []
        for share, groups in SMALL_SHARES:
            large = {n: c for n, c in counts.items() if c and n > capacity * share}
            plans.append(cls(counts, fill_configurations(large, capacity, groups) if large else [], capacity))
        return min(plans, key=lambda p: p.n_sequences)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by length and rank among equal lengths."""
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            mine = length == n
            lo, hi = self._first[n], self._first[n + 1]
            at[mine] = lo + np.searchsorted(self.ranks[lo:hi], rank[mine], "right") - 1
        return self.sequences[at] + rank - self.ranks[at], self.offsets[at]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``.

    Documents over ``capacity`` ids are cut there; a null or empty text is the
    end id alone.  Ids come from the vocabulary file ``tokenizer``.
    """
    end = np.array([end_id], "<u4").tobytes()

    @F.pandas_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for ids in json_encoder(tokenizer).encode_batch(texts.tolist()):
            ids += end
            parts = [ids[i:i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]
            out.append([(i, i * capacity, len(p) // 4, zlib.crc32(p)) for i, p in enumerate(parts)])
        return pd.Series(out)

    rows, name = with_result(pick(docs, "doc_id", "text"), cut.asNondeterministic(), "text")
    return rows.select("doc_id", F.inline(F.col(name)))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (doc_id, piece, length 1 to ``capacity``, ...) with sequence_id and offset.

    ``pieces`` must be a written table: it is read for the counts and again for
    the places.  Equal rows are separate pieces.
    """
    spark = pieces.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Pieces of one length (copies, full pieces) are dealt over buckets, ranked
    # there, and numbered on by the buckets before.
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).cast("int"))
    in_bucket = written(pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "pack_counts")
    # At most ``capacity`` rows reach the driver.
    counts = {r["length"]: r["n"] for r in in_bucket.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan.fewest(counts, capacity))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = in_bucket.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (pieces.withColumn("_row", F.row_number().over(within) - 1).join(in_bucket, ["length", "_bucket"])
              .withColumn("_rank", F.col("_before") + F.col("_row")))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.value.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = ranked.withColumn("_place", place("length", "_rank"))
    kept = [c for c in pieces.columns if c != "_bucket"]
    return ranked.select(*kept, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut_pieces(docs, tokenizer, capacity, end_id), "pack_pieces")
    return pack(pieces, capacity)
