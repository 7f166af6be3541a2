"""Periodic run detection with a dictionary of basic factors.

The factors of a power-of-two length are named level by level: a factor of twice
the length is the pair of its halves' names.  At each level the next occurrence of
a factor within twice its length is its successor; three occurrences in arithmetic
progression propose their step as a period.  A run of period q and four or more
periods shows at the first level of length q or more: there a factor holds a
whole period, so its next occurrence inside the run is q places on.

Proposals are extended to both sides with the same dictionary: the longest common
extension of the places t and t + q, by falling powers of two.  What several
proposals extend to is one run.

Texts are taken together up to a number of words, with a name of its own behind
each, so that no factor and no run crosses from one to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Least length of a run in words, and in periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that are looked at together, about; a longer text is looked at by itself.
WORDS_TOGETHER = 200_000

RESULT = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_TYPES = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.string())])


def _named(keys: np.ndarray, places: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of ``keys`` at ``places`` (ascending), and each place's distance to the next of its name.

    Only places with an equal one at most ``most`` away get a common name (0 or
    more) and are returned as alive; all others have a negative name of their own.
    """
    order = np.argsort(keys, kind="stable")
    at, sorted_keys = places[order], keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    gap = np.zeros(len(keys), np.int64)
    gap[:-1] = np.where(new[1:], 0, at[1:] - at[:-1])
    gap[gap > most] = 0
    alive = gap > 0
    alive[1:] |= gap[:-1] > 0
    names = -1 - np.arange(n, dtype=np.int64)
    names[at[alive]] = (np.cumsum(new) - 1)[alive]
    after = np.zeros(n, np.int64)
    after[at] = gap
    return names, after, np.sort(at[alive])


def _proposed(after: np.ndarray, alive: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the progressions of three factors, the first of each stretch."""
    step = after[alive]
    near = (step > 0) & (step <= 2 * size)
    at, q = alive[near], step[near]
    three = after[at + q] == q
    at, q = at[three], q[three]
    if not len(at):
        return at, q
    found = np.zeros(len(after), np.int64)
    found[at] = q
    first = (found[np.maximum(at - 1, 0)] != q) | (at == 0)
    first &= (found[np.maximum(at - q, 0)] != q) | (at < q)
    return at[first], q[first]


def _extension(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """Length of the longest common extension of the places a and b (a < b), to one side."""
    n, total = len(levels[0]), np.zeros(len(a), np.int64)
    top = len(levels) - 1
    for k in range(top, -1, -1):
        size, names = 1 << k, levels[k]
        while True:
            if forward:
                x, y = a + total, b + total
                inside = y + size <= n
            else:
                x, y = a - total - size, b - total - size
                inside = x >= 0
            same = inside & (names[np.where(inside, x, 0)] == names[np.where(inside, y, 1 if n > 1 else 0)])
            total[same] += size
            if k < top or not same.any():
                break
    return total


def _runs(names: np.ndarray, most: int, min_words: int, min_periods: int) -> np.ndarray:
    """Rows (start, period, length) of the runs of a sequence, in this order; periods are ``most`` at most."""
    n = len(names)
    none = np.empty((0, 3), np.int64)
    if most < 1 or n < 2:
        return none
    level, after, alive = _named(names, np.arange(n), n, most)
    levels, size, proposals = [level], 1, []
    while len(alive):
        proposals.append(_proposed(after, alive, size))
        if size >= most:
            break
        # The halves of a factor that occurs again occur again.
        alive = alive[alive + 2 * size <= n]
        alive = alive[levels[-1][alive + size] >= 0]
        if not len(alive):
            break
        keys = levels[-1][alive] * n + levels[-1][alive + size]
        level, after, alive = _named(keys, alive, n, most)
        levels.append(level)
        size *= 2
    at = np.concatenate([p[0] for p in proposals]) if proposals else np.empty(0, np.int64)
    if not len(at):
        return none
    q = np.concatenate([p[1] for p in proposals])
    start = at - _extension(levels, at, at + q, False)
    length = at + q + _extension(levels, at, at + q, True) - start
    whole = length >= np.maximum(min_words, min_periods * q)
    return np.unique(np.stack([start[whole], q[whole], length[whole]], 1), axis=0)


def find_runs(texts: list[list[bytes]], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period.

    A run is a stretch with smallest period q and at least ``min_words`` words and
    ``min_periods`` (4 or more) periods that no neighbouring word extends keeping q.
    """
    if min_periods < 4:
        raise ValueError("min_periods must be 4 or more: three factors of up to two periods each show in four")
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = pd.factorize(np.fromiter((w for t in texts for w in t), object, int(sizes.sum())))[0].astype(np.int64)
    # Behind each text stands a name that occurs nowhere else.
    ends = np.cumsum(sizes)
    names = np.insert(codes, ends, codes.max(initial=-1) + 1 + np.arange(len(texts)))
    starts = ends - sizes + np.arange(len(texts))
    found = _runs(names, int(sizes.max(initial=0)) // min_periods, min_words, min_periods)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    for i, s, q, m in zip(owner.tolist(), (found[:, 0] - starts[owner]).tolist(), found[:, 1].tolist(), found[:, 2].tolist()):
        out[i].append((s, m, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by a space."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [w for w, depth in zip(words, np.cumsum(change[:-1]).tolist()) if not depth]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
                  min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period by start, then period), collapsed.

    Words are runs of anything but ASCII white space, numbered from 0; ``collapsed``
    is the text without the words that a run holds after its first period, joined
    by a space.  ``edit(doc_id, words)`` gives the words to look at instead.  Null and
    empty texts have no runs and collapse to the empty text; a null doc_id stays
    null; equal rows are separate documents.  A text is looked at whole, in one task.
    """

    def batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = find_runs(texts, min_words, min_periods)
        runs = [[{"start": s, "length": m, "period": q} for s, m, q in mine] for mine in found]
        kept = [collapsed(words, mine) for words, mine in zip(texts, found)]
        return pa.RecordBatch.from_arrays([pa.array(ids, _TYPES.field(0).type), pa.array(runs, _TYPES.field(1).type), pa.array(kept, pa.string())], schema=_TYPES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0
        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                ids.append(doc_id)
                texts.append(words if edit is None else edit(doc_id, words))
                n += len(words)
                if n >= WORDS_TOGETHER:
                    yield batch(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield batch(ids, texts)

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(search, RESULT)
