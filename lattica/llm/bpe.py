"""Byte-level BPE encoding and decoding from a file of ranks.

Each match of the split pattern is merged separately.  The candidates for a
merge wait in a queue with one bucket of list positions per rank; a bitmap of
three levels marks the ranks whose bucket holds something, so the next rank is
three find-first-set steps away however long the pre-token is.  Entries whose
pair has changed meanwhile are skipped when they come up.

Many short pre-tokens go through one queue together, as lists that never meet:
a rank's whole bucket is then merged at once with numpy.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, with_result
from .tokens import ChunkEncoder, cut_before_words


class RankQueue:
    """Positions by rank; ``pop`` gives the leftmost position of the lowest rank.

    Bit i of ``low[r >> 6]`` stands for rank r, of ``mid`` for a word of ``low``,
    of ``top`` for a word of ``mid``.
    """

    def __init__(self, n_ranks: int):
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            heapq.heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[b] &= ~(1 << (rank & 63))
            if not self.low[b]:
                self.mid[a] &= ~(1 << (b & 63))
                if not self.mid[a]:
                    self.top &= ~(1 << a)
        return rank, position

    def pop_rank(self) -> tuple[int, list[int]]:
        """The lowest rank with its whole bucket, in any order."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        first = word & -word
        rank = b << 6 | first.bit_length() - 1
        self.low[b] = word ^ first
        if word == first:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return rank, self.buckets.pop(rank)


#: Bytes of pre-tokens that go through one queue together, and how many pre-tokens make that worth while.
TOGETHER, LEAST = 1_000_000, 3_000
#: Longer pre-tokens go alone.
SHORT = 64


class Bpe:
    """Encoder and decoder of a rank file; single bytes must have ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self._split = regex.compile(pattern).findall
        n = max(ranks.values()) + 1
        self._queue = RankQueue(n)
        self.bytes_of = [b""] * n
        for word, rank in ranks.items():
            self.bytes_of[rank] = word
        self.names = [str(i) for i in range(n)]
        self._chunks = ChunkEncoder(cut_before_words, self._many, " ")
        self._merged = functools.lru_cache(200_000)(self.merge)

    @functools.cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys ``a * (n + 1) + b`` of token pairs, and the rank of what they make; n stands for no token."""
        n, found = len(self.bytes_of), {}
        for word, rank in self.ranks.items():
            for k in range(1, len(word)):
                a, b = self.ranks.get(word[:k]), self.ranks.get(word[k:])
                if a is not None and b is not None:
                    found[a * (n + 1) + b] = rank
        keys = np.fromiter([*found, n * (n + 2) + 1], np.int64)  # the last is above all
        ranks = np.fromiter([*found.values(), -1], np.int64)
        order = np.argsort(keys)
        return keys[order], ranks[order]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rank next, the leftmost first."""
        ranks, queue, n = self.ranks, self._queue, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        after = list(range(1, n + 2))  # start of the token after the one at i; n ends the list
        before = list(range(-1, n))
        pair: list = [None] * n  # rank of the pair that begins at i now
        for i in range(n - 1):
            rank = ranks.get(piece[i:i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while queue.top:
            rank, i = queue.pop()
            if pair[i] != rank:
                continue
            j = after[i]
            end = after[i] = after[j]
            pair[j] = None
            if end <= n:
                before[end] = i
            rank = ranks.get(piece[i:after[end]]) if end < n else None
            pair[i] = rank
            if rank is not None:
                queue.push(rank, i)
            left = before[i]
            if left >= 0:
                rank = ranks.get(piece[left:end])
                if pair[left] != rank:
                    pair[left] = rank
                    if rank is not None:
                        queue.push(rank, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens (little-endian unsigned 32-bit), through one queue.

        The pre-tokens stand one after another with a place for no token before
        each, so that no pair reaches over a border.  All pairs of the lowest rank
        are merged at once; where they overlap, every other one from the left.  A
        pre-token where a merge makes a pair of a lower rank is merged again by
        itself, as there the order inside a rank counts.
        """
        n, (keys, made) = len(self.bytes_of), self._pairs

        def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = left * (n + 1) + right
            at = np.searchsorted(keys, key)
            return np.where(keys[at] == key, made[at], -1)

        of_byte = np.array([self.ranks[bytes([i])] for i in range(256)] + [n])
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes + 1) - sizes - 1
        token = np.full(int(sizes.sum()) + len(pieces) + 1, n, np.int64)
        text = np.ones(len(token), bool)
        text[starts] = text[-1] = False
        token[text] = of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
        after[-1] = len(token) - 1
        pair = np.append(rank_of(token[:-1], token[1:]), -1)
        again: set[int] = set()
        queue = self._queue
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0):]
        for positions in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
            if len(positions):
                queue.push(int(pair[positions[0]]), int(positions[0]))
                queue.buckets[int(pair[positions[0]])] = positions.tolist()
        while queue.top:
            rank, bucket = queue.pop_rank()
            at = np.unique(np.array(bucket))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            second = after[at]
            meets = second[:-1] == at[1:]
            if meets.any():
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.append(False, meets), 0, place))
                alternate = (place - run) % 2 == 0
                at, second = at[alternate], second[alternate]
            end = after[second]
            beside = np.flatnonzero(end[:-1] == at[1:])  # for a moment such a token stands before the next one's unmerged first
            if len(beside):
                between = rank_of(np.full(len(beside), rank), token[end[beside]])
                lower = at[beside[(between >= 0) & (between < rank)]]
                again.update((np.searchsorted(starts, lower, "right") - 1).tolist())
            token[at], token[second], pair[second] = rank, -1, -1
            after[at], before[end] = end, at
            changed = np.concatenate([at, before[at]])
            new = pair[changed] = rank_of(token[changed], token[after[changed]])
            if ((new >= 0) & (new < rank)).any():
                again.update((np.searchsorted(starts, changed[(new >= 0) & (new < rank)], "right") - 1).tolist())
            some = new >= 0
            for r, i in zip(new[some].tolist(), changed[some].tolist()):
                if r in queue.buckets:
                    queue.buckets[r].append(i)
                else:
                    queue.push(r, i)
        here = (token >= 0) & (token < n)
        content = token[here].astype("<u4").tobytes()
        ends = np.append(np.cumsum(here)[starts], np.count_nonzero(here)) * 4
        ends = ends.tolist()
        out = [content[a:b] for a, b in zip(ends, ends[1:])]
        for i in again:
            out[i] = np.asarray(self.merge(pieces[i]), "<u4").tobytes()
        return out

    def _many(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk."""
        split = [[p.encode() for p in self._split(c)] for c in chunks]
        distinct = {p for pieces in split for p in pieces}
        short = [p for p in distinct if p not in self.ranks and len(p) <= SHORT]
        ids = {}
        if len(short) >= LEAST:
            places = np.cumsum([len(p) for p in short]) // TOGETHER
            for some in np.split(np.arange(len(short)), np.flatnonzero(np.diff(places)) + 1):
                some = [short[i] for i in some.tolist()]
                ids.update(zip(some, self.merge_many(some)))
        for p in distinct:
            if p not in ids:
                ids[p] = np.asarray((self._merged if len(p) <= SHORT else self.merge)(p), "<u4").tobytes()
        return [ids[pieces[0]] if len(pieces) == 1 else b"".join(map(ids.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self._chunks.encode(text), "<u4").tolist()

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """``encode`` of each text; what is new in many texts is merged together."""
        for ids in self._chunks.encode_all(texts, TOGETHER):
            yield np.frombuffer(ids, "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def from_file(path: str, pattern: str) -> Bpe:
    """The encoder of a file of lines "base64 rank"; one per worker."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return Bpe({base64.b64decode(word): int(rank) for word, rank in pairs}, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, ids (array<int>); a null text has none."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = from_file(ranks, pattern)
        return pd.Series(list(bpe.encode_all(texts)))

    rows, name = with_result(pick(docs, "doc_id", "text"), encode, "text")
    return rows.select("doc_id", F.col(name).alias("ids"))


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per row of (doc_id, ids): doc_id, content (binary)."""

    @F.pandas_udf("binary")
    def decode(rows: pd.Series) -> pd.Series:
        bpe = from_file(ranks, pattern)
        return pd.Series([None if ids is None else bpe.decode(ids) for ids in rows])

    rows = pick(encoded, "doc_id", "ids")
    return rows.select("doc_id", decode("ids").alias("content"))


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes every text, decodes its ids, and keeps the digests of both, so that
    neither leaves the task.
    """

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        bpe = from_file(ranks, pattern)
        out = []
        for ids in bpe.encode_all(texts):
            named = " ".join(map(bpe.names.__getitem__, ids)).encode()
            out.append((len(ids), hashlib.sha256(named).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    rows, name = with_result(pick(docs, "doc_id", "text"), digests, "text")
    return rows.select("doc_id", f"{name}.n_tokens", f"{name}.ids_sha256", f"{name}.decoded_sha256")
