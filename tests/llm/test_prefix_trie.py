"""The prefix trie against a plain one, with long, hot, turnless and awkward conversations."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from lattica.llm import prefix_trie, queries  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(sequences):
    """Rows of the contract for {conv_id: [(role, text), ...]}, by walking a dict of prefixes."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + (len(members[p]) - 1) * words(p)
        if p:
            up = p[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(c for c in members[p] if len(sequences[c]) == len(p))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in members.items()]


def _sequences(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in by.items()}


def _borrowed(sequences):
    out = {}
    for c, own in sequences.items():
        h = zlib.crc32(str(c).encode()) % 4
        source = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = sequences.get(source, [])[:h] + own[h:]
    return out


def _awkward():
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(4)))
    rows = [(c, t, rng.choice(["user", "assistant"]), line()) for c in range(400) for t in range(rng.randrange(1, 7))]
    rows += [(1000 + c, t, "user", "same start") for c in range(300) for t in range(2)]  # a hot first turn
    rows += [(2000, t, "user", f"turn {t % 3}") for t in range(900)] + [(2020, t, "user", f"turn {t % 3}") for t in range(700)]  # very long ones
    rows += [(c, None, "user", "no number") for c in range(0, 60, 7)] + [(None, 0, "user", "x"), (None, None, None, None)]
    rows += [(3000, 0, None, None), (3000, 0, "", ""), (3000, 0, "ab", "c"), (3001, 0, "a", "bc"), (3020, 5, "ab", "c"), (-3, 0, "u", "n"), (-20, 1, "u", "n m")]
    rows += [(3100, 0, "u", "tie"), (3100, 0, "u", "tie"), (3100, 0, "s", "tie"), (3041, 0, "u", "x"), (3120, 0, "u", "a b　c \x0b d"), (3140, 0, "u", "w " * 50_000)]
    return rows


@pytest.mark.parametrize("walked", [1 << 15, 8])
def test_query_equals_a_plain_trie(spark, tmp_path, monkeypatch, walked):
    monkeypatch.setattr(prefix_trie.list_ranks, "__defaults__", (walked,))
    monkeypatch.setattr(prefix_trie, "BLOCK", 64 if walked == 8 else prefix_trie.BLOCK)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2 if walked == 8 else prefix_trie.ID_BITS)
    rows = _awkward() if walked > 8 else [r for r in _awkward() if r[0] is None or r[0] < 1_050]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit(1), "Conv_ID2": F.lit("x"), "depth": F.lit(3), "id": F.lit(0)}).repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in queries.op11_prefix_trie(spark, str(tmp_path)).collect()]
    want = _plain(_borrowed(_sequences(rows)))
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] == 0 and r[3] > 400 for r in got)


def test_tries_without_borrowing_and_of_nothing(spark):
    rows = [(1, 0, "u", "hello there"), (1, 1, "a", "hi"), (2, 0, "u", "hello there"), (2, 1, "a", "yes well"), (3, 0, "u", "other")]
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    # Conversation 9 has no turn: it is a member of the root only, and ends there.
    convs = prefix_trie.lengths(turns).unionByName(spark.createDataFrame([(9, 0)], "conv_id long, length long"))
    got = [tuple(r) for r in prefix_trie.prefix_trie(turns, convs).collect()]
    assert sorted(got, key=str) == sorted(_plain(_sequences(rows) | {9: []}), key=str)
    none = prefix_trie.turns_of(spark.createDataFrame([(None, 0, "u", "t")], SCHEMA))
    assert prefix_trie.prefix_trie(none, prefix_trie.lengths(none)).count() == 0


def test_list_ranks_of_a_shuffled_list(spark):
    rng = random.Random(1)
    arcs = rng.sample(range(10**9), 3_000)
    df = spark.createDataFrame(list(zip(arcs, [*arcs[1:], None])), "arc long, next long").repartition(4)
    for walked in (10_000, 200):
        got = {r["arc"]: r["rank"] for r in prefix_trie.list_ranks(df, walked).collect()}
        assert got == {a: i for i, a in enumerate(arcs)}


def test_digest_of_many_ids(spark):
    ids = list(range(5, 30_000, 3))
    df = spark.createDataFrame([(i, 2, i % 2, 0, 0, 0) for i in ids], "conv_id long, depth int, s0 long, s1 long, s2 long, s3 long").repartition(7)
    got = {r["s0"]: r["ends_sha256"] for r in prefix_trie.ends_digest(df).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in ids if i % 2 == k).encode()).hexdigest() for k in (0, 1)}
