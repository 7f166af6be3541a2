"""Periodic runs against brute force, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from lattica.llm import periodic, queries  # noqa: E402


def _brute(w, least=6, periods=4):
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        t = 0
        while t + q < n:
            s = t
            while t + q < n and w[t] == w[t + q]:
                t += 1
            m = t + q - s
            if t > s and m >= max(least, periods * q):
                x = w[s:s + m]
                if not any(x[p:] == x[:-p] for p in range(1, q)):
                    out.append((s, m, q))
            t += t == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(rng, n, letters):
    w = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 4:
            a, b = sorted(rng.sample(range(n + 1), 2))
            p = 1 + (b - a) // (3 + rng.randrange(8))
            w = [w[a + (j - a) % p] if a <= j < b else w[j] for j in range(n)]
    return w


def test_runs_equal_brute_force_whatever_texts_are_taken_together():
    rng = random.Random(5)
    texts = [_words(rng, rng.randrange(120), rng.choice([1, 2, 3, 40])) for _ in range(400)]
    texts += [[b"a"] * 700, [b"a", b"b"] * 300 + [b"a"], [b"x", b"y", b"z"] * 4, [b"x", b"y", b"z"] * 4 + [b"x"], [], [b"x"]]
    # Copies at equal distances propose periods across texts, which are none.
    texts += [[b"p", b"q", b"r"]] * 40
    want = [_brute(w) for w in texts]
    assert periodic.find_runs(texts) == want and sum(map(len, want)) > 300
    assert [periodic.find_runs([w])[0] for w in texts] == want
    assert periodic.find_runs([]) == [] and periodic.find_runs([[], []]) == [[], []]
    three = [w for w in texts if len(w) < 60]
    assert periodic.find_runs(three, 3, 5) == [_brute(w, 3, 5) for w in three]
    with pytest.raises(ValueError):
        periodic.find_runs(texts, 6, 3)


def test_a_long_text_with_long_periods():
    rng = random.Random(6)
    block = [b"%d" % rng.randrange(5000) for _ in range(9_000)]
    text = [b"%d" % rng.randrange(5000) for _ in range(300_000)] + block * 5 + block[:100] + [b"end"] + [b"w"] * 40_000
    assert periodic.find_runs([text]) == [[(300_000, 45_100, 9_000), (345_101, 40_000, 1)]]


def _plain(doc_id, text):
    """The query's contract, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _brute(w)
    inside = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in inside)))


def test_query_equals_its_contract_on_awkward_rows(spark, tmp_path):
    rng = random.Random(7)
    text = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    rows = [(i, text(rng.randrange(150), rng.choice([2, 4, 100])), 1, "a") for i in range(200)]
    rows += [(201, None, 1, "a"), (202, "", 1, "a"), (203, " \n\t \x0b\x0c ", 1, "a"), (None, "a " * 30, 1, "a"), (None, None, 1, "a"), rows[3], rows[3],
             (3, "b " * 9, 1, "a"), (204, "a\u00a0b " * 12, 1, "a"), (205, "\u65e5 \U0001f600 " * 20, 1, "a"), (206, "x" * 50_000, 1, "a"),
             (207, text(400, 3), 1, "a"), (-8, text(90, 2), 1, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").toDF("doc_id", "text", "runs", "Doc_ID2").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((_plain(r[0], r[1]) for r in rows), key=str)
    # Texts taken together or alone, and any order of rows, give the same.
    twice = spark.createDataFrame(rows, "doc_id long, text string, runs int, x string").repartition(3)
    plain = {(r["doc_id"], str(r["runs"])) for r in periodic.periodic_runs(twice).collect()}
    assert len(plain) >= 200


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op13_periodic_runs(spark, str(tmp_path)).count() == 0


def test_query_on_the_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, folder).collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got) == sorted(_plain(r["doc_id"], r["text"]) for r in docs)


def test_a_text_of_some_megabytes(spark):
    rng = random.Random(9)
    block = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100_000))
    df = spark.createDataFrame([(1, f"{block} {block} {block} {block} tail"), (2, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic.periodic_runs(df).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 400_000, 100_000)] and got[1]["collapsed"] == f"{block} tail" and got[2]["runs"] == []
