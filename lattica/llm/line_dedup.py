"""Line dedup by a deletion-neighbourhood join.

A line is a sequence of words; two lines are near duplicates if one word
inserted, deleted or replaced turns one into the other.  Then deleting the word
at that place from both (or from the longer) leaves the same words, so:

1. equal lines are counted once, as their earliest occurrence;
2. of the three thirds of a line, one edit leaves two alone; lines that share no
   two thirds with another go no further (so nothing is lost);
3. the others emit the hash of every one-word deletion with its place, and
   their own hash; equal hashes are joined to the earliest line of each;
4. the words of such a pair are compared, and a line with an earlier near
   duplicate goes.

Short lines are compared for equality only: one word is much of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, with_result, written

#: Lines with fewer words count as duplicates only if they are equal.
MIN_WORDS = 10
#: Bits at most of the filter of the keys that a large table is joined with (16 MB).
FILTER_BITS = 1 << 27
_NO_ID = -(1 << 63)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_THIRDS = [f"h{i}" for i in range(6)]
_LINES = f"array<struct<line:int,digest:binary,{','.join(f'{h}:bigint' for h in _THIRDS)}>>"


def normalised(line: str) -> list[bytes]:
    """The words of a line: runs of anything but ASCII white space, A-Z lower-cased."""
    return line.encode("utf-8", "surrogatepass").lower().split()


def third_keys(words: list[bytes]) -> list[int]:
    """Hashes of any two thirds, as the shorter and as the longer line of a pair.

    The thirds of a pair are those of its shorter line: what stands before the
    edit is counted from the start, what follows it from the end.
    """
    out, n = [], len(words)
    for shorter in (n, n - 1):
        first, second = shorter // 3, 2 * shorter // 3
        start, end = words[:first], words[n - (shorter - second):]
        for side, kept in (("a", words[:second]), ("z", words[n - (shorter - first):]), ("m", [*start, b"", *end])):
            out.append(xxhash.xxh3_64_intdigest(b" ".join(kept) + f" {side}{shorter}".encode()))
    return np.array(out, np.uint64).view(np.int64).tolist()


def deletions(words: list[bytes]) -> tuple[list[int], int]:
    """Hash of the words without each one, and of all words; in linear time."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)[:n]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers, dtype=np.uint64)])
        without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)
        mixed = [x ^ np.uint64(k * 0xD1B54A32D192ED03 & _MASK) for x, k in ((without, n - 1), (sums[-1:], n))]
    return mixed[0].view(np.int64).tolist(), int(mixed[1].view(np.int64)[0])


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word inserted, deleted or replaced (or nothing) turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)):] == b[same + 1:]


def _lines_of(min_words: int):
    @F.pandas_udf(_LINES)
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = []
            for number, line in enumerate(text.split("\n")):
                words = normalised(line)
                if words:
                    thirds = third_keys(words) if len(words) >= min_words else [None] * len(_THIRDS)
                    found.append((number, xxhash.xxh3_128_digest(b" ".join(words)), *thirds))
            out.append(found)
        return pd.Series(out)

    return of


def _words_of(texts: pd.Series, numbers: pd.Series) -> pd.Series:
    out = []
    for text, mine in zip(texts, numbers):
        lines = text.split("\n")
        out.append([(int(n), b" ".join(normalised(lines[n])).decode("utf-8", "surrogatepass")) for n in mine])
    return pd.Series(out)


def _variants(lines: pd.Series) -> pd.Series:
    out = []
    for line in lines:
        without, whole = deletions(line.encode("utf-8", "surrogatepass").split())
        out.append([*zip(without, range(len(without))), (whole, -1)])
    return pd.Series(out)


def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within_one(x.encode("utf-8", "surrogatepass").split(), y.encode("utf-8", "surrogatepass").split()) for x, y in zip(a, b)], dtype=bool)


def _keys(doc_id: Column, text: Column) -> dict[str, Column]:
    """A document's identity: its id (null first) and its text's hash."""
    return {"_id": F.coalesce(doc_id.cast("long"), F.lit(_NO_ID)), "_text": F.xxhash64(F.coalesce(text, F.lit("")))}


def _likely(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys (of ``_id`` and ``_text`` by default) are in ``wanted``, and a few others.

    A Bloom filter of at most ``FILTER_BITS`` bits keeps most other rows out of
    the shuffle; the join that follows is exact.
    """
    keys = keys or ("_id", "_text")
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (16 * wanted.count()).bit_length()))
    places = [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(bits)) for i in range(3)]
    words = wanted.select(F.explode(F.array(*places)).alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("mask")).toArrow()  # bits / 64 rows at most
    filled = np.zeros(bits >> 6, np.int64)
    filled[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(np.logical_and.reduce([shared.value[p.to_numpy() >> 6] >> (p.to_numpy() & 63) & 1 == 1 for p in (a, b, c)]))

    return rows.filter(held(*places))


def near_lines(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(_id, _text, line) of the lines that have an earlier line one word away.

    ``distinct``: digest, first (_id, _text, line), h0 to h5 of every distinct
    line; ``docs``: _id, _text, text.  Up to the pairs, a line goes by a 64-bit
    hash of its digest; two lines of one hash are told apart by their words.  Of
    the tables of all lines, thirds and deletions, only the rows that a join
    keeps (and a few others) are shuffled for it.
    """
    words_of = F.pandas_udf(_words_of, "array<struct<line:int,words:string>>")
    variants = F.pandas_udf(_variants, "array<struct<hash:bigint,place:int>>")
    near = F.pandas_udf(_near, "boolean")
    long = distinct.filter("h0 is not null").withColumn("id", F.xxhash64("digest"))
    keyed = long.select("id", F.explode(F.array(*_THIRDS)).alias("third"))
    shared = written(keyed.groupBy("third").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("third"), "shared_thirds")
    # Both sides of these joins are plain shuffles, which adaptive execution may
    # split where very many lines share a third or a deletion.
    some = written(_likely(keyed, shared, "third").join(shared, "third").select("id").distinct(), "lines_sharing_thirds")
    places = long.select("id", "first._id", "first._text", "first.line")
    some = written(_likely(places, some, "id").join(some, "id"), "lines_to_compare")
    wanted = some.groupBy("_id", "_text").agg(F.collect_list("line").alias("lines"))
    texts = _likely(docs, some.select("_id", "_text").distinct()).hint("shuffle_hash").join(wanted.hint("shuffle_hash"), ["_id", "_text"])
    texts = texts.select("_id", "_text", F.inline(words_of("text", "lines"))).dropDuplicates(["_id", "_text", "line"])
    lines = written(some.join(texts, ["_id", "_text", "line"])
                    .select("id", F.struct("_id", "_text", "line").alias("at"), "words"), "candidate_lines")
    emitted = written(lines.select("id", F.inline(variants("words"))), "line_deletions")
    # Hashes that several lines have; of these, the earliest line at each place.
    several = written(emitted.groupBy("hash").agg(F.min("id").alias("a"), F.max("id").alias("b"))
                      .filter("a != b").select("hash"), "shared_deletions")
    emitted = written(_likely(emitted, several, "hash").join(several, "hash").join(lines.select("id", "at"), "id"), "joined_deletions")
    earliest = emitted.groupBy("hash", "place").agg(F.min(F.struct("at", "id")).alias("e"))
    earliest = written(earliest.select("hash", "place", "e.at", "e.id"), "earliest_deletions")
    # A line meets the earliest that lacks the same place (one word replaced), ...
    first = [F.col("at").alias("at0"), F.col("id").alias("id0")]
    replaced = emitted.filter("place >= 0").join(earliest.select("hash", "place", *first), ["hash", "place"])
    # ... that is what it leaves (one deleted), ...
    deleted = emitted.filter("place >= 0").join(earliest.filter("place = -1").select("hash", *first), "hash")
    # ... and that leaves it (one inserted).
    longer = written(earliest.filter("place >= 0").groupBy("hash").agg(F.min(F.struct("at", "id")).alias("e"))
                     .select("hash", F.col("e.at").alias("at0"), F.col("e.id").alias("id0")), "longer_lines")
    inserted = emitted.filter("place = -1").join(longer, "hash")
    pairs = [p.filter("at0 < at").select("id", "id0") for p in (replaced, deleted, inserted)]
    pairs = written(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct(), "line_pairs")
    pairs = pairs.join(lines.select("id", "at", "words"), "id").join(
        lines.select(F.col("id").alias("id0"), F.col("words").alias("words0")), "id0")
    return pairs.filter(near("words", "words0")).select("at.*").distinct()


def _decided(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, _id, _text, n_lines) and what stays of them (_id, _text, kept_lines)."""
    slim = pick(docs, "doc_id", "text")
    slim = slim.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, name = with_result(slim, _lines_of(min_words), "text")
    rows = rows.select("doc_id", *[c.alias(n) for n, c in _keys(F.col("doc_id"), F.col("text")).items()], F.col(name).alias("lines"))
    rows = written(rows, "document_lines")
    lines = rows.select("_id", "_text", F.inline("lines"))
    distinct = lines.groupBy("digest").agg(F.min(F.struct("_id", "_text", "line", *_THIRDS)).alias("e"))
    distinct = written(distinct.select("digest", F.struct("e._id", "e._text", "e.line").alias("first"), *[f"e.{h}" for h in _THIRDS]), "distinct_lines")
    whole = slim.select("text", *[c.alias(n) for n, c in _keys(F.col("doc_id"), F.col("text")).items()])
    gone = written(near_lines(distinct, whole), "near_lines")
    # What goes from a document is taken from its own lines, where they are gathered.
    lines = distinct.select("first.*", F.lit(False).alias("goes")).unionByName(gone.withColumn("goes", F.lit(True)))
    first, less = F.collect_list(F.expr("if(goes, null, line)")), F.collect_list(F.expr("if(goes, line, null)"))
    kept = lines.groupBy("_id", "_text").agg(F.sort_array(F.array_except(first, less)).alias("kept_lines"))
    return rows.select("doc_id", "_id", "_text", F.size("lines").cast("long").alias("n_lines")), kept


def line_decisions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_kept, kept_lines.

    Lines are the ``\\n``-separated parts of ``text`` that have a word, numbered
    from 0 among all parts; white space and the case of A-Z do not count.  A line
    goes if an equal line, or one that differs in one word (for lines of
    ``min_words`` or more), stands before it: in a document with a smaller id
    (null first), or earlier in the same.  Rows that repeat id and text are the
    same document, and get the same lines; documents without words have none.
    """
    rows, kept = _decided(docs, min_words)
    nothing = F.array().cast("array<int>")
    out = rows.join(written(kept, "kept_lines"), ["_id", "_text"], "left").withColumn("kept_lines", F.coalesce("kept_lines", nothing))
    return out.select("doc_id", "n_lines", F.size("kept_lines").cast("long").alias("n_kept"), "kept_lines")


def _rebuilt(texts: pd.Series, kept: pd.Series) -> pd.Series:
    """The text of the kept lines and the empty ones between; null if no word is left."""
    out = []
    for text, mine in zip(texts, kept):
        mine = set() if mine is None else set(mine)
        lines = [(i in mine, line) for i, line in enumerate(text.split("\n"))]
        stays = [line for good, line in lines if good or not line.encode("utf-8", "surrogatepass").split()]
        had = len(stays) < len(lines)
        out.append(None if had and not mine else text if not had else "\n".join(stays))
    return pd.Series(out, dtype=object)


def drop_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without their duplicate lines, all other columns unchanged.

    A document that loses every line goes; one that never had a word stays.
    """
    _, kept = _decided(docs, min_words)
    columns, place = docs.columns, docs.columns.index("text")
    flat = docs.toDF(*[f"_c{i}" for i in range(len(columns))])
    keys = _keys(F.col(f"_c{columns.index('doc_id')}"), F.col(f"_c{place}"))
    flat = flat.withColumns(keys).join(written(kept, "kept_lines"), ["_id", "_text"], "left")
    rebuild = F.pandas_udf(_rebuilt, "string").asNondeterministic()  # so that the filter below doesn't run it again
    flat = flat.withColumn("_new", rebuild(F.coalesce(F.col(f"_c{place}"), F.lit("")), "kept_lines"))
    flat = flat.filter(F.col("_new").isNotNull()).withColumn("_new", F.when(F.col(f"_c{place}").isNotNull(), F.col("_new")))
    return flat.select(*[F.col("_new" if i == place else f"_c{i}").alias(f"_c{i}") for i in range(len(columns))]).toDF(*columns)
