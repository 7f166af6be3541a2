"""Language ID: known words by frequency, unseen words by shorter and shorter n-grams.

A text's language is the one under which its words are likeliest.  A word that
the model knows counts with its log frequency in each language.  Any other word
is scored by its character n-grams: the longest known n-gram at each place,
from four characters down to one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_hash, held, pick, remainder, with_result, written

#: Documents that the model is learned from, at most (about; chosen by hash of the id).
MAX_LEARNED = 8_000
#: A word is known if it occurs so often in those documents.
MIN_COUNT = 3
LONGEST = 4
#: Words that count in full towards the score; beyond them evidence is averaged.
FULL_WORDS = 20
#: Below this score a document's language counts as unknown in ``keep_known``.
MIN_SCORE = 0.5
UNKNOWN = "und"
#: Chunks of text (white-space runs between) whose scores a worker remembers.
_CACHE_ROWS = 400_000
_WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 4) == 2, F.lit(False))


def _counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of known words and (lang, gram, n) of n-grams, over all rows."""
    words = (rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"))).alias("word"))
             .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    words = written(words, "lang_words")
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = [
        words.select("lang", "n", F.explode(F.transform(
            F.sequence(F.lit(1), F.length(marked) - size + 1), lambda i, size=size: F.substring(marked, i, F.lit(size)))).alias("gram"))
        .filter(F.length("gram") == size)
        for size in range(1, LONGEST + 1)
    ]
    all_grams = grams[0]
    for g in grams[1:]:
        all_grams = all_grams.unionByName(g)
    all_grams = all_grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    known = words.join(words.groupBy("word").agg(F.sum("n").alias("all")).filter(F.col("all") >= MIN_COUNT), "word")
    return known.select("lang", "word", "n"), all_grams.filter(F.col("n") >= MIN_COUNT)


def _log_table(rows: pd.DataFrame, key: str, langs: list[str], totals: np.ndarray) -> dict[str, np.ndarray]:
    """key -> log frequency in every language, half a count added for unseen ones."""
    if not len(rows):
        return {}
    keys, place = np.unique(rows[key].to_numpy(object).astype(str), return_inverse=True)
    table = np.full((len(keys), len(langs)), 0.5)
    at = {lang: i for i, lang in enumerate(langs)}
    np.add.at(table, (place, rows["lang"].map(at).to_numpy()), rows["n"].to_numpy(float))
    logs = np.log(table / np.maximum(totals, 1.0))
    return dict(zip(keys.tolist(), logs.astype(np.float32)))


class Model:
    """Word and n-gram log frequencies; scores whole texts."""

    def __init__(self, langs: list[str], words: dict, grams: dict):
        self.langs, self.words, self.grams = langs, words, grams
        self._forget()

    def __getstate__(self):
        return self.langs, self.words, self.grams

    def __setstate__(self, state):
        self.__init__(*state)

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._table = np.zeros((1024, len(self.langs) + 1), np.float32)

    def unseen(self, word: str) -> np.ndarray:
        """Score of a word by its n-grams: at each place the longest that is known."""
        marked, out, n = f"^{word}$", np.zeros(len(self.langs), np.float32), 0
        for i in range(len(marked)):
            for size in range(min(LONGEST, len(marked) - i), 0, -1):
                got = self.grams.get(marked[i:i + size])
                if got is not None:
                    out = out + got
                    n += 1
                    break
        return out / max(n, 1)

    def _chunk(self, chunk: str) -> np.ndarray:
        """Sum of its words' scores, and the number of words in the last cell."""
        total = np.zeros(len(self.langs) + 1, np.float32)
        for word in _WORD.findall(chunk):
            got = self.words.get(word)
            total[:-1] += self.unseen(word) if got is None else got
            total[-1] += 1
        return total

    def _rows(self, chunks: list[str]) -> np.ndarray:
        if len(self._place) > _CACHE_ROWS:
            self._forget()
        place = self._place
        for chunk in set(chunks).difference(place):
            k = place[chunk] = len(place)
            if k == len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._table[k] = self._chunk(chunk)
        return self._table[np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))]

    def predict(self, text: str) -> tuple[str, float]:
        chunks = text.lower().split()
        total = np.zeros(len(self.langs) + 1)
        for i in range(0, len(chunks), 50_000):
            total += self._rows(chunks[i:i + 50_000]).sum(0, dtype=float)
        n = total[-1]
        if not n or not self.langs:
            return UNKNOWN, 0.0
        logs = total[:-1] * min(1.0, FULL_WORDS / n)
        odds = np.exp(logs - logs.max())
        best = int(np.argmax(odds))
        return self.langs[best], float(odds[best] / odds.sum())


def learn(docs: DataFrame, max_learned: int = MAX_LEARNED) -> Model:
    """A model of the languages that label the documents which are not held out.

    Rows without id, text or language teach nothing.  About ``max_learned``
    documents at most are read, so the model's size is bounded too.
    """
    rows = pick(docs, "doc_id", "text", "lang").dropna().filter(remainder(F.col("doc_id"), 4) != 2)
    rows = rows.filter(by_hash(F.col("doc_id"), rows.count(), max_learned))
    words, grams = (t.toPandas() for t in _counts(rows))
    langs = sorted(set(words["lang"]) | set(grams["lang"]))
    of = lambda t: t.groupby("lang")["n"].sum().reindex(langs).fillna(0).to_numpy(float)
    by_size = grams["gram"].str.len()
    table: dict = {}
    for size in range(1, LONGEST + 1):
        mine = grams[by_size == size]
        table |= _log_table(mine, "gram", langs, of(mine))
    return Model(langs, _log_table(words, "word", langs, of(words)), table)


def _predictor(spark, model: Model):
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        held("language model", object)  # lets go of what other operators kept; the model holds its own words
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter
    (Unicode category L), or nothing could be learned.
    """
    model = learn(docs) if model is None else model
    rows, name = with_result(pick(docs, "doc_id", "text"), _predictor(docs.sparkSession, model), "text")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name)["lang_pred"].alias("lang_pred"),
                       F.col(name)["score"].alias("score"))


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is told with ``min_score``, with all their columns."""
    rows, name = with_result(docs, _predictor(docs.sparkSession, learn(docs)), "text")
    return rows.filter((F.col(f"`{name}`.lang_pred") != UNKNOWN) & (F.col(f"`{name}`.score") >= min_score)).drop(name)
