"""Quality rules: learned decision lists over text statistics.

``with_statistics`` adds the statistics of every whole text.  ``learn`` grows
and prunes rules by sequential covering: each rule is a conjunction of
thresholds that marks bad documents; grown on two thirds of the labelled rows
by information gain, cut back on the rest, and kept only when it is precise
there.  ``verdict`` writes the ordered rules as one Spark conditional
expression, so applying them is a plain filter.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_hash, pick, with_result

SYMBOLS = "#*$%&|<>"
#: Statistics of a text; the first five are counted exactly as named.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "n_upper", "n_exclaim", "n_stutter", "n_lines")
STATISTICS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in STATISTICS])
#: Labelled rows that a list is learned from, at most (about; chosen by hash).
MAX_LABELLED = 20_000
_SPACES = " \t\n\x0b\x0c\r"
_MIX = np.random.default_rng(5).integers(1, 2**63, 5, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    wide = ids.astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for j in range(width):
        code += (wide[j:j + n] + np.uint64(1)) * _MIX[j]
        code ^= code >> np.uint64(29)
    order = np.argsort(code, kind="stable")
    same = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    if all((ids[a + j] == ids[b + j]).all() for j in range(width)):
        starts = np.zeros(n, bool)
        starts[a] = starts[b] = True
    else:  # equal codes of different windows: compare the windows themselves
        places: dict = {}
        for i in range(n):
            places.setdefault(tuple(ids[i:i + width]), []).append(i)
        starts = np.zeros(n, bool)
        for found in places.values():
            if len(found) > 1:
                starts[found] = True
    covered = np.zeros(len(words) + 1, np.int64)
    first = np.flatnonzero(starts)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics_of(text: str) -> tuple:
    """STATISTICS of one text; words are runs of anything but ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    earlier: set = set()
    dup = 0
    for line in lines:
        if line in earlier:
            dup += bool(line.strip(_SPACES))
        else:
            earlier.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count("!"),
        sum(map(operator.eq, words, words[1:])),
        len(lines),
    )


@F.pandas_udf(STATISTICS_TYPE)
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics_of(t) for t in texts], columns=STATISTICS, dtype="int64")


def with_statistics(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a struct of STATISTICS of ``text``; and that column's name.

    Null and empty texts have no words, no symbols and one (empty) line.
    """
    return with_result(docs, _statistics, "text")


# Features of a rule: a share or size that reads the same for any length of text.
FEATURES = {
    "n_words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaim_per_word": ("n_exclaim", "n_words"),
    "stutter_share": ("n_stutter", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature(stats: Column, name: str) -> Column:
    top, below = FEATURES[name]
    if below is None:
        return stats[top].cast("double")
    return stats[top].cast("double") / F.greatest(stats[below], F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold`` (above) or ``feature < threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        value = feature(stats, self.feature)
        return value >= self.threshold if self.above else value < self.threshold

    def holds(self, table: dict) -> np.ndarray:
        value = table[self.feature]
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


def _holds(rule: list, table: dict, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(table)
    return out


def _best_condition(table: dict, bad: np.ndarray, inside: np.ndarray, n_cuts: int):
    """The condition that gains most information about ``bad`` among ``inside``."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    base = np.log2(p0 / (p0 + n0))
    best, gain = None, 1e-9
    for name, values in table.items():
        mine = values[inside]
        cuts = np.unique(np.quantile(mine, np.linspace(0, 1, n_cuts + 2)[1:-1]))
        cuts = np.unique(np.concatenate([cuts, np.quantile(values[bad & inside], np.linspace(0, 1, n_cuts))]))
        order = np.argsort(mine, kind="stable")
        marks = np.concatenate([[0], np.cumsum(bad[inside][order])])
        below = np.searchsorted(mine[order], cuts, "left")
        for above, p, n in ((True, p0 - marks[below], n0 - (below - marks[below])), (False, marks[below], below - marks[below])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), -1)
            k = int(np.argmax(gains))
            if gains[k] > gain:
                best, gain = Condition(name, above, float(cuts[k])), float(gains[k])
    return best


def learn_list(table: dict, bad: np.ndarray, n_cuts: int = 64, max_conditions: int = 4, max_rules: int = 16,
               min_precision: float = 0.9) -> list:
    """Ordered rules that mark bad rows; empty if nothing precise can be learned.

    ``table`` maps a feature to its values; every third row prunes, the others grow.
    A rule's precision is (bad + 1) / (rows + 2), so one that few rows support is refused.
    """
    n = len(bad)
    pruning = np.arange(n) % 3 == 2
    open_, rules = np.ones(n, bool), []
    while len(rules) < max_rules and (bad & open_ & ~pruning).any():
        rule: list = []
        inside = open_ & ~pruning
        while len(rule) < max_conditions and (~bad & inside).any():
            condition = _best_condition(table, bad, inside, n_cuts)
            if condition is None:
                break
            rule.append(condition)
            inside &= condition.holds(table)
        # Cut back from the end, as long as that is better on the other rows.
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _holds(rule[:k], table, n) & open_ & pruning
            p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth.append(((p - q) / (p + q) if p + q else -1.0, -k))
        if not worth:
            break
        rule = rule[:-max(worth)[1]]
        hit = _holds(rule, table, n) & open_
        held = hit & pruning
        if (hit & bad).sum() + 1 < min_precision * (hit.sum() + 2) or (held & bad).sum() < min_precision * held.sum():
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list:
    """Rules learned from the documents that ``labels.quality`` marks (0 is bad).

    About ``max_labelled`` labelled ids at most are taken, by the hash of the id;
    a document with several labels counts with the lowest.  Without a labelled
    document of each kind the list is empty and keeps everything.
    """
    marks = (pick(labels, "doc_id", "quality").dropna()
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    marks = marks.filter(by_hash(F.col("doc_id"), marks.count(), max_labelled))
    # The ids are bounded by max_labelled, so they may be sent to all tasks.
    rows = pick(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id")
    rows, stats = with_statistics(rows)
    got = rows.select("doc_id", "quality", *[feature(F.col(stats), f).alias(f"f_{f}") for f in FEATURES]).toPandas()
    got = got.sort_values(list(got.columns), kind="stable", ignore_index=True)
    bad = (got["quality"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    mixed = np.random.default_rng(1).permutation(len(got))
    return learn_list({f: got[f"f_{f}"].to_numpy(float)[mixed] for f in FEATURES}, bad[mixed])


def verdict(stats: Column, rules: list) -> Column:
    """The decision list: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        holds = rule[0].column(stats)
        for c in rule[1:]:
            holds = holds & c.column(stats)
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(stats: Column) -> Column:
    """Under ten words, or over a fifth of the words in repeated windows."""
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def rate(docs: DataFrame, labels: DataFrame, rules: list | None = None) -> DataFrame:
    """One row per document: doc_id, STATISTICS, base_failed, kept, rule.

    ``rule`` is the number (from 1) of the rule that rejects, null if none does.
    """
    rules = learn(docs, labels) if rules is None else rules
    rows, name = with_statistics(pick(docs, "doc_id", "text"))
    s = F.col(name)
    number = F.coalesce(*[F.when(~verdict(s, [r]), F.lit(i + 1)) for i, r in enumerate(rules)], F.lit(None).cast("int"))
    return rows.select("doc_id", *[s[c].alias(c) for c in STATISTICS], base_failed(s).alias("base_failed"),
                       (~base_failed(s) & verdict(s, rules)).alias("kept"), number.alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that base rules and learned list keep, with all their columns."""
    rules = learn(docs, labels)
    rows, name = with_statistics(docs)
    s = F.col(f"`{name}`")
    return rows.filter(~base_failed(s) & verdict(s, rules)).drop(name)
