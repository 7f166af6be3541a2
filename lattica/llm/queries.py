"""Queries over the whole tables, one per operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_tree, bpe, counts, embed_dedup, langid, line_dedup, pack, periodic, prefix_trie, quality_cnn, rules, simhash, tokenfile
from .common import shared_folder


#: Vocabulary files of the queries; the operators take any path.
WORDS, RANKS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer(WORDS), capacity=4096, end_id=1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every run counts all distinct texts."""
    return counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer(WORDS), shared_folder(spark, "token_cache"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), _tokenizer(RANKS), public_tokenizers.PATTERN)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token_files")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), path, _tokenizer(BYTES), end_id=0)
    return tokenfile.read_tokens(spark, path)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(_table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))
    convs = prefix_trie.lengths(turns)
    # The first crc32(decimal id) % 4 turns are those of conversation id - id % 20 (the remainder has the sign of the id, as in SQL).
    source, n = F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return prefix_trie.prefix_trie(*prefix_trie.borrowed_turns(turns, convs, source, n, 3))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def _repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text by crc32 of the decimal doc_id repeats some words to its end."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(b"%d" % doc_id), 10)
    if rest:
        return words
    n, a = len(words), g % len(words)
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + period] * -(-(n - a) // period))[:n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_table(spark, sf_dir, "documents"), edit=_repeat_tail)
    # Greatest length first, then smallest start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    return found.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.l").alias("length"), (-F.col("b.p")).alias("period"),
                        F.expr("(1000 * b.l) div (-b.p)").alias("exponent_milli"),
                        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_token_counts, op3_byte_bpe, op4_embedding_dedup, op5_language_id, op6_token_files,
    op7_quality_classifier, op8_line_dedup, op9_simhash_dedup, op10_quality_rules, op11_prefix_trie, op12_nearest_neighbours, op13_periodic_runs)}
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, CAST(3988292384 AS BIGINT)) ELSE r // 2 END)), CAST(4294967295 AS BIGINT))"""

#: The others can't be said in SQL: they rest on vocabulary files, learned models,
#: random projections or 64-bit hashes; tests/llm compares them with brute force.
ORACLE: dict[str, str] = {"op11_prefix_trie": f"""
WITH conv AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
len AS (SELECT conv_id, max(pos) AS n FROM conv GROUP BY 1),
plan AS (SELECT c.conv_id, h, least(h, coalesce(s.n, 0)) AS m, c.n - h AS own, c.conv_id - c.conv_id % 20 AS source
  FROM (SELECT conv_id, n, {_CRC32.replace("CAST(c AS", "CAST(conv_id AS")} % 4 AS h FROM len) c LEFT JOIN len s ON s.conv_id = c.conv_id - c.conv_id % 20),
turns AS (SELECT plan.conv_id, pos AS d, role, text FROM plan JOIN conv ON conv.conv_id = source AND pos <= h
  UNION ALL SELECT conv_id, pos - h + m, role, text FROM plan JOIN conv USING (conv_id) WHERE pos > h),
steps AS (SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER
  (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM len),
prefixes AS (SELECT *, lag(path) OVER w AS parent, lead(path) OVER w IS NULL AS ends FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
nodes AS (SELECT d, path, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY 1, 2),
children AS (SELECT d - 1 AS d, parent AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1, 2),
-- Every ancestor of a node, and itself, is a prefix of its smallest member.
above AS (SELECT a.d, a.path, count(*) FILTER (WHERE c.k IS NULL) AS leaves, sum((nodes.n - 1) * nodes.words) AS saved
  FROM nodes JOIN prefixes a ON a.conv_id = nodes.conv_id AND a.d <= nodes.d LEFT JOIN children c ON c.d = nodes.d AND c.path = nodes.path GROUP BY 1, 2)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(c.k, 0) AS n_children,
  above.leaves AS n_leaves, CAST(above.saved AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN above USING (d, path) LEFT JOIN children c USING (d, path) LEFT JOIN nodes up ON up.d = nodes.d - 1 AND up.path = nodes.parent"""}
