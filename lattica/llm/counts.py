"""Token counts with a digest cache.

A text is known by the SHA-256 of its normalised content and of the vocabulary
file.  Counts of known texts come from the stored cache; every other distinct
text is encoded once, and its count is appended to the cache.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty, pick, written
from .tokens import drops_white_space, file_digest, json_encoder

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"


def _normalised(tokenizer: str):
    """Column of the content that decides a text's count.

    Runs of ASCII white space count as one space for a vocabulary that drops
    white space; for any other the text itself decides.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with open(tokenizer, encoding="utf-8") as f:
        dropped = drops_white_space(json.load(f))
    return F.regexp_replace(text, r"[ \t\n\r]+", " ") if dropped else text


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is a folder that all executors share; it grows with every call.
    Rows appended twice (by calls at the same time, or by a call that was
    repeated) are equal, and read as one.  A null text counts as empty.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    empty(spark, CACHE_SCHEMA).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version).select("digest", "n_tokens")

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = json_encoder(tokenizer).encode
        return pd.Series([len(encode(t)) // 4 for t in texts], dtype="int64")

    content = pick(docs, "doc_id", "text").select(
        "doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"),
        _normalised(tokenizer).alias("content"))
    content = content.withColumn("digest", F.unhex(F.sha2("content", 256)))
    distinct = content.groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(stored(), "digest", "left_anti")
    (misses.select(F.lit(version).alias("version"), "digest", count("content").alias("n_tokens"))
     .write.mode("append").parquet(cache))
    rows = content.select("doc_id", "n_bytes", "digest")
    # Written, so that the join may split the rows of a text that occurs very often.
    counts = written(stored().join(rows, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token_counts")
    return (rows.join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
