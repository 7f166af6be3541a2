"""Readers for the driver's parquet tables (explicit column lists, pushdown-friendly)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of one table; Catalyst prunes columns and pushes filters."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Add a stable, unique row key without a sort or shuffle.

    ``_metadata.row_index`` is the row's position inside its parquet file and a
    hash of the file path separates files, so the key is the same on every
    recomputation (task retries, lost executors) and needs no global
    ``row_number`` (which would sort all rows in one task).  Must be applied
    directly on a DataFrame read from parquet.
    """
    key = F.concat(
        F.lpad(F.hex(F.col("_metadata.row_index")), 10, "0"),
        F.lit("@"),
        F.lpad(F.hex(F.xxhash64(F.col("_metadata.file_path"))), 16, "0"),
    )
    return df.select("*", key.alias(name))
