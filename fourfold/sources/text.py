"""Numbered lines of text files, without bringing a file together in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value. Lines are counted for each split first; a split's first number is the sum of those before."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # One row for each split of the files.
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return rows.join(shift, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def require(found: DataFrame, message: str) -> DataFrame:
    if found.isEmpty():
        raise ValueError(message)
    return found
