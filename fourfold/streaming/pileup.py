"""Pileup counts kept up to date while pileup files arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fourfold.functions import codec
from fourfold.sources.pileup import SCHEMA


def arriving_bases(spark: SparkSession, folder: str, region: int = 0) -> DataFrame:
    """A stream of the bases in pileup files of a folder; deletions and insertions are left out."""
    rows = spark.readStream.schema(SCHEMA).option("sep", " ").csv(folder).filter("qua <> -1 and ref_pos <> -1")
    return rows.select(F.lit(region).cast("long").alias("region"), "read_id", "read_pos", "ref_pos", F.col("qua").cast("long").alias("qua"), codec.xy_code(F.col("nuc")).cast("long").alias("nuc")).filter("nuc is not null")


def keep_counts(bases: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Counts of each nucleotide at each site in a table in memory, for what has arrived; state is one row for each count."""
    counts = bases.groupBy("region", "ref_pos", "nuc").agg(F.count("*").alias("n"), F.sum("qua").alias("sum_qua"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
