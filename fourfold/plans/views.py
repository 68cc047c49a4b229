"""Read-shaped views of the given tables, and the same in SQL for DuckDB.

`tetra` takes each event as a read of 100 bases; 400 neighbouring events are the reads of one region with four
haplotypes, two of them of sub-genome A (0, 1) and two of B (2, 3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tetra_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, read_id, k (its haplotype) and st (its first site); all long."""
    reads = table(spark, sf_dir, "events").select(F.col("event_id").alias("read_id"))
    return reads.selectExpr("read_id", "read_id div 400 as region", "read_id % 4 as k", "(read_id * 37) % 301 as st")


def spread(reads: DataFrame) -> DataFrame:
    """region, read_id, read_pos, ref_pos, qua, nuc, true_hap of the reads' bases, all long; other columns of reads go along."""
    more = [c for c in reads.columns if c not in ("read_id", "region", "k", "st")]
    bases = reads.select("*", F.explode(F.expr("sequence(0L, 99L)")).alias("j")).withColumn("p", F.expr("st + j"))
    bases = bases.withColumn("b0", F.expr("(p * p * 7 + p * 3 + (p * 11) % 13) % 4"))
    bases = bases.withColumn("h", F.expr("case when p % 50 = 5 and k >= 2 then (b0 + 1) % 4 when p % 50 = 25 and k = 1 then (b0 + 2) % 4 when p % 75 = 10 and k = 3 then (b0 + 3) % 4 else b0 end"))
    return bases.selectExpr("region", "read_id", "j as read_pos", "p as ref_pos", "12 + (read_id * 31 + j * 7) % 30 as qua", "case when (read_id * 131 + j * 17) % 101 = 0 then (h + 1) % 4 else h end as nuc", "k as true_hap", *more)


def tetra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, read_id, read_pos, ref_pos, qua, nuc, true_hap; all long."""
    return spread(tetra_reads(spark, sf_dir))


TETRA_SQL = """
tetra_b as (select event_id as read_id, event_id // 400 as region, event_id % 4 as k, (event_id * 37) % 301 as st, j from events, range(0, 100) t(j)),
tetra_c as (select *, st + j as p, ((st + j) * (st + j) * 7 + (st + j) * 3 + ((st + j) * 11) % 13) % 4 as b0 from tetra_b),
tetra_d as (select *, case when p % 50 = 5 and k >= 2 then (b0 + 1) % 4 when p % 50 = 25 and k = 1 then (b0 + 2) % 4 when p % 75 = 10 and k = 3 then (b0 + 3) % 4 else b0 end as h from tetra_c),
tetra as (select region, read_id, j as read_pos, p as ref_pos, 12 + (read_id * 31 + j * 7) % 30 as qua, case when (read_id * 131 + j * 17) % 101 = 0 then (h + 1) % 4 else h end as nuc, k as true_hap from tetra_d)"""
