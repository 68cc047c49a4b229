"""Pileup: reads' extents, coverage, counts of nucleotides at each site.

Bases are rows (region, read_id, read_pos, ref_pos, qua, nuc). A base inside a read's extent that is missing counts as
a deletion there. Every sum is grouped on keys that partial aggregation shrinks first, so a deep site is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Sites whose coverage is summed up in one task.
STRETCH = 65_536


def read_summary(bases: DataFrame) -> DataFrame:
    """Extent, number of bases and missing bases of each read."""
    out = bases.groupBy("region", "read_id").agg(
        F.count("*").alias("n_bases"), F.min("ref_pos").alias("first_pos"), F.max("ref_pos").alias("last_pos"), F.max("read_pos").alias("last_read_pos"), F.sum("qua").alias("sum_qua"))
    return out.withColumn("n_missing", F.col("last_pos") - F.col("first_pos") + 1 - F.col("n_bases"))


def steps(reads: DataFrame) -> DataFrame:
    """One row for each start position: number of reads and longest extent, numbered from 0 in each region."""
    out = reads.groupBy("region", F.col("first_pos").alias("start")).agg(F.count("*").alias("n_reads"), F.max(F.col("last_pos") - F.col("first_pos") + 1).alias("span"))
    return out.withColumn("t", F.row_number().over(W.partitionBy("region").orderBy("start")).cast("long") - 1)


def coverage(reads: DataFrame) -> DataFrame:
    """Reads over each site that any covers, from starts and ends alone: no read is spread over its sites.

    Sums run along stretches of STRETCH sites, which begin with the sum of all stretches before them, so that a long
    region is no single task.
    """
    edges = reads.select("region", F.explode(F.array(F.struct(F.col("first_pos").alias("at"), F.lit(1).alias("d")), F.struct((F.col("last_pos") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    change = edges.groupBy("region", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    change = change.withColumn("stretch", F.floor(F.col("at") / STRETCH))
    along = W.partitionBy("region").orderBy("stretch")
    before = F.coalesce(F.sum("d").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stretches = change.groupBy("region", "stretch").agg(F.sum("d").alias("d"), F.min("at").alias("first"))
    stretches = stretches.select("region", "stretch", before.alias("before"), F.lead("first").over(along).alias("after"))
    order = W.partitionBy("region", "stretch").orderBy("at")
    rows = change.join(stretches, ["region", "stretch"])
    runs = rows.select("region", "at", (F.col("before") + F.sum("d").over(order)).alias("depth"), F.coalesce(F.lead("at").over(order), "after").alias("until")).filter("until is not null and depth > 0")
    return runs.select("region", F.explode(F.sequence("at", F.col("until") - 1)).alias("ref_pos"), "depth")


def uncovered_sites(bases: DataFrame) -> DataFrame:
    """Sites between a region's first and last that have no base."""
    ends = bases.groupBy("region").agg(F.min("ref_pos").alias("lo"), F.max("ref_pos").alias("hi"))
    every = ends.select("region", F.explode(F.sequence("lo", "hi")).alias("ref_pos"))
    return every.join(bases.select("region", "ref_pos").distinct(), ["region", "ref_pos"], "left_anti")


def last_supported(bases: DataFrame, least: int = 4) -> DataFrame:
    """region, last_pos: the largest position that holds at least `least` bases."""
    held = bases.groupBy("region", "ref_pos").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return held.groupBy("region").agg(F.max("ref_pos").alias("last_pos"))


def base_counts(bases: DataFrame) -> DataFrame:
    """Bases of each nucleotide at each site."""
    return bases.groupBy("region", "ref_pos", "nuc").agg(F.count("*").alias("n"), F.sum("qua").alias("sum_qua"))


def drop_lowest_quality(bases: DataFrame, limit: int = 10) -> DataFrame:
    """Bases without those of a site's lowest quality, where that is under the limit and other bases remain.

    The lowest quality and what has it are counted first and joined back, so no site's bases come together.
    """
    levels = bases.groupBy("region", "ref_pos", "qua").agg(F.count("*").alias("n"))
    site = levels.groupBy("region", "ref_pos").agg(F.min("qua").alias("lowest"), F.sum("n").alias("total"), F.min_by("n", "qua").alias("with_lowest"))
    gone = site.filter((F.col("lowest") < limit) & (F.col("total") > F.col("with_lowest"))).select("region", "ref_pos", F.col("lowest").alias("qua"))
    return bases.join(gone, ["region", "ref_pos", "qua"], "left_anti")


def mask_low_quality(bases: DataFrame, limit: int = 12) -> DataFrame:
    """Bases under the limit are taken as missing."""
    return bases.filter(F.col("qua") >= limit)


def site_table(bases: DataFrame, quality_limit: int = 10, cut_off: float = 0.0, reads: DataFrame | None = None) -> DataFrame:
    """Counts of A, C, T, G (n0 to n3) and of missing bases (n_del) at each site, after the rules for thin sites.

    One real base: it stays alone. Two that differ: the better one stays, the later on a tie. Otherwise the lowest
    quality goes if it is under quality_limit and others remain; nucleotides under cut_off of the coverage go too.
    reads: the reads' summary, where it is at hand.
    """
    at, codes = ["region", "ref_pos"], range(4)
    # One pass over the bases: qualities under the limit are told apart, so a site has a few rows, however deep it is.
    # All sums and extremes are of plain numbers, which hash aggregation holds; no base is sorted.
    levels = bases.withColumn("low", F.when(F.col("qua") < quality_limit, F.col("qua"))).groupBy(*at, "low").agg(
        F.count("*").alias("real"), *[F.count_if(F.col("nuc") == k).alias(f"n{k}") for k in codes], F.min("qua").alias("lowest"), F.max("qua").alias("highest"),
        F.max("read_id").alias("last"), F.max_by("nuc", "read_id").alias("of_last"), F.max_by("nuc", "qua").alias("of_highest"))
    site = levels.groupBy(*at).agg(
        F.sum("real").alias("real"), *[F.sum(f"n{k}").alias(f"n{k}") for k in codes], F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.max_by("of_last", "last").alias("of_last"), F.max_by("of_highest", "highest").alias("of_highest"), *[F.min_by(f"n{k}", "low").alias(f"low{k}") for k in codes])
    # Of two bases: the later where their qualities are equal.
    site = site.withColumn("best", F.when(F.col("lowest") == F.col("highest"), F.col("of_last")).otherwise(F.col("of_highest")))
    gone = sum((F.coalesce(f"low{k}", F.lit(0)) for k in codes), F.lit(0))
    masked = F.coalesce((F.col("lowest") < quality_limit) & (F.col("real") > gone), F.lit(False))

    def of(code: int) -> Column:
        many = F.col(f"n{code}") - F.when(masked, F.col(f"low{code}")).otherwise(0)
        return F.when(F.col("real") <= 2, (F.col("best") == code).cast("long")).otherwise(many)

    site = site.select("region", "ref_pos", "real", *[of(k).alias(f"n{k}") for k in range(4)])
    deep = coverage(read_summary(bases) if reads is None else reads).select("region", "ref_pos", "depth")
    out = site.join(deep, ["region", "ref_pos"])
    out = out.withColumn("n_del", F.when(F.col("real") <= 2, F.lit(0)).otherwise(F.col("depth") - F.col("real")).cast("long"))
    if cut_off:
        for k in range(4):
            out = out.withColumn(f"n{k}", F.when(F.col(f"n{k}") >= F.col("depth") * cut_off, F.col(f"n{k}")).otherwise(0))
    return out
