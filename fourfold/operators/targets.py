"""Alignments against target regions, and the merge of a read's alignments to both sub-genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fourfold.functions import codec

from .ranges import overlapping


def cigar_blocks(rows: DataFrame, ops: str, pos: str) -> DataFrame:
    """rows once for each CIGAR operation: op_idx, op, len, and where it starts in the genome (as pos counts) and in the read (from 0).

    Places are running sums inside the row's own array, so nothing is shuffled.
    """
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("r"), F.array().cast("array<struct<op:string,len:int,g:int,r:int>>").alias("out"))

    def step(a, o):
        put = F.struct(o["op"].alias("op"), o["len"].alias("len"), a["g"].alias("g"), a["r"].alias("r"))
        return F.struct(
            (a["g"] + F.when(F.instr(F.lit("MDN=X"), o["op"]) > 0, o["len"]).otherwise(0)).alias("g"),
            (a["r"] + F.when(F.instr(F.lit("MIS=X"), o["op"]) > 0, o["len"]).otherwise(0)).alias("r"),
            F.concat(a["out"], F.array(put)).alias("out"),
        )

    laid = F.aggregate(F.col(ops), start, step)["out"]
    out = rows.select("*", F.posexplode(laid).alias("op_idx", "_o"))
    return out.select("*", F.col("_o.op").alias("op"), F.col("_o.len").alias("len"), (F.col(pos) + F.col("_o.g")).alias("ref_start"), F.col("_o.r").alias("read_start")).drop("_o")


def reaches():
    """Whether a read [rs, re) counts as in a target [s, e): one base over the left end is enough, over the right end it is not; a target no longer than the read must lie inside it."""
    rs, re, s, e = (F.col(c) for c in ("rs", "re", "s", "e"))
    inside = ((rs >= s) & (re <= e)) | ((rs < s) & (re >= s + 1)) | ((rs + 1 < e) & (re >= e))
    return F.when(re - rs < e - s, inside).otherwise((s >= rs) & (e <= re))


def first_target(reads: DataFrame, regions: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """key and target of reads (rs, re) that reach into regions (target, s, e): the smallest target of each.

    by: columns that must be equal, such as a chromosome's name.
    """
    shared = by or []
    if not shared:
        reads, regions, shared = reads.withColumn("_all", F.lit(0)), regions.withColumn("_all", F.lit(0)), ["_all"]
    pairs = overlapping(reads, regions, shared, reaches(), ("rs", "re"), ("s", "e"))
    return pairs.groupBy(*key).agg(F.min("target").alias("target"))


def merge_files(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, n_a, n_b, kept: how often each key stands in either file; kept if once in both. One shuffle, counted before it."""
    both = a.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    out = both.groupBy(*key).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    return out.withColumn("kept", (F.col("n_a") == 1) & (F.col("n_b") == 1))


def common_extent(alignments: DataFrame, read: list[str], start: str = "start", ops: str = "ops") -> DataFrame:
    """alignments cut to what all alignments of one read cover: `start` and `ops` as they are then; reads whose alignments have nothing in common are left out.

    start: where an alignment begins, in coordinates that all alignments of a read share. A read's extent is summed up
    first and joined back.
    """
    ends = alignments.groupBy(*read).agg(F.max(start).alias("_lo"), F.min(F.col(start) + codec.reference_length(F.col(ops))).alias("_hi")).filter("_hi > _lo")
    rows = alignments.join(ends, read)
    return rows.withColumn(ops, codec.clipped(F.col(ops), F.col(start), F.col("_lo"), F.col("_hi"))).withColumn(start, F.col("_lo")).drop("_lo", "_hi")


def target_table(ref_sam: DataFrame) -> DataFrame:
    """One row for each mapped record of the SAM that aligns sub-genome B's regions to A's, in file order.

    Query and reference names are `name:start-end`, start from 0. strand_b is 1 where B runs backwards.
    """
    mapped = ref_sam.filter("(flag & 4) = 0")
    a, b = codec.split_region(F.col("rname")), codec.split_region(F.col("name"))
    return mapped.select(
        F.col("line").alias("target"), F.col("rname").alias("region_a"), F.col("name").alias("region_b"),
        a["name"].alias("name_a"), a["start"].alias("start_a"), a["end"].alias("end_a"),
        b["name"].alias("name_b"), b["start"].alias("start_b"), b["end"].alias("end_b"),
        F.shiftright(F.col("flag"), 4).bitwiseAND(1).alias("strand_b"), "pos", "ops")
