"""Projection of alignments to two sub-genomes onto universal columns, scoring, and the choice of a genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fourfold.functions import codec

from .numbering import numbered
from .targets import cigar_blocks

#: Positions of a genome whose columns are packed together.
STRETCH = 64


def universal_columns(pairs: DataFrame) -> DataFrame:
    """target, col, base_a, base_b, symbol, pos_a, pos_b of each column of two aligned sequences.

    pairs: target, seq_a, seq_b (equal length, `-` for a gap), first_a, first_b (coordinate of the first base), step_b
    (1, or -1 where B runs backwards). Symbol: I where A has a gap, J where B has one, else M.
    """
    # Dealt by target before they are spread, so that no single column is.
    rows = pairs.repartition("target").select("target", "first_a", "first_b", "step_b", F.posexplode(F.arrays_zip(F.split("seq_a", "").alias("a"), F.split("seq_b", "").alias("b"))).alias("col", "x"))
    rows = rows.select("*", F.upper("x.a").alias("base_a"), F.upper("x.b").alias("base_b"))
    gap_a, gap_b = F.col("base_a") == "-", F.col("base_b") == "-"
    order = W.partitionBy("target").orderBy("col")
    id_a, id_b = (F.sum((~g).cast("long")).over(order) - 1 for g in (gap_a, gap_b))
    return rows.select(
        "target", F.col("col").cast("long").alias("col"), "base_a", "base_b", F.when(gap_a, "I").when(gap_b, "J").otherwise("M").alias("symbol"),
        F.when(~gap_a, F.col("first_a") + id_a).alias("pos_a"), F.when(~gap_b, F.col("first_b") + F.col("step_b") * id_b).alias("pos_b"))


def project(reads: DataFrame, columns: DataFrame, reverse: Column) -> DataFrame:
    """One row for each universal column that a read covers: target, line, col, symbol, ref_base, read_idx, qua, nuc.

    reads: target, line, pos, ops, seq, qual; columns: target, col, symbol, pos, base of this genome; reverse: whether the
    genome runs backwards, its bases are then complemented. Covered are the columns from that of the alignment's first
    base inside the region to that of its last, gaps between them included; reads wholly outside have no rows. read_idx,
    qua and nuc are null at gaps and deletions.

    Columns are packed by stretches of the genome and meet the read's blocks there, so only blocks and packed columns are
    dealt, never single bases; a gap lies in a stretch by the base next to it.
    """
    along, back = W.partitionBy("target").orderBy("col"), W.partitionBy("target").orderBy(F.desc("col"))
    beside = [F.last("pos", ignorenulls=True).over(w) for w in (along, back)]
    placed = columns.select("target", "col", "symbol", F.col("base").alias("ref_base"), beside[0].alias("_a"), beside[1].alias("_b")).filter("_a is not null and _b is not null")
    cell = F.struct(F.least("_a", "_b").alias("lo"), F.greatest("_a", "_b").alias("hi"), "col", "symbol", "ref_base")
    cells = placed.select("target", cell.alias("c")).groupBy("target", F.floor(F.col("c.lo") / STRETCH).alias("_bin")).agg(F.collect_list("c").alias("cells"))
    seq = F.when(reverse, codec.complement(F.col("seq"))).otherwise(F.col("seq"))
    rows = reads.select("target", "line", "pos", "ops", seq.alias("seq"), "qual", (F.col("pos") + codec.reference_length(F.col("ops")) - 1).alias("to"))
    laid = cigar_blocks(rows, "ops", "pos").filter("op in ('M', '=', 'X', 'D', 'N') and len > 0").withColumn("end", F.col("ref_start") + F.col("len") - 1)
    laid = laid.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("ref_start") / STRETCH), F.floor(F.col("end") / STRETCH))))
    laid = laid.withColumn("first", F.greatest("ref_start", F.col("_bin") * STRETCH)).withColumn("last", F.least("end", F.col("_bin") * STRETCH + STRETCH - 1))
    at = F.when(~F.col("op").isin("D", "N"), F.col("read_start") + F.col("first") - F.col("ref_start")).cast("int")
    held = (F.col("last") - F.col("first") + 1).cast("int")
    parts = laid.select("target", "_bin", "line", "to", "first", "last", at.alias("at"), *[F.substr(F.col(c), at + 1, held).alias(c) for c in ("seq", "qual")])
    # What an explode makes is many times what Spark takes it for: without the hint it may be sent to every task.
    met = parts.join(cells.hint("merge"), ["target", "_bin"])
    inside = F.filter("cells", lambda c: c["lo"].between(F.col("first"), F.col("last")) & (c["hi"] <= F.col("to")))
    out = met.select("target", "line", "first", "at", "seq", "qual", F.explode(inside).alias("c"))
    here = F.when(F.col("c.lo") == F.col("c.hi"), F.col("c.lo") - F.col("first")).cast("int")
    return out.select(
        "target", "line", "c.col", "c.symbol", "c.ref_base", (F.col("at") + here).alias("read_idx"),
        codec.phred(F.substr(F.col("qual"), here + 1, F.lit(1))).alias("qua"), F.substr(F.col("seq"), here + 1, F.lit(1)).alias("nuc"))


def score(projected: DataFrame) -> DataFrame:
    """target, line, ll_aln, new_pos, aln_len, gap_in of each projected alignment."""
    ref = codec.iupac_code(F.col("ref_base"))
    read = codec.xy_code(F.col("nuc"))
    value = codec.ambiguous_log_probability(read, ref, F.col("qua"))
    gap = (F.col("ref_base") == "-") | F.col("nuc").isNull()
    sums = projected.groupBy("target", "line").agg(F.sum(F.when(~gap, value)).alias("ll"), F.count_if(gap).alias("gap_in"), F.min("col").alias("new_pos"), F.count("*").alias("aln_len"))
    total = F.coalesce("ll", F.lit(0.0)) + codec.poisson_gap_penalty(F.col("gap_in"), F.col("aln_len"))
    return sums.select("target", "line", total.alias("ll_aln"), "new_pos", "aln_len", "gap_in")


def choose(kept: DataFrame, score_a: DataFrame, score_b: DataFrame, seed: int) -> DataFrame:
    """kept (target, key columns, line_a, line_b) with genome (A or B) and read_id: the likelier alignment, a hash decides ties; reads without rows in either region go.

    Reads are numbered from 1 within a target, in the order of file A.
    """
    a = score_a.select("target", F.col("line").alias("line_a"), F.col("ll_aln").alias("ll_a"))
    b = score_b.select("target", F.col("line").alias("line_b"), F.col("ll_aln").alias("ll_b"))
    both = kept.join(a, ["target", "line_a"]).join(b, ["target", "line_b"])
    coin = F.pmod(F.xxhash64(F.lit(seed), "target", "line_a"), F.lit(2)) == 0
    genome = F.when((F.col("ll_a") > F.col("ll_b")) | ((F.col("ll_a") == F.col("ll_b")) & coin), "A").otherwise("B")
    return numbered(both.withColumn("genome", genome), "target", "line_a", "read_id")


def pileup_rows(projected: DataFrame, quality: int) -> DataFrame:
    """region, read_id, read_pos, ref_pos, qua, nuc as they are written: gaps have the last read index before them (-1 at the start), qua -1 and nuc `-`; bases under the quality keep their index."""
    order = W.partitionBy("target", "read_id").orderBy("col")
    before = F.coalesce(F.last("read_idx", ignorenulls=True).over(order), F.lit(-1))
    low = F.col("qua").isNull() | (F.col("qua") < quality)
    return projected.select(F.col("target").alias("region"), "read_id", before.cast("long").alias("read_pos"), F.col("col").alias("ref_pos"), F.when(low, -1).otherwise(F.col("qua")).alias("qua"), F.when(low, "-").otherwise(F.col("nuc")).alias("nuc"))
