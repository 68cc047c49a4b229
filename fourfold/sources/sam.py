"""SAM: scan, and filters with their reasons."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.functions import codec
from fourfold.plans.options import Options

from .text import numbered_lines, require

UNMAPPED, REVERSE = 0x4, 0x10
#: References that a header may have for it to be sent to every task.
HEADER_LINES = 1_000_000


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """rname, length of the @SQ lines, in file order; an error if there are none."""
    lines = numbered_lines(spark, path).filter("value like '@SQ%'")
    out = lines.select("line", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("rname"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    return require(out, f"no @SQ line in {path}")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """line, name, flag, rname, pos (from 1), cigar, ops, seq, qual of each record.

    Lines with fewer than six fields are no records; seq and qual may be missing. The first ten fields are parsed only.
    """
    return parse_records(numbered_lines(spark, path))


def parse_records(lines: DataFrame) -> DataFrame:
    """The records among lines of SAM (line, value), as read_sam gives them."""
    rows = lines.filter("value not like '@%'").withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 6)
    get = lambda k: F.get("f", F.lit(k))
    star = lambda c: F.when(c != "*", c)
    out = rows.select("line", get(0).alias("name"), get(1).cast("int").alias("flag"), get(2).alias("rname"), get(3).cast("long").alias("pos"), get(5).alias("cigar"), star(get(9)).alias("seq"), star(get(10)).alias("qual"))
    return out.withColumn("ops", codec.parse_cigar(F.col("cigar")))


def write_sam(records: DataFrame, header: DataFrame, path: str) -> None:
    """records (name, flag, rname, pos, cigar, seq, qual) as SAM, a file for each partition, each with all of the header (rname, length).

    The header goes to every task: one line for each reference, an error beyond HEADER_LINES.
    """
    names = header.select("rname", "length").orderBy("rname").limit(HEADER_LINES + 1).collect()
    if len(names) > HEADER_LINES:
        raise ValueError(f"more than {HEADER_LINES} references")
    head = ["@HD\tVN:1.6", *[f"@SQ\tSN:{r['rname']}\tLN:{r['length']}" for r in names]]
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    lines = records.select(F.concat_ws("\t", star("name"), star("flag"), star("rname"), F.coalesce("pos", F.lit(0)).cast("string"), F.lit("255"), star("cigar"), F.lit("*"), F.lit("0"), F.lit("0"), star("seq"), star("qual")).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], names=["value"])

    lines.mapInArrow(run, "value string").write.text(path)


def reasons(rows: DataFrame, o: Options) -> DataFrame:
    """rows with reason: why a record is left out, the first that holds; null if it stays."""
    checks = []
    if o.drop_unmapped:
        checks.append(("unmapped", F.col("flag").bitwiseAND(UNMAPPED) != 0))
    if o.drop_secondary:
        checks.append(("secondary", F.col("flag").bitwiseAND(o.secondary_flag) != 0))
    if o.drop_soft_clipped is not None:
        checks.append(("clipped", codec.longest(F.col("ops"), "SH") >= o.drop_soft_clipped))
    if o.drop_indel is not None:
        checks.append(("indel", codec.longest(F.col("ops"), "ID") >= o.drop_indel))
    length = codec.query_length(F.col("ops"))
    if o.min_length is not None:
        checks.append(("short", length < o.min_length))
    if o.max_length is not None:
        checks.append(("long", length > o.max_length))
    if o.max_eerr is not None:
        checks.append(("errors", codec.expected_errors(F.col("qual")) > o.max_eerr))
    found = F.coalesce(*[F.when(c, F.lit(n)) for n, c in checks]) if checks else F.lit(None).cast("string")
    return rows.withColumn("reason", found)


def report(rows: DataFrame) -> DataFrame:
    """How many records each reason leaves out."""
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def base_table(rows: DataFrame) -> DataFrame:
    """A record's aligned bases: line, read_pos (hard clips count), ref_pos (from 0), qua, nuc; deletions have read_pos and qua -1 and nuc `-`, insertions ref_pos -1."""
    from fourfold.operators.targets import cigar_blocks

    hard = F.when(F.get("ops", F.lit(0))["op"] == "H", F.get("ops", F.lit(0))["len"]).otherwise(0)
    laid = cigar_blocks(rows.withColumn("hard", hard), "ops", "pos").filter("op in ('M', '=', 'X', 'I', 'D', 'N')")
    each = laid.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i"))
    gone = F.col("op").isin("D", "N")
    at = F.col("read_start") + F.col("i")
    return each.select(
        "line", F.when(gone, -1).otherwise(at + F.col("hard")).alias("read_pos"),
        F.when(F.col("op") == "I", F.lit(-1)).otherwise(F.col("ref_start") + F.col("i") - 1).cast("long").alias("ref_pos"),
        F.when(gone, -1).otherwise(F.ascii(F.substr(F.col("qual"), at + 1, F.lit(1))) - 33).alias("qua"),
        F.when(gone, "-").otherwise(F.substr(F.col("seq"), at + 1, F.lit(1))).alias("nuc"))
