"""FASTA and FASTQ: scans with their policies, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.functions import codec

from .text import numbered_lines, require


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """place (order in the file), name, seq; sequences may go over several lines. A record begins at `>` at the start of a line only."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", r"^>", "")).filter("trim(value) <> ''")
    rows = rows.select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    name = F.regexp_extract("value", r"^([^\n\r]*)", 1)
    out = rows.select("place", F.trim(name).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    return require(out, f"no record in {path}")


def read_fastq(spark: SparkSession, path: str, min_length: int | None = None, max_length: int | None = None, ambiguous: str = "keep") -> DataFrame:
    """record, name, seq, qual of four-line records.

    Records with letters that are no IUPAC code, or as many qualities as letters not, go. ambiguous: `keep`, `drop_read`,
    `drop_nuc` (with its quality), `abort`, or `switch`: where any record is ambiguous all letters are coded by IUPAC, else
    by the four nucleotides; that adds `encoding` (iupac or xy) and `codes`, the letters' numbers.
    """
    lines = numbered_lines(spark, path).withColumn("record", F.floor(F.col("line") / 4)).withColumn("k", F.col("line") % 4)
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    rows = lines.groupBy("file", "record").agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    rows = rows.filter("head like '@%' and length(seq) = length(qual)").filter(codec.is_iupac(F.col("seq")))
    rows = rows.select("record", F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), F.upper("seq").alias("seq"), "qual")
    plain = codec.is_nucleotide(F.col("seq"))
    if ambiguous == "abort":
        if not rows.filter(~plain).isEmpty():
            raise ValueError(f"ambiguous nucleotides in {path}")
    elif ambiguous == "switch":
        encoding = "xy" if rows.filter(~plain).isEmpty() else "iupac"
        rows = rows.withColumns({"encoding": F.lit(encoding), "codes": codec.letter_codes(F.col("seq"), encoding)})
    elif ambiguous == "drop_read":
        rows = rows.filter(plain)
    elif ambiguous == "drop_nuc":
        kept = F.filter(F.arrays_zip(F.split("seq", "").alias("s"), F.split("qual", "").alias("q")), lambda x: x["s"].isin("A", "C", "G", "T", "U"))
        rows = rows.withColumn("_k", kept).withColumn("seq", F.array_join(F.col("_k.s"), "")).withColumn("qual", F.array_join(F.col("_k.q"), "")).drop("_k")
    if min_length is not None:
        rows = rows.filter(F.length("seq") >= min_length)
    if max_length is not None:
        rows = rows.filter(F.length("seq") <= max_length)
    return rows


def quality_range(rows: DataFrame) -> DataFrame:
    """The smallest and largest quality of all reads, and the number of reads."""
    q = codec.qualities(F.col("qual"))
    return rows.agg(F.count("*").alias("n"), F.min(F.array_min(q)).alias("lowest"), F.max(F.array_max(q)).alias("highest"))


def write_fastq(rows: DataFrame, path: str, reverse: bool = False) -> None:
    """name, seq, qual as four-line records; reverse: complemented, backwards."""
    seq = codec.reverse_complement(F.col("seq")) if reverse else F.col("seq")
    qual = F.reverse("qual") if reverse else F.col("qual")
    rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), seq, F.lit("+"), qual).alias("value")).write.text(path)


def write_fasta(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)
