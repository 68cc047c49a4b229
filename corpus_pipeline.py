"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing and SentencePiece encoding.

Each stage takes all that its predecessor kept. run() writes every stage's rows as Parquet in the shared folder and
reads them again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm import encoding, language, linededup, mixing, neardup
from fourfold.llm.common import shared_folder, with_row_keys

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with lang set to what the text says; null texts and texts without a letter go.

    The model is learned from the labelled rows of docs themselves, outside the held-out quarter. Where no row is
    labelled nothing can be told: texts with a letter stay, with the lang they have. Null ids, sources and repeated rows
    are kept as they are; an empty table stays empty; columns beyond those of documents go.
    """
    docs = docs.select(*COLUMNS)
    model = language.learn(docs.filter(F.coalesce(language.remainder(F.col("doc_id"), 4) != 2, F.lit(True))))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model, keep=True).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals; what had lines and has none left goes.

    Rows that repeat an id, or have none, are documents of their own; null texts stay; n_chars is counted anew.
    """
    out = linededup.dedup_lines(docs.select(*COLUMNS)).filter("n_lines = 0 or n_kept > 0")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, that with the smallest id; of rows that repeat an id, or have none, the first read.

    Texts without words are no one's duplicates and stay.
    """
    keyed = with_row_keys(docs.select(*COLUMNS), "doc_id", "row")
    gone = neardup.near_duplicates(keyed, doc_id="row").filter("not kept").select(F.col("doc_id").alias("row"))
    return keyed.join(gone, "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 3 times; a null source is a source, a null text has no words."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with their number and checksum; null and empty texts have none. Repeated rows have equal ids."""
    return encoding.encode(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", "n_pieces", "ids_crc32", "round_trip", "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_text),
]

#: Language ID, the deletion neighbourhoods, the joins by minwise tokens and the encoding can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; of the stages' files only those of the last one stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever that is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
