"""Helpers that the operators share: reading tables, cutting lineage, word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters; bytes.split() splits at just these.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts of about so many bytes are worked on together inside a task.
SLICE_BYTES = 2_000_000

#: So many keys are sent to every task; more are joined.
BROADCAST_KEYS = 2_000_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir says; where that is unset in local mode, as in tests, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, read from there: cut() for many narrow rows, which it packs closely."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column_name(df: DataFrame, wanted: str) -> str:
    """A name for a helper column that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_row_keys(docs: DataFrame, doc_id: str, key: str) -> DataFrame:
    """docs with `key`: a long that no two rows share, in the order of the ids.

    A row's key is its id. Where several rows have one id the first has it for its key; the others, and rows without an
    id, get keys above all ids, in the order in which they are read. Only the rows in question are written out, so that
    their keys stay as they are; no id's rows come together in one task.
    """
    own = F.col(doc_id).cast("long")
    counts = docs.select(own.alias(key)).groupBy(key).agg(F.count("*").alias("__n"))
    again = cut(counts.filter(F.col(key).isNull() | (F.col("__n") > 1)).select(key))
    n = again.count()
    if not n:
        return docs.withColumn(key, own)
    if n <= BROADCAST_KEYS:
        again = F.broadcast(again)
    most = docs.agg(F.max(own)).first()[0] or 0
    if most >= 1 << 62:
        raise ValueError(f"{doc_id} repeats and has values of 2**62 or more")
    same = own.eqNullSafe(again[key])
    rows = cut(docs.join(again, same, "left_semi").withColumn(key, F.lit(most + 1) + F.monotonically_increasing_id()))
    first = rows.filter(F.col(doc_id).isNotNull()).groupBy(own.alias("__id")).agg(F.min(key).alias(key))
    if n <= BROADCAST_KEYS:
        first = F.broadcast(first)
    settled = rows.join(first, key, "left").withColumn(key, F.coalesce("__id", key)).select(*docs.columns, key)
    return docs.join(again, same, "left_anti").withColumn(key, own).select(*docs.columns, key).unionByName(settled)


def unit_hash(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only; any engine with md5 can repeat it."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def n_words(text: Column) -> Column:
    """Number of words of a text, by built-in functions; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text each; a longer text makes a run of its own."""
    col = batch.column(batch.schema.get_field_index(text))
    lengths = np.asarray(pc.fill_null(pc.binary_length(col.cast(pa.binary())), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD6E8FEB86659FD93
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_CODES[_SPACE] = 0
_FOLDED = _CODES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
#: Bytes that are hashed together, and powers that are kept.
RUN = 1 << 16
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to RUN of them are kept for the next call."""
    known = _powers.get(base) if n <= RUN else None
    if known is None:
        known = np.full(max(n, RUN), base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= RUN:
            _powers[base] = known
    return known[:n]


class Words:
    """The words of some texts, as positions in one array of bytes; a text that is null or empty has none."""

    def __init__(self, texts: list[bytes | None]):
        self.data = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", dtype=np.uint8)
        #: where each text begins; a line feed follows each.
        self.texts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t or b"") + 1 for t in texts], out=self.texts[1:])
        inside = ~_SPACE[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]
        #: the words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, self.texts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; fold: with A-Z as a-z."""
        sums = np.zeros(len(self.starts), dtype=np.uint64)
        codes, ahead, back = _FOLDED if fold else _CODES, powers(_BASE, RUN), powers(pow(_BASE, -1, 1 << 64), RUN)
        for at in range(0, len(self.data), RUN):
            values = codes[self.data[at : at + RUN]]
            values *= ahead[: len(values)]
            a, b = np.searchsorted(self.starts, (at, at + RUN))
            if a and self.ends[a - 1] > at:  # what is left of a word that began in an earlier run
                rest = int(values[: self.ends[a - 1] - at].sum(dtype=np.uint64)) * pow(_BASE, int(at - self.starts[a - 1]), 1 << 64)
                sums[a - 1] += np.uint64(rest & 0xFFFFFFFFFFFFFFFF)
            if b > a:
                begin = self.starts[a:b] - at
                sums[a:b] += np.add.reduceat(values, begin) * back[begin]
        return mix(sums + (self.ends - self.starts).astype(np.uint64))

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """Sum, for each text, of a number given for each byte."""
        return np.add.reduceat(marks, self.texts[:-1], dtype=np.int64) if len(self.texts) > 1 else np.empty(0, dtype=np.int64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbouring word hashes, in order."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = mix(out + words[k : len(words) - n + 1 + k] + _STEP)
    return out
