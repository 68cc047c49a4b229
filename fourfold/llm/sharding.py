"""Sharding by histogram sort.

Rows get a 64-bit key; the bytes below candidate keys are counted exactly, over all partitions, and the candidates
are refined until each splitter is as near its share as asked; then rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import column_name, cut

SHARDS = 40
TOLERANCE = 0.002
#: A boundary goes through a group of equal texts only where the groups' bounds are further than this share from its aim.
CUT_BEYOND = 0.01
GROUP = 1 << 24
PROBES = 24
TASK_BYTES = 256_000_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def sort_key(text: Column, doc_id: Column) -> Column:
    """Equal texts stand side by side (the upper 40 bits) and in an order by id (the lower 24), so that a boundary can go through a large group of copies."""
    upper = F.shiftleft(F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 24), 24)
    return upper.bitwiseOR(F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("id")), 40))


def _counts(probes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column(0).to_numpy(zero_copy_only=False), side="right")
            np.add.at(sums, at, b.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(rows))
        held = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(sums[held]), pa.array(rows[held])], names=["bin", "bytes", "rows"])

    return run


def histogram(keyed: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with keys below each probe. What reaches the driver has one row for each probe."""
    counted = keyed.select("key", "size").mapInArrow(_counts(probes), "bin long, bytes long, rows long")
    found = counted.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    sums, rows = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
    for r in found:
        sums[r["bin"]], rows[r["bin"]] = r["bytes"], r["rows"]
    return np.cumsum(sums)[:-1], np.cumsum(rows)[:-1]


def find_splitters(keyed: DataFrame, parts: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, int]:
    """The parts - 1 keys at which the bytes below come nearest to equal shares, rows below each, and rounds needed.

    Each round asks for the bytes below `probes` keys inside each splitter's interval, all splitters together. Only
    bounds of groups of equal texts (multiples of GROUP) are asked for first; a splitter goes on inside a group where
    the group's bounds are more than CUT_BEYOND * share, and half a row of the group, off. A splitter is done when it is within tolerance * share of
    its aim, or when no key lies strictly inside its interval; then the nearer end of the interval is taken. Keys have
    64 bits, so the rounds are bounded.
    """
    total = int(keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])
    aims = [total * (i + 1) / parts for i in range(parts - 1)]
    low, high = [(LOW, 0, 0)] * len(aims), [(HIGH, total, None)] * len(aims)
    best: list[tuple[float, int, int] | None] = [None] * len(aims)
    slack, rounds = tolerance * total / parts, 0
    open_ = list(range(len(aims))) if total else []
    while open_:
        rounds += 1
        asked = set()
        for i in open_:
            a, b = low[i][0], high[i][0]
            step = GROUP if b - a > GROUP else 1
            tried = (a + (b - a) * (j + 1) // (probes + 1) for j in range(probes))
            asked.update(k for k in (x // step * step for x in tried) if a < k < b)
            if step > 1:  # so that an interval shrinks to one group
                asked.update(k for k in (a // step * step + step, (b - 1) // step * step) if a < k < b)
        keys = np.array(sorted(asked), dtype=np.int64)
        below, rows = histogram(keyed, keys)
        still = []
        for i in open_:
            left = int(np.searchsorted(below, aims[i], side="right"))
            for j in (left - 1, left):
                if 0 <= j < len(keys):
                    off = abs(float(below[j]) - aims[i])
                    if best[i] is None or off < best[i][0]:
                        best[i] = (off, int(keys[j]), int(rows[j]))
                    point = (int(keys[j]), int(below[j]), int(rows[j]))
                    if j == left - 1 and point[0] > low[i][0]:
                        low[i] = point
                    if j == left and point[0] < high[i][0]:
                        high[i] = point
            width = high[i][0] - low[i][0]
            enough = slack
            if width <= GROUP:  # inside a group of equal texts: no nearer than half a row of it
                many = (high[i][2] or low[i][2] + 1) - low[i][2]
                enough = max(slack, CUT_BEYOND * total / parts, (high[i][1] - low[i][1]) / max(many, 1) / 2)
            if best[i][0] > enough and width > 1 and high[i][1] > low[i][1]:
                still.append(i)
        open_ = still
    if not total:
        return np.zeros(len(aims), dtype=np.int64), np.zeros(len(aims), dtype=np.int64), 0
    order = sorted(range(len(aims)), key=lambda i: best[i][1])
    return np.array([best[i][1] for i in order], dtype=np.int64), np.array([best[i][2] for i in order], dtype=np.int64), rounds


def _place(splitters: np.ndarray, base: np.ndarray, key: str, part: str, before: str):
    """Adds the range of a row's key and the number of rows that its shard holds in ranges before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(splitters, b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False), side="right")
            yield b.append_column(part, pa.array(at, pa.int32())).append_column(before, pa.array(base[at], pa.int64()))

    return run


def histogram_shards(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, tolerance: float = TOLERANCE, payload: bool = True) -> DataFrame:
    """docs (payload=False: only doc_id) with size, text_crc32, shard (int) and slot (long, gapless from 0 in a shard).

    The law is `bytes`: each shard's sum of sizes is within tolerance of an equal share, or as near as the sizes of
    single rows allow. Equal texts stand side by side and share a shard unless a boundary goes through them. Null and
    empty texts have size 16 and crc32 0. Rows that repeat both text and id can't be told apart by their key: they
    stay together, in any order among themselves. A group of equal texts is cut only where a boundary would otherwise be
    more than CUT_BEYOND of a share, and half a row, off. An empty table gives an empty table. Columns of docs that have the new names
    are replaced.
    """
    # Ranges finer than shards keep a task's share bounded at any size; a shard is a run of ranges.
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    key, part, before = (column_name(docs, c) for c in ("key", "part", "before"))
    facts = [size_of(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), sort_key(F.col(text), F.col(doc_id)).alias(key)]
    keep = docs.columns if payload else [doc_id]
    keyed = docs.select(*keep, *facts)
    # The probing rounds go over keys and sizes only, computed once.
    thin = cut(keyed.select(doc_id, "size", "text_crc32", key))
    total = int(thin.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])
    finer = max(1, -(-total // (shards * TASK_BYTES)))
    splitters, rows, _ = find_splitters(thin.select(F.col(key).alias("key"), "size"), shards * finer, tolerance)
    first = np.concatenate([[0], rows]).astype(np.int64)
    every = np.arange(shards * finer)
    base = first[every] - first[every // finer * finer]
    source = keyed if payload else thin
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields) + f", `{part}` int, `{before}` long"
    placed = source.mapInArrow(_place(splitters, base, key, part, before), schema)
    order = W.partitionBy(part).orderBy(key, F.col(doc_id).asc_nulls_last())
    out = placed.withColumn("slot", (F.col(before) + F.row_number().over(order) - 1).cast("long"))
    return out.withColumn("shard", F.floor(F.col(part) / finer).cast("int")).drop(key, part, before)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law of equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = histogram_shards(docs, payload=False)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
