"""Quality rules.

Base counts of each text, and a verdict by hashed n-grams: the log-likelihood ratio of a text's words and word pairs
between a trusted target and the raw corpus, divided by their number. Both multinomials are counted over all documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, cut, mix, ngram_hashes, slices

BINS = 1 << 14
SMOOTH = 1.0
#: Mean log ratio below which a document is turned down: its n-grams are e**-0.15 times as likely in trusted text.
THRESHOLD = -0.15
BROADCAST_IDS = 2_000_000
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEADS = (np.arange(256) & 0xC0) != 0x80
_LEADS[[0x20, *range(0x09, 0x0E)]] = False


def _per_text(words: Words, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-grams that lie in one text, and the text of each."""
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    inside = np.flatnonzero(text[: len(grams)] == text[n - 1 :]) if len(grams) else np.empty(0, dtype=np.int64)
    return inside, text[inside]


def gram_bins(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of every word and word pair."""
    h = words.hashes()
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    pairs = ngram_hashes(h, 2)
    at, text2 = _per_text(words, pairs, 2)
    both = np.concatenate([mix(h), mix(pairs[at] + np.uint64(1))])
    return np.concatenate([text, text2]), (both % np.uint64(BINS)).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, trusted) -> (bin, raw, target): one row for each bin and task."""
    raw, target = np.zeros(BINS, dtype=np.int64), np.zeros(BINS, dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            trusted = np.array(part.column(1).to_pylist(), dtype=bool)
            text, bins = gram_bins(Words(as_bytes(part.column(0))))
            raw += np.bincount(bins, minlength=BINS)
            target += np.bincount(bins[trusted[text]], minlength=BINS)
    held = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(raw[held]), pa.array(target[held])], names=["bin", "raw", "target"])


def log_ratios(docs: DataFrame) -> np.ndarray:
    """ln(p_target / p_raw) of each bin, from (text, trusted). What reaches the driver has BINS rows at any size.

    Without trusted text both multinomials are taken as equal.
    """
    counts = docs.mapInArrow(_gather, "bin int, raw long, target long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BINS), np.zeros(BINS)
    for r in counts.collect():
        raw[r["bin"]], target[r["bin"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BINS)
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * BINS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BINS))


def repeated_words(windows: np.ndarray, n: int) -> int:
    """How many of n words lie in a window (WINDOW words, given by hashes) that occurs twice or more."""
    if len(windows) < 2:
        return 0
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    if not len(again):
        return 0
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes | None], ratios: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(texts)
    n = words.counts()
    windows = ngram_hashes(words.hashes(), WINDOW)
    first = words.first.tolist()
    repeats = np.array([repeated_words(windows[a : max(a, b - WINDOW + 1)], b - a) for a, b in zip(first[:-1], first[1:], strict=True)], dtype=np.int64)
    text, bins = gram_bins(words)
    total = np.bincount(text, weights=ratios[bins], minlength=len(texts))
    grams = np.bincount(text, minlength=len(texts))
    return {
        "n_words": n.astype(np.int64),
        "word_chars": words.sums(_LEADS[words.data]),
        "n_symbols": words.sums(_SYMBOL[words.data]),
        "n_dup_lines": np.array([repeated_lines(t) if t else 0 for t in texts], dtype=np.int64),
        "n_repeat_words": repeats,
        "llr": total / np.maximum(grams, 1),
    }


def _measured(batches: Iterator[pa.RecordBatch], ratios: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            m = measure(as_bytes(part.column(1)), ratios)
            failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
            m |= {"base_failed": failed, "kept": ~failed & (m["llr"] >= threshold)}
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, m.values())], names=["doc_id", *m])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, llr, base_failed and kept for every row of docs; trusted: the ids of the trusted target.

    Null and empty texts have zeros everywhere, llr 0, and fail the base rules. A null id is never trusted; ids that
    trusted repeats count once; repeated rows of docs count as often as they stand there. An empty table gives an empty
    table. The verdict is a fixed threshold on a text's own llr, so a rerun decides alike.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = cut(trusted.select(F.col(trusted.columns[0]).cast("long").alias("__id")).distinct())
    # Sent to every task while it is small enough, so that texts stay where they are; else both sides are dealt by id.
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = source.join(ids, F.col("doc_id") == F.col("__id"), "left").select("text", F.col("__id").isNotNull().alias("trusted"))
    ratios = log_ratios(marked)
    return source.mapInArrow(functools.partial(_measured, ratios=ratios, threshold=threshold), SCHEMA)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The rules over all documents; documents labelled as good and not toxic are the trusted target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return quality_rules(docs, good)
