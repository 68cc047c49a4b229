"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are put into bins; shallow trees, boosted by turns over the features, add up to one lookup table for
each feature, and then to one for each of the most telling pairs. A score is a sum of table entries.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, ngram_hashes, slices, unit_hash
from .language import remainder
from .rules import repeated_lines, repeated_words

#: Bound of the labelled rows that are learned from.
SAMPLE = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAST = 80, 30, 0.15, 1.0, 8
FEATURES = ("words", "word_length", "symbols", "digits", "capitals", "marks", "other", "repeated_lines", "repeated_words", "distinct_words", "line_length", "mean_line_words")

_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[list(b"#*$%&|<>")] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of FEATURES for each whole text; null is taken as empty."""
    if not texts:
        return np.zeros((0, len(FEATURES)))
    words = Words(texts)
    n, hashes = words.counts(), words.hashes()
    windows, first = ngram_hashes(hashes, 8), words.first.tolist()
    kinds = _CLASS[words.data]
    held = [words.sums(kinds == k) for k in range(7)]
    length = np.maximum(sum(held[1:]), 1)
    again, distinct = np.zeros(len(texts)), np.zeros(len(texts))
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        again[i] = repeated_words(windows[a : max(a, b - 7)], b - a)
        distinct[i] = len(np.unique(hashes[a:b]))
    lines = words.sums(words.data == 10)
    repeats = np.array([repeated_lines(t) if t else 0 for t in texts])
    some = np.maximum(n, 1)
    return np.stack([
        np.log1p(n), sum(held[1:]) / some, held[4] / length, held[3] / length, held[2] / length, held[5] / length, held[6] / length,
        repeats / lines, again / some, distinct / some, np.log1p(length / lines), np.log1p(n / lines),
    ], axis=1)


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.start)
        for i, t in enumerate(self.tables):
            total += t[at[:, i]]
        step = BINS // PAIR_BINS
        for (i, j), g in zip(self.pairs, self.grids, strict=True):
            total += g[at[:, i] // step, at[:, j] // step]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _leaf(g, h):
    return -g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> int:
    """Where the bins are best cut in two; 0: nowhere."""
    G, H, N = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(G, H) + _gain(g.sum() - G, h.sum() - H) - _gain(g.sum(), h.sum())
    gain[(N < LEAST) | (n.sum() - N < LEAST)] = 0
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    at = _cut(g, h, n) if depth and len(g) > 1 else 0
    if not at:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:at], h[:at], n[:at], depth - 1), _tree(g[at:], h[at:], n[at:], depth - 1)])


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """The cut of each axis whose four quarters gain most."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, ah = G[:-1, :-1], H[:-1, :-1]
    b, bh = G[:-1, -1:] - a, H[:-1, -1:] - ah
    c, ch = G[-1:, :-1] - a, H[-1:, :-1] - ah
    d, dh = G[-1, -1] - a - b - c, H[-1, -1] - ah - bh - ch
    gain = _gain(a, ah) + _gain(b, bh) + _gain(c, ch) + _gain(d, dh)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[i, j]), int(i) + 1, int(j) + 1


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting with logistic loss: features by turns first, then the pairs that promise most."""
    if not len(x):
        return Model()
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) for i in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(edges=edges, start=float(np.log(share / (1 - share))), tables=[np.zeros(BINS) for _ in edges])
    at = model.bins(x)
    counts = [np.bincount(at[:, i], minlength=BINS) for i in range(x.shape[1])]
    total = np.full(len(x), model.start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(x.shape[1]):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[:, i], g, BINS), np.bincount(at[:, i], h, BINS), counts[i])
            model.tables[i] += step
            total += step[at[:, i]]
    coarse = at // (BINS // PAIR_BINS)

    def grid(i, j, w):
        return np.bincount(coarse[:, i] * PAIR_BINS + coarse[:, j], w, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quarters(grid(*p, g), grid(*p, h))[0])
    model.pairs = ranked[:PAIRS]
    model.grids = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            G, H = grid(i, j, g), grid(i, j, h)
            _, a, b = _quarters(G, H)
            step = np.zeros_like(G)
            for rows in (slice(None, a), slice(a, None)):
                for cols in (slice(None, b), slice(b, None)):
                    step[rows, cols] = RATE * _leaf(G[rows, cols].sum(), H[rows, cols].sum())
            model.grids[k] += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(as_bytes(part.column(2)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["u", "y", "x"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, y: 0 or 1), all of which may be learned from.

    Labels are drawn by a hash of doc_id, about `sample` of them at most; only their documents are looked at. An id that
    labels repeat has its smallest label; of documents that repeat ids so often that more than twice the sample is
    found, those that come first by hash and features are taken.
    """
    labels = labels.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    n = labels.count()
    drawn = labels.withColumn("u", unit_hash("quality", F.col("doc_id"))).filter(F.col("u") < (sample / n if n else 0.0))
    # The sample's bound holds for what is sent to the tasks, and for what comes back.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("u", F.col("y").cast("int").alias("y"), "text")
    found = rows.mapInArrow(_features, "u double, y int, x array<double>").orderBy("u", F.xxhash64("x")).limit(2 * sample).collect()
    found.sort(key=lambda r: (r["u"], r["y"], r["x"]))
    return fit(np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in found], dtype=float))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            score = model.score(features(as_bytes(part.column(1))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row of docs, from the text alone.

    Null and empty texts are scored as texts without words. A model that had nothing to learn from gives 0.5. Repeated
    rows get equal results; other columns aren't read; an empty table gives an empty table.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(functools.partial(_scored, model=model), "doc_id long, score double, predicted int")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's chance of label 1, learned from labels whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    fold = remainder(F.col("doc_id"), 3)
    model = learn(docs, labels.filter(fold != 1))
    out = classify(docs, model)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")
