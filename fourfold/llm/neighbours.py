"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected, shifted and put in the order of a Hilbert curve, several times with other projections and
shifts. Each order is cut into ranges; in every order a query meets the `window` rows before it and after it, and the
nearest of all are ranked by exact distances. How wide the window must be depends on the data, so it is measured: the
true neighbours of a bounded sample of queries are found by looking at all rows, their exact places in every order are
counted, and the window is the least number of rows that reaches the wanted share of them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

CURVES, DIMENSIONS, BITS = 8, 8, 5
#: Distinct vectors that projections' quantiles and range bounds are fitted on, at most about.
SAMPLE = 20_000
#: Queries whose true neighbours decide the window, at most about; the share of these that some window must hold; the
#: least window.
PROBED, RECALL, LEAST_WINDOW = 200, 0.94, 100
#: A range holds about so many rows, or as many as a window if that is more; there are MOST_RANGES in an order at most.
RANGE_ROWS, MOST_RANGES = 2_000, 4_096
#: Rows and queries that one task compares at a time, about; larger ranges are split.
ROWS, QUERIES = 20_000, 5_000
NEAREST, QUERY_EVERY = 10, 100


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of coordinates, each of `bits` bits) on a Hilbert curve (transposed Gray code method)."""
    x = cells.astype(np.uint32).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & np.uint32(q)) != 0, flip ^ np.uint32(q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint32(b)) & np.uint32(1)).astype(np.uint64)
    return key


class Frame:
    """Vectors less a point near all of them and over their scale, so that |x|^2 - 2xy + |y|^2 neither cancels nor overflows.

    With n dimensions a quick distance is off by at most `doubt` times the larger square.
    """

    def __init__(self, sample: np.ndarray):
        largest = float(np.abs(sample).max(initial=0.0)) or 1.0
        self.centre = (sample / largest).mean(axis=0) * largest if len(sample) else np.zeros(sample.shape[1])
        self.scale = float(np.abs(sample / 2 - self.centre / 2).max(initial=0.0)) * 2 or 1.0
        self.doubt = 1e-15 * (sample.shape[1] + 10)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x / 2 - self.centre / 2) / (self.scale / 2)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from q, on the vectors as they are; huge differences are scaled first."""
    with np.errstate(over="ignore"):
        apart = x - q
        largest = np.abs(apart).max(axis=1, initial=0.0)
        plain = np.sqrt((apart**2).sum(axis=1))
    for k in np.flatnonzero((largest > 1e150) | (largest < 1e-150) & (largest > 0)).tolist():
        plain[k] = largest[k] * np.sqrt(((apart[k] / largest[k]) ** 2).sum()) if np.isfinite(largest[k]) else np.inf
    return plain


@dataclass
class Index:
    """Projections and shifts of the curves, quantiles for each projected coordinate, sorted keys of the sample, bounds of the ranges."""

    frame: Frame
    projections: list[np.ndarray]
    shifts: list[np.ndarray]
    quantiles: list[np.ndarray]
    samples: list[np.ndarray]
    bounds: list[np.ndarray]

    def keys(self, curve: int, vectors: np.ndarray) -> np.ndarray:
        """Curve position in the upper bits, a hash of the vector below, so that a crowded cell can be cut too."""
        y = self.frame(vectors) @ self.projections[curve]
        marks = self.quantiles[curve]
        share = np.stack([np.searchsorted(marks[:, i], y[:, i]) / (len(marks) + 1) for i in range(y.shape[1])], axis=1)
        cells = ((share + self.shifts[curve]) / 2 * (1 << BITS)).astype(np.uint32)
        noise = (np.abs(y.sum(axis=1)) * 1e9).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (hilbert(cells, BITS) << np.uint64(20)) | (noise >> np.uint64(44))

    def cut_into(self, ranges: int) -> None:
        self.bounds = [k[(np.arange(1, ranges) * len(k)) // ranges] for k in self.samples]


def fit(sample: np.ndarray, curves: int = CURVES, seed: int = 7) -> Index:
    rng, size = np.random.default_rng(seed), sample.shape[1]
    index = Index(Frame(sample), [], [], [], [], [])
    framed = index.frame(sample)
    for c in range(curves):
        index.projections.append(np.linalg.qr(rng.normal(size=(size, size)))[0][:, : min(size, DIMENSIONS)])
        index.shifts.append(rng.random(min(size, DIMENSIONS)))
        index.quantiles.append(np.quantile(framed @ index.projections[c], np.linspace(0, 1, 257)[1:-1], axis=0))
        index.samples.append(np.sort(index.keys(c, sample)))
    return index


def _usable(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (vec_id, vec, size) of vectors that take part; vec: their numbers as bytes."""
    for batch in batches:
        ids, vecs, sizes = [], [], []
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not x or None in x:
                continue
            v = np.array(x, dtype=kind)
            if np.isfinite(v).all() and v.any():
                ids.append(i)
                vecs.append((v + v.dtype.type(0)).tobytes())
                sizes.append(len(v))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(sizes, pa.int32())], names=["vec_id", "vec", "size"])


def _smallest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(vec, vec_id) -> (vec, ids): the smallest ids of each vector in this partition."""
    held: dict[bytes, list[int]] = {}
    for batch in batches:
        for v, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = held.setdefault(v, [])
            own.append(i)
            if len(own) > 4 * most:
                own[:] = sorted(set(own))[:most]
        if len(held) > 100_000:
            yield _lists(held, most)
            held = {}
    yield _lists(held, most)


def _lists(held: dict[bytes, list[int]], most: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array([sorted(set(x))[:most] for x in held.values()], pa.list_(pa.int64()))], names=["vec", "ids"])


def _matrix(column, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)


def _true_neighbours(batches: Iterator[pa.RecordBatch], probes: np.ndarray, kind: str, most: int, frame: Frame) -> Iterator[pa.RecordBatch]:
    """(vec) -> (probe, vec, score): the nearest of this partition for each probe, the probe itself left out."""
    names = {p.astype(kind).tobytes() for p in probes}
    own = [p.astype(kind).tobytes() for p in probes]
    best: list[list[tuple[float, bytes]]] = [[] for _ in own]
    probes = frame(probes)
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            vecs = whole.column(0).slice(start, 2000).to_pylist()
            x = frame(np.frombuffer(b"".join(vecs), dtype=kind).reshape(len(vecs), -1).astype(np.float64))
            far = (x * x).sum(axis=1)[None, :] - 2 * (probes @ x.T) + (probes * probes).sum(axis=1)[:, None]
            same = [k for k, v in enumerate(vecs) if v in names]
            for p, row in enumerate(far):
                for k in same:
                    if vecs[k] == own[p]:
                        row[k] = np.inf
                near = np.argpartition(row, most - 1)[:most] if len(row) > most else np.arange(len(row))
                best[p] = sorted(best[p] + [(float(row[k]), vecs[k]) for k in near.tolist() if np.isfinite(row[k])])[:most]
    out = [(p, v, d) for p, found in enumerate(best) for d, v in found]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in out], pa.int32()), pa.array([v for _, v, _ in out], pa.binary()), pa.array([d for _, _, d in out], pa.float64())], names=["probe", "vec", "score"])


def _below(batches: Iterator[pa.RecordBatch], index: Index, marks: list[np.ndarray], kind: str) -> Iterator[pa.RecordBatch]:
    """(vec) -> (curve, bin, n): how many rows of this partition lie between neighbouring marks of each order."""
    counts = [np.zeros(len(m) + 1, dtype=np.int64) for m in marks]
    for whole in batches:
        if whole.num_rows:
            x = _matrix(whole.column(0), kind)
            for c, m in enumerate(marks):
                counts[c] += np.bincount(np.searchsorted(m, index.keys(c, x), side="right"), minlength=len(m) + 1)
    curve = np.concatenate([np.full(len(n), c) for c, n in enumerate(counts)])
    bins = np.concatenate([np.arange(len(n)) for n in counts])
    yield pa.RecordBatch.from_arrays([pa.array(curve, pa.int32()), pa.array(bins, pa.int32()), pa.array(np.concatenate(counts), pa.int64())], names=["curve", "bin", "n"])


def measured_window(distinct: DataFrame, probes: np.ndarray, index: Index, kind: str, k: int, recall: float) -> int:
    """The least window that holds a share `recall` of the probes' true neighbours in some order.

    Each probe is compared with all rows once, in blocks, which is linear in the rows; what reaches the driver are k
    neighbours for each probe and one count for each of their places.
    """
    if not len(probes):
        return LEAST_WINDOW
    near = distinct.select("vec").mapInArrow(functools.partial(_true_neighbours, probes=probes, kind=kind, most=k, frame=index.frame), "probe int, vec binary, score double")
    place = F.row_number().over(W.partitionBy("probe").orderBy("score", "vec"))
    true = near.withColumn("_r", place).filter(F.col("_r") <= k).select("probe", "vec").collect()
    if not true:
        return LEAST_WINDOW
    x = np.frombuffer(b"".join(bytes(r["vec"]) for r in true), dtype=kind).reshape(len(true), -1).astype(np.float64)
    of = np.array([r["probe"] for r in true])
    keys = [(index.keys(c, probes), index.keys(c, x)) for c in range(len(index.samples))]
    marks = [np.unique(np.concatenate(pair)) for pair in keys]
    below = distinct.select("vec").mapInArrow(functools.partial(_below, index=index, marks=marks, kind=kind), "curve int, bin int, n long")
    counts = [np.zeros(len(m) + 1, dtype=np.int64) for m in marks]
    for r in below.groupBy("curve", "bin").agg(F.sum("n").alias("n")).collect():
        counts[r["curve"]][r["bin"]] = r["n"]
    apart = np.full(len(of), np.iinfo(np.int64).max)
    for (p, y), m, n in zip(keys, marks, counts, strict=True):
        rank = np.cumsum(n)  # rows below each mark
        apart = np.minimum(apart, np.abs(rank[np.searchsorted(m, p)][of] - rank[np.searchsorted(m, y)]))
    return max(LEAST_WINDOW, int(np.sort(apart)[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) + 1)


def _spread(batches: Iterator[pa.RecordBatch], index: Index, asked: bool, chunks: int, copies: int, reach: int, per_range: float, kind: str) -> Iterator[pa.RecordBatch]:
    """(vec, other) -> (curve, part, chunk, key, reach, vec, other).

    Rows go to one of `chunks` chunks of their range; queries (asked) to all chunks of their own range and of those
    that their window may reach into. reach: how many rows of that range before and after the query's key count.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0), kind)
        salt = x.view(np.uint64).sum(axis=1) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
        for curve in range(len(index.bounds)):
            keys = index.keys(curve, x)
            own, last = np.searchsorted(index.bounds[curve], keys, side="right"), len(index.bounds[curve])
            for step in (-1, 0, 1) if asked else (0,):
                part = own + step
                fine = (part >= 0) & (part <= last)
                far = np.full(len(x), reach)
                if asked and step:
                    # Where in its range a query stands, as the sample tells, less a doubt.
                    edge = index.bounds[curve][np.clip(np.minimum(own, part), 0, last - 1)] if last else np.zeros(len(x), dtype=np.uint64)
                    held = index.samples[curve]
                    between = np.abs(np.searchsorted(held, keys).astype(np.int64) - np.searchsorted(held, edge).astype(np.int64))
                    each = max(1, len(held)) / (last + 1)
                    share = between / each
                    far = np.ceil(reach - np.maximum(0, share - 1 / 16 - 2 * np.sqrt(share / each)) * per_range).astype(np.int64)
                    fine &= far > 0
                fine = np.flatnonzero(fine)
                for copy in range(copies):
                    # chunk numbers a pair: a row's chunk and a query's chunk
                    mine = (salt[fine] % np.uint64(chunks)).astype(np.int64)
                    chunk = copy * chunks + mine if asked else mine * copies + copy
                    take = pa.array(fine)
                    names = ["curve", "part", "chunk", "key", "reach", "vec", "other"]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fine), curve), pa.int32()), pa.array(part[fine], pa.int32()), pa.array(chunk), pa.array(keys[fine].view(np.int64)), pa.array(far[fine], pa.int64()), batch.column(0).take(take), batch.column(1).take(take)], names=names)


def _nearest(rows: pa.Table, queries: pa.Table, most: int, chunks: int, kind: str, frame: Frame) -> pa.Table:
    """The `most` nearest ids in one range for each query, among the rows that its window reaches: (q, id, score)."""
    out_q, out_id, out_score = [], [], []
    if rows.num_rows and queries.num_rows:
        rows, queries = rows.sort_by("key"), queries.sort_by("key")
        ids, x = rows.column("other").to_pylist(), _matrix(rows.column("vec"), kind)
        y = frame(x)
        squares, keys = (y * y).sum(axis=1), rows.column("key").to_numpy()
        # A chunk holds one in `chunks` of a range's rows, give or take; a window is as much smaller in it.
        reach = queries.column("reach").to_numpy() / chunks
        reach = np.ceil(reach + (3 * np.sqrt(reach) if chunks > 1 else 0)).astype(np.int64)
        asked = queries.column("key").to_numpy()
        low = np.maximum(np.searchsorted(keys, asked, side="left") - reach, 0)
        high = np.minimum(np.searchsorted(keys, asked, side="right") + reach, len(keys))
        names, q = queries.column("vec").to_pylist(), _matrix(queries.column("vec"), kind)
        p = frame(q)
        doubt = frame.doubt * (squares.max() + (p * p).sum(axis=1))
        for start in range(0, len(names), 100):
            # Neighbouring queries share most of their windows.
            end = min(start + 100, len(names))
            a, b = int(low[start:end].min()), int(high[start:end].max())
            rough = squares[None, a:b] - 2 * (p[start:end] @ y[a:b].T)
            at = np.arange(a, b)[None, :]
            rough[(at < low[start:end, None]) | (at >= high[start:end, None])] = np.inf
            # As many as needed by the quick formula, and all that may be as near within its doubt; then by exact differences.
            many = min(b - a, most)
            if not many:
                continue
            least = np.partition(rough, many - 1, axis=1)[:, many - 1]
            for k in range(start, end):
                found = np.flatnonzero((rough[k - start] <= least[k - start] + 4 * doubt[k]) & np.isfinite(rough[k - start])) + a
                exact = distances(x[found], q[k])
                best = sorted((d, i) for d, j in zip(exact.tolist(), found.tolist(), strict=True) for i in ids[j])[:most]
                out_q += [names[k]] * len(best)
                out_id += [i for _, i in best]
                out_score += [d for d, _ in best]
    return pa.table({"q": pa.array(out_q, pa.binary()), "id": pa.array(out_id, pa.int64()), "score": pa.array(out_score, pa.float64())})


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = NEAREST, curves: int = CURVES, window: int | None = None, recall: float = RECALL, sample: int = SAMPLE, probed: int = PROBED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k nearest rows found for each query, from (vec_id, embedding) both.

    window: rows that a query meets on either side in every order; None: as many as measured_window says, for `recall`
    of the true neighbours of about `probed` queries. Vectors that are null, zero or hold null or non-finite components
    take no part, nor do rows without an id or with another length than most have. Equal vectors are indexed once, with
    the k + 1 smallest of their ids, which is all that ties can ask for; a row is no candidate of a query with its own
    id. Ids that repeat count once. Every row is indexed; only quantiles and bounds are fitted on a sample. A table
    smaller than a window is searched as a whole. Empty tables give an empty table.
    """
    kind = "<f4" if rows.schema["embedding"].dataType.simpleString() == queries.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    usable_of = functools.partial(_usable, kind=kind)
    usable = cut(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(usable_of, "vec_id long, vec binary, size int"))
    asked = cut(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(usable_of, "vec_id long, vec binary, size int"))
    sizes = usable.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    size = sizes[0]["size"] if sizes else 1
    usable, asked = usable.filter(F.col("size") == size), asked.filter(F.col("size") == size)
    local = usable.select("vec", "vec_id").mapInArrow(functools.partial(_smallest, most=k + 1), "vec binary, ids array<long>")
    merged = local.groupBy("vec").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    distinct = cut(merged.select("vec", F.slice("ids", 1, k + 1).alias("other")))
    n = distinct.count()
    marks = asked.select("vec").distinct().withColumn("other", F.lit(None).cast("array<long>"))
    n_asked = marks.count()

    def drawn(frame: DataFrame, seed: int, most: int, of: int) -> np.ndarray:
        share = min(1.0, most / max(of, 1))
        found = frame.filter(F.pmod(F.xxhash64(F.lit(seed), "vec"), F.lit(1 << 30)) <= share * (1 << 30)).select("vec").collect()
        return np.frombuffer(b"".join(sorted(bytes(r["vec"]) for r in found)), dtype=kind).reshape(-1, size).astype(np.float64)

    x = drawn(distinct, 1, sample, n)
    x = x if len(x) else np.ones((1, size))
    index = fit(x, curves)
    if window is None:
        window = measured_window(distinct, drawn(marks, 2, probed, n_asked), index, kind, k, recall)
    ranges = int(max(1, min(MOST_RANGES, n // max(RANGE_ROWS, window))))
    index.cut_into(ranges)
    per_range = n / ranges
    chunks = max(1, -(-n // (ranges * ROWS)))
    groups = max(1, -(-n_asked * 2 // (ranges * QUERIES)))
    schema = "curve int, part int, chunk long, key long, reach long, vec binary, other array<long>"
    placed = distinct.mapInArrow(functools.partial(_spread, index=index, asked=False, chunks=chunks, copies=groups, reach=0, per_range=per_range, kind=kind), schema)
    meeting = marks.mapInArrow(functools.partial(_spread, index=index, asked=True, chunks=groups, copies=chunks, reach=window, per_range=per_range, kind=kind), schema)
    by = ["curve", "part", "chunk"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(left, right, k + 1, chunks, kind, index.frame)

    found = placed.groupBy(*by).cogroup(meeting.groupBy(*by)).applyInArrow(compare, "q binary, id long, score double")
    merged = found.groupBy("q", "id").agg(F.min("score").alias("score"))
    place = F.row_number().over(W.partitionBy("q").orderBy("score", "id"))
    best = cut(merged.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place"))
    ids = asked.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q")).distinct()
    pairs = ids.join(best, "q").filter("query_id <> id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id")).cast("int")
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest found for every vector whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))
