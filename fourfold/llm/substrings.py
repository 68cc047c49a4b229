"""Substring dedup: words in windows of fixed length that start earlier elsewhere are removed, over the whole corpus.

Every window of a document has a Rabin-Karp hash, and Spark counts them. Windows go there in segments: each has as its
anchor the run of ANCHOR words in it with the least hash, and neighbouring windows of one anchor make a segment. Equal
windows have equal anchors at equal places, so

* a window whose anchor stands nowhere else can't repeat; only anchors that repeat are looked at further;
* of equal segments all but the first repeat as a whole;
* where one anchor has several kinds of segment (as at the ends of a shared passage) the windows of the first segment of
  each kind are counted one by one.

None of this drops a case: it saves rows. A window counts as equal if its hash and that of its anchor, 64 bits each, are.
What repeats is merged into maximal intervals of words, one row for each document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Words, as_bytes, column_name, mix, slices, with_row_keys, written

WINDOW, ANCHOR = 20, 8
_BASE = 0x9FB21C651E98DF25
_PLACE = np.uint64((1 << 31) - 1)


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of the n words from each place on, modulo 2**64: hashes of runs of 1, 2, 4 ... words put together."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    whole, done, run, size = None, 0, words, 1
    while True:
        if n & size:
            whole, done = (run, size) if whole is None else (run[: len(run) - done] * np.uint64(pow(_BASE, done, 1 << 64)) + whole[size : size + len(run) - done], done + size)
        if 2 * size > n:
            return mix(whole)
        run = run[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + run[size:]
        size *= 2


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :])


def again(own: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether the same keys stood earlier with the same owner; rows are in order."""
    order = np.lexsort((*keys, own))
    same = np.ones(max(len(own) - 1, 0), dtype=bool)
    for k in (own, *keys):
        same &= k[order[1:]] == k[order[:-1]]
    out = np.zeros(len(own), dtype=bool)
    out[order[1:]] = same
    return out


class Windows:
    """The windows of some texts. own: the text of each word; at: where windows start; key: hash of each one's anchor."""

    def __init__(self, texts: list[bytes | None], window: int, anchor: int):
        self.words = words = Words(texts)
        hashes = words.hashes()
        self.own = np.repeat(np.arange(len(texts)), words.counts())
        self.hashes = rolling(hashes, window)
        self.at = np.flatnonzero(self.own[: len(self.hashes)] == self.own[len(self.own) - len(self.hashes) :])
        if not len(self.at):
            self.place = self.key = np.empty(0, dtype=np.uint64)
            return
        grams = rolling(hashes, anchor)
        self.place = (least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), window - anchor + 1) & _PLACE)[self.at]
        self.key = grams[self.place]

    def start(self, at: np.ndarray) -> np.ndarray:
        return at - self.words.first[self.own[at]]


def _segments(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> (anchor, segment, doc, start, n, again): a row for each run of n windows that have one anchor."""
    for batch in batches:
        for part in slices(batch, "text"):
            x = Windows(as_bytes(part.column(1)), window, anchor)
            if not len(x.at):
                continue
            begin = np.flatnonzero(np.diff(x.place.astype(np.int64), prepend=-1))
            n = np.diff(begin, append=len(x.at))
            first = x.at[begin]
            kind = mix(x.hashes[first] + mix(x.hashes[first + n - 1] + n.astype(np.uint64)))
            key, own = x.key[begin], x.own[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(kind.view(np.int64)), part.column(0).take(pa.array(own)), pa.array(x.start(first), pa.int32()), pa.array(n, pa.int32()), pa.array(again(own, key, kind))],
                names=["anchor", "segment", "doc", "start", "n", "again"],
            )


def _single(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(doc, text, runs) -> (anchor, hash, doc, start, again) of the windows in the runs, packed as start << 32 | n."""
    for batch in batches:
        for part in slices(batch, "text"):
            x = Windows(as_bytes(part.column(1)), window, anchor)
            runs = part.column(2)
            own = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(runs.offsets)))
            packed = runs.flatten().to_numpy(zero_copy_only=False)
            start, n = x.words.first[own] + (packed >> 32), packed & 0xFFFFFFFF
            change = np.zeros(len(x.own) + 2, dtype=np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + n, -1)
            wanted = np.flatnonzero(np.cumsum(change)[x.at] > 0)
            at, key = x.at[wanted], x.key[wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(x.hashes[at].view(np.int64)), part.column(0).take(pa.array(x.own[at])), pa.array(x.start(at), pa.int32()), pa.array(again(x.own[at], key, x.hashes[at]))],
                names=["anchor", "segment", "doc", "start", "again"],
            )


def merged(runs: np.ndarray) -> np.ndarray:
    """Maximal intervals, as (from, to) rows, of runs of words packed as start << 32 | n."""
    start = np.sort(runs)
    start, end = start >> 32, (start >> 32) + (start & 0xFFFFFFFF)
    end = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return np.stack([start[new], end[np.append(new[1:], len(end)) - 1]], axis=1)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merged(np.asarray(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
        pairs = [[{"from": int(a), "to": int(b)} for a, b in s] for s in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pairs, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))], names=["doc", "spans"])


def _rebuilt(batches: Iterator[pa.RecordBatch], text: str, spans: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            at, lists = part.schema.get_field_index(text), part.column(part.schema.get_field_index(spans))
            texts, counts, gone = [], [], []
            for t, own in zip(as_bytes(part.column(at)), lists.to_pylist(), strict=True):
                words = (t or b"").split()
                counts.append(len(words))
                for s in reversed(own or ()):
                    del words[s["from"] : s["to"]]
                gone.append(counts[-1] - len(words))
                texts.append(None if t is None else b" ".join(words).decode())
            columns = [pa.array(texts, pa.string()) if n == text else part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), lists], names=[*names, "n_words", "n_removed", "spans"])


def _few(rows: DataFrame, n: int) -> DataFrame:
    """rows, to be sent to every task where they hold BROADCAST_KEYS entries (n) or fewer; else the engine deals both sides."""
    return F.broadcast(rows) if n <= BROADCAST_KEYS else rows


def _firsts(rows: DataFrame, *more: Column) -> DataFrame:
    """(anchor, segment, doc0, start0, times, ...): where each kind stands first. A document has one row of a kind that isn't `again`."""
    new = F.when(~F.col("again"), F.col("doc"))
    return rows.groupBy("anchor", "segment").agg(F.min(new).alias("doc0"), F.min_by("start", new).alias("start0"), F.count("*").alias("times"), *more)


def _later(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows that don't stand first among those of their kind."""
    same = (F.col("doc") == F.col("doc0")) & (F.col("start") == F.col("start0"))
    return rows.join(firsts.filter("times > 1"), ["anchor", "segment"]).filter(~same)


def repeated_spans(source: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, spans) of all documents that lose words, from (doc, text); doc is unique, its order says what is earlier."""
    sizes = {"window": window, "anchor": anchor}
    segments = source.mapInArrow(functools.partial(_segments, **sizes), "anchor long, segment long, doc long, start int, n int, again boolean")
    keys = written(segments.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"))
    found = written(segments.join(_few(keys, keys.count()), "anchor", "left_semi"))
    firsts = written(_firsts(found, F.max("n").alias("n")))
    # Windows of unlike segments of one anchor, one by one.
    several = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
    packed = F.shiftleft(F.col("start0").cast("long"), 32) + F.col("n")
    runs = written(firsts.join(several, "anchor", "left_semi").groupBy(F.col("doc0").alias("doc")).agg(F.collect_list(packed).alias("runs")))
    held = _few(runs, runs.agg(F.sum(F.size("runs"))).first()[0] or 0)
    single = source.join(held, "doc").select("doc", "text", "runs").mapInArrow(functools.partial(_single, **sizes), "anchor long, segment long, doc long, start int, again boolean")
    single = written(single)
    later = _later(found, firsts.drop("n")).select("doc", "start", "n").unionByName(_later(single, _firsts(single)).select("doc", "start", F.lit(1).alias("n")))
    per = later.groupBy("doc").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32) + F.col("n") + (window - 1)).alias("runs"))
    return written(per.mapInArrow(_merged, "doc long, spans array<struct<from: int, to: int>>"))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with each text as its kept words, joined by one space, and n_words, n_removed, spans.

    A word goes if a window of `window` words that covers it has its words, in order, also start earlier: in a row
    before this one or further ahead in this text. Windows are judged on the texts as they come. spans: maximal
    intervals [from, to) of words that went, null where none did. Rows stand in the order of their ids; of rows that
    repeat an id the first stands in the id's place, the others and rows without an id stand after all ids. Texts of
    fewer words than a window, and empty texts, lose nothing; a null text stays null and has no words. Columns of docs
    named n_words, n_removed or spans are replaced; an empty table gives an empty table.
    """
    if not 1 <= anchor <= window:
        raise ValueError(f"an anchor of {anchor} words is no part of a window of {window}")
    docs = docs.drop("n_words", "n_removed", "spans")
    names = docs.columns
    mine, lists = column_name(docs, "doc"), column_name(docs, "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_words long, n_removed long, spans array<struct<from: int, to: int>>"
    docs = with_row_keys(docs, doc_id, mine)
    spans = repeated_spans(docs.select(F.col(mine).alias("doc"), F.col(text).alias("text")), window, anchor).select(F.col("doc").alias(mine), F.col("spans").alias(lists))
    joined = docs.join(_few(spans, spans.agg(F.sum(F.size(lists))).first()[0] or 0), mine, "left")
    return joined.mapInArrow(functools.partial(_rebuilt, text=text, spans=lists, names=names), schema)


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's words, how many went, and the digest of those that stayed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = rf"""
with words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)
),
windows as (
  select doc_id, place, list_aggregate(list(word) over (partition by doc_id order by place rows between current row and {WINDOW - 1} following), 'string_agg', ' ') as window_text,
    lead(place, {WINDOW - 1}) over (partition by doc_id order by place) as last
  from words
),
later as (
  select doc_id, place, last is not null and row_number() over (partition by window_text, last is null order by doc_id, place) > 1 as repeats from windows
),
covered as (
  select doc_id, place, max(repeats::int) over (partition by doc_id order by place rows between {WINDOW - 1} preceding and current row) as gone from later
)
select d.doc_id, count(c.place) as n_words, coalesce(sum(c.gone), 0)::bigint as n_removed,
  sha256(coalesce(string_agg(w.word, ' ' order by c.place) filter (c.gone = 0), '')) as kept_sha256
from documents d left join covered c on c.doc_id = d.doc_id left join words w on w.doc_id = c.doc_id and w.place = c.place
group by d.doc_id
"""
