"""Line dedup over the whole corpus by a deletion-neighbourhood join.

Lines are sequences of words (A-Z as a-z, white space dropped), and an edit is one word put in, left out or replaced.
A line of LEAST words or more goes if an earlier line, by (doc_id, line number), is within `edits` edits of it. In a
shorter line one word is too much of it: such lines, if they have LEAST_CHARS characters or more, are sequences of
characters, and go if an earlier one is within one edit of a character. Equal lines meet by a hash of the whole and go
at any length. For the rest each line gives the hash of every variant with words left out: an edit that replaces a word
leaves the same place open in both lines, one that puts a word in makes one line a variant of the other. What meets is
verified by words, and the earliest stays.

With one edit only lines that share their first or last half with another line can be within it of any, so only those
give variants; that loses nothing. With more edits (a parameter; the query has one) all lines give all variants with up
to so many places open or words left out.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, column_name, mix, powers, slices, with_row_keys, written

LEAST, LEAST_CHARS = 8, 24
#: So many candidate lines are sent to every task; more are joined by document.
BROADCAST_LINES = 2_000_000
_B1, _B2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
#: A place of lines that is one number: the document in the upper bits, the line below.
LINE_BITS = 24
_SPELLED, _BLANK = b"\x01", b"\x02"


class Lines:
    """The lines of some texts that have words, with hashes of any run of their words."""

    def __init__(self, texts: list[bytes | None]):
        self.words = words = Words(texts)
        self.hashes = words.hashes(fold=True)
        feeds = np.flatnonzero(words.data == 10)
        line = np.searchsorted(feeds, words.starts)  # number of the line in all texts
        self.begin = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.empty(0, dtype=np.int64)
        self.end = np.append(self.begin[1:], len(line))[: len(self.begin)]
        self.text = np.searchsorted(words.texts, words.starts[self.begin], side="right") - 1
        before = np.searchsorted(feeds, words.texts[:-1])
        self.number = line[self.begin] - before[self.text]
        self._sums = {b: np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(self.hashes + np.uint64(b & 0xFFFF)) * powers(b, len(self.hashes)))]) for b in (_B1, _B2)}
        self._back = {b: powers(pow(b, -1, 1 << 64), len(self.hashes) + 2) for b in (_B1, _B2)}

    def run(self, start: np.ndarray, end: np.ndarray, base: int = _B1) -> np.ndarray:
        """Hash of the words start .. end - 1, before it is scrambled."""
        s = self._sums[base]
        return (s[end] - s[start]) * self._back[base][start]

    def halves(self, i: np.ndarray) -> list[np.ndarray]:
        """Keys of the first and the last half, as they count for a partner of the same length and of one word more or less."""
        b, e = self.begin[i], self.end[i]
        out = []
        for shorter in (e - b, e - b - 1):
            half = shorter // 2
            out += [mix(self.run(b, b + half) + mix((4 * shorter + 1).astype(np.uint64))), mix(self.run(e - half, e) + mix((4 * shorter + 2).astype(np.uint64)))]
        return out


def folded(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def spelled(line: bytes) -> bytes:
    """A folded line with each of its characters as a word, behind a word that no line has."""
    return b" ".join([_SPELLED, *[_BLANK if c == " " else c.encode("utf-8", "surrogatepass") for c in line.decode("utf-8", "surrogatepass")]])


def is_short(line: bytes, least: int, least_chars: int | None) -> bool:
    """Whether a folded line is compared by characters."""
    return least_chars is not None and line.count(b" ") + 1 < least and len(line.decode("utf-8", "surrogatepass")) >= least_chars


def _lines(batches: Iterator[pa.RecordBatch], least: int, least_chars: int | None) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> (doc, line, h1, h2, k1 to k4); keys of halves for lines that may have a partner, null for others."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = as_bytes(part.column(1))
            x = Lines(texts)
            if not len(x.begin):
                continue
            doc = part.column(0).to_numpy(zero_copy_only=False)[x.text]
            n = x.end - x.begin
            size = n.astype(np.uint64)
            h1, h2 = mix(x.run(x.begin, x.end) + size), mix(x.run(x.begin, x.end, _B2) + size)
            keys = np.zeros((len(n), 4), dtype=np.uint64)
            wanted = n >= least
            keys[wanted] = np.stack(x.halves(np.flatnonzero(wanted)), axis=1)
            if least_chars is not None:
                span = x.words.ends[x.end - 1] - x.words.starts[x.begin]
                few = np.flatnonzero(~wanted & (span >= least_chars))
                found = [folded(x.words.data[a:b].tobytes()) for a, b in zip(x.words.starts[x.begin[few]].tolist(), x.words.ends[x.end[few] - 1].tolist(), strict=True)]
                short = [k for k, line in enumerate(found) if is_short(line, least, least_chars)]
                if short:
                    y = Lines([spelled(found[k]) for k in short])
                    keys[few[short]] = np.stack(y.halves(np.arange(len(short))), axis=1)
                    wanted[few[short]] = True
            columns = [pa.array(keys[:, k].view(np.int64), mask=~wanted) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(x.number, pa.int32()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *columns], names=["doc", "line", "h1", "h2", "k1", "k2", "k3", "k4"])


def _chosen(batches: Iterator[pa.RecordBatch], least: int, least_chars: int | None) -> Iterator[pa.RecordBatch]:
    """(doc, text, lines) -> (doc, line, words), words joined by spaces; short lines as characters."""
    for batch in batches:
        for part in slices(batch, "text"):
            doc, line, words = [], [], []
            for d, t, wanted in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                own = (t or b"").split(b"\n")
                doc += [d] * len(wanted)
                line += wanted
                found = [folded(own[k]) for k in wanted]
                words += [spelled(x) if is_short(x, least, least_chars) else x for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(words, pa.binary())], names=["doc", "line", "words"])


def _variants(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(doc, line, words) -> (key, doc, line).

    kind `placed`: a word left out at a place, the place is part of the key; `left_out`: a word left out anywhere;
    `whole`: the line itself.
    """
    for batch in batches:
        for part in slices(batch, "words"):
            x = Lines(as_bytes(part.column(2)))
            if not len(x.begin):
                continue
            size = x.end - x.begin
            at = np.arange(len(x.hashes))
            if kind == "whole":
                keys, own = mix(x.run(x.begin, x.end) + size.astype(np.uint64)), np.arange(len(size))
                yield _keyed(keys, pa.array(x.text[own]), part)
                continue
            own = np.repeat(np.arange(len(size)), size)
            b, e = x.begin[own], x.end[own]
            back = x._back[_B1]
            sums = x._sums[_B1]
            rest = (sums[at] - sums[b]) * back[b] + (sums[e] - sums[at + 1]) * back[b + 1]
            n = (e - b).astype(np.uint64)
            keys = mix(rest + n - np.uint64(1))
            if kind == "placed":
                keys = mix(keys + mix((at - b + 1).astype(np.uint64) * np.uint64(_B2)))
            yield _keyed(keys, pa.array(x.text[own]), part)


def _open_variants(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """(doc, line, words) -> (key, doc, line, places, gone) of every variant with up to `edits` places left open or words left out.

    Two lines are within `edits` edits if, and only if, they have a variant in common whose open places and the words
    left out of either are no more than that. A line of characters has one edit.
    """
    open_word = mix(np.array([_B2 & 0xFFFF], dtype=np.uint64))[0]
    for batch in batches:
        for part in slices(batch, "words", 200_000):
            texts = as_bytes(part.column(2))
            x = Lines(texts)
            hashes = mix(x.hashes + np.uint64(_B1 & 0xFFFF))
            size = x.end - x.begin
            few = np.array([t.startswith(_SPELLED) for t in texts])
            for n, most in {(int(n), 1 if few[t] else edits) for n, t in zip(size, x.text, strict=True)}:
                own = np.flatnonzero((size == n) & (few[x.text] if most == 1 and edits > 1 else ~few[x.text] | (edits == 1)))
                words = hashes[x.begin[own][:, None] + np.arange(n)]
                for places in range(most + 1):
                    for gone in range(most + 1 - places):
                        if places + gone > n:
                            continue
                        yield from _with_holes(part, x.text[own], words, places, gone, open_word)


def _with_holes(part: pa.RecordBatch, where: np.ndarray, words: np.ndarray, places: int, gone: int, open_word: np.uint64) -> Iterator[pa.RecordBatch]:
    n = words.shape[1]
    ahead = powers(_B1, n + 1)
    for out in itertools.combinations(range(n), gone):
        left = np.delete(words, out, axis=1)
        terms = left * ahead[: left.shape[1]]
        whole = terms.sum(axis=1, dtype=np.uint64)
        for at in itertools.combinations(range(left.shape[1]), places):
            at = list(at)
            key = whole - terms[:, at].sum(axis=1, dtype=np.uint64) + (open_word * ahead[at]).sum(dtype=np.uint64)
            batch = _keyed(mix(key + np.uint64(left.shape[1])), pa.array(where), part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(where), places), pa.int32()), pa.array(np.full(len(where), gone), pa.int32())], names=["key", "doc", "line", "places", "gone"])


def _keyed(keys: np.ndarray, where: pa.Array, part: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0).take(where), part.column(1).take(where)], names=["key", "doc", "line"])


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word put in, left out or replaced, or none, makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within_one(x.split(), y.split()) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield batch.select(["p"]).filter(pa.array(good, pa.bool_()))


def _kept_text(text: bytes | None, keep: set[int]) -> bytes | None:
    if text is None:
        return None
    return b"\n".join([x for k, x in enumerate(text.split(b"\n")) if k in keep or not x.split()])


def _rebuilt(batches: Iterator[pa.RecordBatch], text: str, kept: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            at = part.schema.get_field_index(text)
            texts, lists = as_bytes(part.column(at)), part.column(part.schema.get_field_index(kept)).to_pylist()
            new = [_kept_text(t, set(k or ())) for t, k in zip(texts, lists, strict=True)]
            lines = [sum(1 for x in (t or b"").split(b"\n") if x.split()) for t in texts]
            left = [sum(1 for x in (t or b"").split(b"\n") if x.split()) for t in new]
            columns = [pa.array([None if x is None else x.decode() for x in new], pa.string()) if n == text else part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(left, pa.int64())], names=[*names, "n_lines", "n_kept"])


def _place(doc: str, line: str, packed: bool) -> Column:
    """Where a line stands, in order: one number where that holds it, which hash aggregation can take the least of."""
    return F.shiftleft(F.col(doc), LINE_BITS).bitwiseOR(F.col(line).cast("long")) if packed else F.struct(F.col(doc).alias("doc"), F.col(line).alias("line"))


def _unpacked(place: str, packed: bool) -> list[Column]:
    if packed:
        return [F.shiftright(place, LINE_BITS).alias("doc"), F.col(place).bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line")]
    return [F.col(f"{place}.doc"), F.col(f"{place}.line")]


def kept_lines(source: DataFrame, least: int = LEAST, least_chars: int | None = LEAST_CHARS, edits: int = 1) -> DataFrame:
    """(doc, line) of all lines that stay, from (doc, text); doc is unique."""
    ends = source.agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max(F.octet_length("text")).alias("long")).first()
    packed = (ends["low"] or 0) >= 0 and (ends["high"] or 0) < 1 << (63 - LINE_BITS) and (ends["long"] or 0) < 1 << LINE_BITS
    bounds = {"least": least, "least_chars": least_chars}
    found = source.mapInArrow(functools.partial(_lines, **bounds), "doc long, line int, h1 long, h2 long, k1 long, k2 long, k3 long, k4 long")
    halves = [f"k{k}" for k in range(1, 5)]
    firsts = written(found.groupBy("h1", "h2").agg(F.min(_place("doc", "line", packed)).alias("p"), *[F.first(k).alias(k) for k in halves]).drop("h1", "h2"))
    may = firsts.filter("k1 is not null")
    if edits == 1:
        each = may.select("p", F.explode(F.array(*halves)).alias("key"))
        shared = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        may = each.join(shared, "key").select("p").distinct()
    wanted = may.select(*_unpacked("p", packed))
    wanted = written(wanted.groupBy("doc").agg(F.collect_list("line").alias("lines")))
    if (wanted.agg(F.sum(F.size("lines")).alias("n")).first()["n"] or 0) <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    texts = source.join(wanted, "doc").select("doc", "text", "lines").mapInArrow(functools.partial(_chosen, **bounds), "doc long, line int, words binary")
    texts = written(texts)
    place = _place("doc", "line", packed).alias("p")
    if edits > 1:
        gone = _within(texts.mapInArrow(functools.partial(_open_variants, edits=edits), "key long, doc long, line int, places int, gone int").select("key", place, "places", "gone"), edits)
        return firsts.select("p").join(gone, "p", "left_anti").select(*_unpacked("p", packed))

    def variants(kind: str) -> DataFrame:
        return texts.mapInArrow(functools.partial(_variants, kind=kind), "key long, doc long, line int").select("key", place)

    placed, left_out, whole = written(variants("placed")), variants("left_out"), variants("whole")
    # One key a line goes to every task while lines are few, so that the many keys of variants stay where they are.
    if texts.count() <= BROADCAST_LINES:
        whole = F.broadcast(written(whole))
    earliest = placed.groupBy("key").agg(F.min("p").alias("e"), F.count("*").alias("n")).filter("n > 1").drop("n")
    replaced = placed.join(earliest, "key").filter("p > e").select("p", "e")
    put_in = left_out.join(whole.withColumnRenamed("p", "w"), "key").select(F.greatest("p", "w").alias("p"), F.least("p", "w").alias("e"))
    pairs = replaced.unionByName(put_in).distinct()
    a, b = texts.select(place, F.col("words").alias("x")), texts.select(place.alias("e"), F.col("words").alias("y"))
    checked = pairs.join(a, "p").join(b, "e").select("p", "x", "y").mapInArrow(_verified, f"p {'long' if packed else 'struct<doc: long, line: int>'}")
    return firsts.select("p").join(checked.distinct(), "p", "left_anti").select(*_unpacked("p", packed))


def _within(variants: DataFrame, edits: int) -> DataFrame:
    """p of the lines that have an earlier one within `edits` edits, from (key, p, places, gone).

    For each variant and each number of words left out the earliest line is kept; no two lines are paired. What meets
    has one variant with as many open places, so their hashes' 64 bits stand for the words.
    """
    reach = [F.min(F.when(F.col("gone") <= g, F.col("p"))).alias(f"e{g}") for g in range(edits + 1)]
    earliest = variants.groupBy("key", "places").agg(*reach, F.count("*").alias("n")).filter("n > 1")
    own = F.element_at(F.array(*[f"e{g}" for g in range(edits + 1)]), F.lit(edits + 1) - F.col("places") - F.col("gone"))
    return variants.join(earliest, ["key", "places"]).filter(own < F.col("p")).select("p").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, least_chars: int | None = LEAST_CHARS, edits: int = 1) -> DataFrame:
    """docs with each text less the lines that go, and n_lines, n_kept: its lines with words before and after.

    edits: words that may differ in lines of `least` words or more; least_chars: characters from which on a shorter line
    goes for an earlier short one within one character (None: short lines go when equal only). Equal lines go at any
    length. Lines without words stay as they are; null and empty texts stay null and empty; a document whose lines all
    go has an empty text or the feeds of its blank lines. Every row is a document of its own: of rows that repeat an id
    the first stands in the id's place, the others and rows without an id stand after all ids. Columns of docs named
    n_lines or n_kept are replaced; an empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_kept")
    names = docs.columns
    mine, lists = column_name(docs, "doc"), column_name(docs, "kept")
    docs = with_row_keys(docs, doc_id, mine)
    kept = kept_lines(docs.select(F.col(mine).alias("doc"), F.col(text).alias("text")), least, least_chars, edits)
    per = kept.groupBy(F.col("doc").alias(mine)).agg(F.collect_list("line").alias(lists))
    joined = docs.join(per, mine, "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(mine).schema.fields) + ", n_lines long, n_kept long"

    def run(batches):
        return _rebuilt(batches, text, lists, names)

    return joined.mapInArrow(run, schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's lines before and after, and the size and checksum of its new text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "n_lines", "n_kept", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("kept_bytes"), crc.alias("kept_crc32"))
