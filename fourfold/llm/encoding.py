"""SentencePiece encoding and decoding by a batched Viterbi search.

Words of equal length advance together: at every position the best scores of all of them are one vectorised maximum
over the pieces that end there, found by their hashes among the sorted keys of the vocabulary.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import SPACE, Vocabulary, load, probe, word_forms

#: Characters of equally long words that advance together, and distinct words that a task remembers.
TOGETHER, REMEMBERED = 60_000, 300_000
#: Characters of all words that are remembered.
REMEMBERED_CHARS = 8_000_000
#: Ids that are decoded together, about.
DECODED = 100_000
#: Words of more characters are cut first, where no piece can lie; they are looked at in runs of so many characters.
LONG, RUN = 2_000, 100_000


def viterbi(vocabulary: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of words of one length (rows of code points): piece codes of all words in a row, and how many each has.

    A code is a piece's id, or -1 - c for a character c that no piece covers. Of equal scores the path whose last piece
    starts earliest wins; scores add up in double precision, in which the sums of a word are exact for whole scores.
    """
    n, size = points.shape
    ids, scores = probe(vocabulary, points)
    most = ids.shape[2]
    uncovered = ids[:, :, 0] < 0
    scores[:, :, 0] = np.where(uncovered, np.float32(vocabulary.unknown_score), scores[:, :, 0])
    best = np.zeros((n, size + 1))
    back = np.zeros((n, size + 1), dtype=np.int32)
    rows = np.arange(n)
    for end in range(1, size + 1):
        starts = np.arange(max(0, end - most), end)
        reached = best[:, starts] + scores[:, starts, end - starts - 1]
        first = reached.argmax(axis=1)
        best[:, end] = reached[rows, first]
        back[:, end] = end - starts[first]
    codes = np.zeros((n, size), dtype=np.int32)
    counts = np.zeros(n, dtype=np.int64)
    at, live = np.full(n, size), rows
    while len(live):
        length = back[live, at[live]]
        start = at[live] - length
        found = ids[live, start, length - 1]
        codes[live, counts[live]] = np.where(found >= 0, found, -1 - points[live, start].astype(np.int32))
        counts[live] += 1
        at[live] = start
        live = live[start > 0]
    # Paths were followed from their ends.
    turned = np.maximum(counts[:, None] - 1 - np.arange(size)[None, :], 0)
    return np.take_along_axis(codes, turned, axis=1)[np.arange(size)[None, :] < counts[:, None]], counts


def longest_at(vocabulary: Vocabulary, word: np.ndarray) -> np.ndarray:
    """Length of the longest piece that starts at each character of a long word; 1 where there is none."""
    out = np.ones(len(word), dtype=np.int16)
    for a in range(0, len(word), RUN):
        ids, _ = probe(vocabulary, word[None, a : a + RUN + vocabulary.longest - 1])
        held = ids[0, : len(word[a : a + RUN])] >= 0
        out[a : a + RUN] = np.maximum(1, (held * np.arange(1, held.shape[1] + 1)).max(axis=1))
    return out


def segments(vocabulary: Vocabulary, word: np.ndarray) -> np.ndarray:
    """Bounds of the runs of characters that no piece crosses: the best path of a word is made of theirs."""
    reach = np.maximum.accumulate(np.arange(len(word)) + longest_at(vocabulary, word))
    inner = np.flatnonzero(reach[:-1] <= np.arange(1, len(word))) + 1
    return np.concatenate([[0], inner, [len(word)]])


def step_through(vocabulary: Vocabulary, word: np.ndarray) -> np.ndarray:
    """The codes of one long run, character by character: scores of a few places only, and the last piece of each place."""
    size, most = len(word), vocabulary.longest
    back, code = np.zeros(size + 1, dtype=np.int16), np.zeros(size + 1, dtype=np.int32)
    best = [0.0] + [-np.inf] * most  # the scores at the place that is worked on and at those after it
    for a in range(0, size, RUN):
        ids, scores = probe(vocabulary, word[None, a : a + RUN + most - 1])
        ids, scores = ids[0], scores[0]
        for k in range(len(word[a : a + RUN])):
            here, row, found = best[0], scores[k].tolist(), ids[k].tolist()
            if found[0] < 0:
                row[0], found[0] = vocabulary.unknown_score, -1 - int(word[a + k])
            best = best[1:] + [-np.inf]
            for length, s in enumerate(row[: size - a - k], 1):
                if here + s > best[length - 1]:
                    best[length - 1] = here + s
                    back[a + k + length], code[a + k + length] = length, found[length - 1]
    codes, at = [], size
    while at:
        codes.append(code[at])
        at -= int(back[at])
    return np.array(codes[::-1], dtype=np.int32)


def long_word(vocabulary: Vocabulary, word: np.ndarray) -> np.ndarray:
    """The codes of the best path of one long word: runs between cuts advance together by length, the longest by themselves."""
    bounds = segments(vocabulary, word)
    sizes = np.diff(bounds)
    out: list[np.ndarray | None] = [None] * len(sizes)
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        if size > LONG:
            for i in places.tolist():
                out[i] = step_through(vocabulary, word[bounds[i] : bounds[i + 1]])
            continue
        step = max(1, TOGETHER // size)
        for a in range(0, len(places), step):
            group = places[a : a + step]
            codes, n = viterbi(vocabulary, word[bounds[group][:, None] + np.arange(size)[None, :]])
            for i, part in zip(group.tolist(), np.split(codes, np.cumsum(n)[:-1]), strict=True):
                out[i] = part
    return np.concatenate(out)


def with_bytes(vocabulary: Vocabulary, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids for codes, and how many each code has: one, or as many as the UTF-8 bytes of an uncovered character."""
    point = -1 - codes.astype(np.int64)
    wide = np.where(codes >= 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
    ids = np.repeat(codes, wide)
    missing = np.flatnonzero(codes < 0)
    if len(missing):
        first = np.cumsum(wide) - wide
        for i in missing.tolist():
            data = chr(int(point[i])).encode("utf-8", "surrogatepass")
            ids[first[i] : first[i] + len(data)] = vocabulary.byte_ids[list(data)]
    return ids, wide


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions first[i] .. first[i] + counts[i] - 1 for each i, in a row."""
    ends = np.cumsum(counts)
    places = np.repeat(first - (ends - counts), counts)
    places += np.arange(len(places))
    return places


class Encoder:
    """Encodes texts; each distinct word is searched once while it is remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.first, self.counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        order, ids, counts = [], [], []
        for size, places in sorted(by_size.items()):
            if size > LONG:
                for i in places:
                    data = words[i].encode("utf-32-le", "surrogatepass")
                    expanded, wide = with_bytes(self.vocabulary, long_word(self.vocabulary, np.frombuffer(data, dtype=np.uint32)))
                    order.append(i)
                    ids.append(expanded)
                    counts.append(np.array([wide.sum()]))
                continue
            step = max(1, TOGETHER // size)
            for a in range(0, len(places), step):
                group = places[a : a + step]
                data = "".join([words[i] for i in group]).encode("utf-32-le", "surrogatepass")
                codes, n = viterbi(self.vocabulary, np.frombuffer(data, dtype=np.uint32).reshape(len(group), size))
                expanded, wide = with_bytes(self.vocabulary, codes)
                ends = np.cumsum(n)
                order += group
                ids.append(expanded)
                counts.append(np.add.reduceat(wide, ends - n))
        total = np.concatenate(counts)
        first = np.empty(len(words), dtype=np.int64)
        held = np.empty(len(words), dtype=np.int64)
        first[order] = len(self.ids) + np.cumsum(total) - total
        held[order] = total
        self.first, self.counts = np.concatenate([self.first, first]), np.concatenate([self.counts, held])
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (with the end of the last)."""
        if len(self.number) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self._forget()
        known, number = len(self.number), self.number
        places, sizes = [], [0]
        for t in texts:
            forms = word_forms(t)
            places += [number.setdefault(w, len(number)) for w in forms]
            sizes.append(len(places))
        if len(number) > known:
            new = list(itertools.islice(number, known, None))
            self.held += sum(map(len, new))
            self._learn(new)
        at = np.array(places, dtype=np.int64)
        counts = self.counts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = np.empty(ends[-1], dtype=np.int32)
        for a in range(0, len(at), DECODED):
            part = slice(a, a + DECODED)
            ids[ends[a] : ends[min(a + DECODED, len(at))]] = self.ids[spread(self.first[at[part]], counts[part])]
        return ids, ends[sizes]


class Decoder:
    """Decodes ids: U+2581 as a space, byte pieces as bytes, control pieces as nothing, one leading space dropped.

    Bytes that aren't UTF-8 become U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary):
        parts = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") if u else b"" for p, u in zip(vocabulary.pieces, vocabulary.usable, strict=True)]
        for value, i in enumerate(vocabulary.byte_ids.tolist()):
            parts[i] = bytes([value])
        parts[vocabulary.unknown] = " ⁇ ".encode()
        self.counts = np.array([len(p) for p in parts], dtype=np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts of ids bounds[i] to bounds[i + 1], some together: what that takes doesn't grow with all of them."""
        out: list[bytes] = []
        while len(out) < len(bounds) - 1:
            a = len(out)
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + DECODED, side="right")) - 1)
            out += self._decode(ids[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        return out

    def _decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        counts = self.counts[ids]
        data = self.data[spread(self.first[ids], counts)].tobytes()
        ends = np.concatenate([[0], np.cumsum(counts)])[bounds].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, text: str) -> Iterator[pa.RecordBatch]:
    encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
    for batch in batches:
        for part in slices(batch, text):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            ids, bounds = encoder.encode(texts)
            back = decoder.decode(ids, bounds)
            same = [b == (t or "").encode() for b, t in zip(back, texts, strict=True)]
            crc = [zlib.crc32(ids[a:b].astype("<i4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            out = {"ids": lists, "n_pieces": pa.array(np.diff(bounds)), "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_())}
            yield pa.RecordBatch.from_arrays([*part.columns, *out.values()], names=[*part.schema.names, *out])


NEW = ("ids", "n_pieces", "ids_crc32", "round_trip")


def encode(docs: DataFrame, text: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """docs with ids (array of int), n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers) and round_trip.

    round_trip tells whether decoding gives the text back. Null and empty texts have no pieces, and round_trip true
    (null comes back as an empty text). Repeated rows get equal results; columns of docs with the new names are
    replaced; an empty table gives an empty table.
    """
    docs = docs.drop(*NEW)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    run = functools.partial(_encoded, vocabulary=vocabulary or load(), text=text)
    return docs.mapInArrow(run, f"{schema}, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean")


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, ids: str) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(vocabulary)
    for batch in batches:
        lists = [np.array(x if x is not None else [], dtype=np.int64) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        texts = decoder.decode(np.concatenate([*lists, np.empty(0, dtype=np.int64)]), bounds)
        yield batch.append_column("decoded", pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()))


def decode(rows: DataFrame, ids: str = "ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """rows with decoded, the text of the array of ids; null is taken as no ids. An id outside the vocabulary is an error."""
    rows = rows.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(functools.partial(_decoded, vocabulary=vocabulary or load(), ids=ids), f"{schema}, decoded string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids, their number and checksum, and whether decoding gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_pieces", "ids_crc32", "round_trip", F.col("ids"))
