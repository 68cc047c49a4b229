"""Language identification by string kernels.

A text is the set of its 1-, 2- and 3-byte n-grams (a blended spectrum, by presence); the kernel of two texts is the
number of n-grams they share, over the geometric mean of their numbers, averaged over the three lengths. Landmarks span
the feature space (Nystroem), one-versus-rest ridge regression is solved there, and a batch of texts is scored by two
matrix products.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column_name, slices, unit_hash

#: Bounds of what is learned from: labelled texts and landmarks for each language, and both in all.
SAMPLE, LANDMARKS, SAMPLE_ALL, LANDMARKS_ALL = 150, 24, 4000, 240
#: Languages that a model knows at most.
LANGUAGES = 1000
#: Numbers (n-grams x landmarks) that a model holds at most; beyond, only the first landmark of each language is taken.
NUMBERS = 16_000_000
RIDGE = 1e-2
SHARPNESS = 6.0
UNKNOWN = "und"
BATCH = 256
#: n-grams of one and two bytes have numbers of their own, those of three are hashed.
_TWO, _THREE, WIDTH = 1 << 8, (1 << 8) + (1 << 16), (1 << 8) + (1 << 16) + (1 << 18)
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32


def grams(text: bytes) -> np.ndarray:
    """The numbers of the n-grams that the whole text has, ascending."""
    b = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    flags = np.zeros(WIDTH, dtype=bool)
    flags[b] = True
    if len(b) > 1:
        two = (b[:-1] << np.uint32(8)) | b[1:]
        flags[two + np.uint32(_TWO)] = True
        if len(b) > 2:
            three = ((two[:-1] << np.uint32(8)) | b[2:]) * np.uint32(0x9E3779B1)
            flags[(three >> np.uint32(14)) + np.uint32(_THREE)] = True
    return np.flatnonzero(flags).astype(np.int32)


def scales(found: np.ndarray) -> np.ndarray:
    """What each n-gram of a text weighs in its kernels: 1 / sqrt(how many of its length there are)."""
    at = np.searchsorted(found, [_TWO, _THREE])
    sizes = np.diff([0, *at, len(found)])
    return np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes).astype(np.float32)


@dataclass
class Model:
    """languages; number (WIDTH): place of an n-gram among those of landmarks, or -1; landmarks (n-grams x landmarks); weights (landmarks x languages)."""

    languages: list[str]
    number: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, found: list[np.ndarray]) -> np.ndarray:
        batch = np.zeros((len(found), len(self.landmarks)), dtype=np.float32)
        for row, idx in zip(batch, found, strict=True):
            at = self.number[idx]
            row[at[at >= 0]] = scales(idx)[at >= 0]
        return batch @ self.landmarks

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        return self.kernel(found) @ self.weights


def fit(found: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression, one language against the rest, in the space that the landmarks span.

    found and langs come in an order that doesn't depend on the run; the first `landmarks` texts of each language are
    the landmarks, or as many of these in turn as NUMBERS allows.
    """
    languages = sorted(set(langs))
    each = max(1, min(landmarks, LANDMARKS_ALL // max(1, len(languages))))
    by_lang = {lang: [k for k, x in enumerate(langs) if x == lang][:each] for lang in languages}
    taken: dict[str, int] = dict.fromkeys(languages, 0)
    flags, n = np.zeros(WIDTH, dtype=bool), 0
    for turn in range(each):
        for lang in languages:
            if turn < len(by_lang[lang]):
                more = int((~flags[found[by_lang[lang][turn]]]).sum())
                if turn == 0 or (int(flags.sum()) + more) * (n + 1) <= NUMBERS and taken[lang] == turn:
                    flags[found[by_lang[lang][turn]]] = True
                    taken[lang], n = turn + 1, n + 1
    chosen = [i for lang in languages for i in by_lang[lang][: taken[lang]]]
    vocabulary = np.unique(np.concatenate([found[i] for i in chosen])) if chosen else np.empty(0, dtype=np.int32)
    number = np.full(WIDTH, -1, dtype=np.int32)
    number[vocabulary] = np.arange(len(vocabulary))
    columns = np.zeros((len(vocabulary), len(chosen)), dtype=np.float32)
    for c, i in enumerate(chosen):
        columns[number[found[i]], c] = scales(found[i]) / 3
    model = Model(languages, number, columns, np.zeros((len(chosen), len(languages)), dtype=np.float32))
    if len(languages) > 1:
        to_marks = np.concatenate([model.kernel(found[a : a + BATCH]) for a in range(0, len(found), BATCH)]).astype(float)
        values, vectors = np.linalg.eigh(to_marks[chosen])
        strong = values > 1e-6 * values.max()
        root = vectors[:, strong] / np.sqrt(values[strong])
        features = to_marks @ root
        wanted = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in langs])
        inner = features.T @ features + ridge * len(langs) * np.eye(features.shape[1])
        model.weights = (root @ np.linalg.solve(inner, features.T @ wanted)).astype(np.float32)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [grams(t or b"").tobytes() for t in as_bytes(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["lang", "u", "found"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text, lang), all of which may be learned from.

    A sample bounded by SAMPLE for each language and by SAMPLE_ALL in all, chosen by a hash of doc_id, is looked at;
    only the LANGUAGES most frequent languages are learned, so that what reaches the driver is bounded where `lang` is dirty;
    of rows that repeat an id so often that more are drawn, those that come first by hash and text.
    """
    docs = docs.filter("lang is not null and text is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    each = max(2, min(sample, SAMPLE_ALL // max(1, len(counts))))
    if not counts:
        return fit([], [])
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 2 * each / n + 20 / n)) for k, n in counts.items()], "lang string, share double")
    drawn = docs.join(F.broadcast(shares), "lang").withColumn("u", unit_hash("language", F.col("doc_id"))).filter("u < share")
    rows = drawn.select("lang", "u", "text").mapInArrow(_features, "lang string, u double, found binary")
    rows = rows.orderBy("u", F.xxhash64("found")).limit(4 * SAMPLE_ALL + 100 * len(counts)).collect()
    rows.sort(key=lambda r: (r["u"], r["found"]))
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in rows:
        if seen[r["lang"]] < each:
            seen[r["lang"]] += 1
            kept.append(r)
    return fit([np.frombuffer(r["found"], dtype=np.int32) for r in kept], [r["lang"] for r in kept])


def _predicted(batches: Iterator[pa.RecordBatch], model: Model, text: str, letters: str) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            batch = whole.slice(start, BATCH)
            texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
            lettered = np.array(batch.column(batch.schema.get_field_index(letters)).to_pylist(), dtype=bool)
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if model.languages and lettered.any():
                at = np.flatnonzero(lettered)
                raw = SHARPNESS * model.scores([grams(texts[i]) for i in at]).astype(float)
                chances = np.exp(raw - raw.max(axis=1, keepdims=True))
                chances /= chances.sum(axis=1, keepdims=True)
                best[at], score[at] = chances.argmax(axis=1), chances.max(axis=1)
            rest = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != letters]
            kept = [n for n in batch.schema.names if n != letters]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id (keep: all columns of docs), lang_pred, score for every row of docs, from the text alone.

    Null texts and texts without a letter get `und` and score 0, and so does everything if nothing could be learned.
    Ties go to the language that comes first. Repeated rows get equal results; columns of docs named lang_pred or score
    are replaced; an empty table gives an empty table. The model, whose size is bounded, goes with the function to the
    tasks.
    """
    docs = docs.drop("lang_pred", "score") if keep else docs.select(doc_id, text)
    letters = column_name(docs, "letters")
    source = docs.withColumn(letters, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = source.mapInArrow(functools.partial(_predicted, model=model, text=text, letters=letters), f"{schema}, lang_pred string, score double")
    return out if keep else out.select(doc_id, "lang_pred", "score")


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = remainder(F.col("doc_id"), 4)
    model = learn(docs.filter(fold != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
