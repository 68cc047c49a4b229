"""Token counts without tokens: a Viterbi search that carries best scores and piece counts only.

An Aho-Corasick automaton lists the pieces that end at each character of a word, longest first.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .pieces import Vocabulary, load, word_forms

#: Distinct words that a worker remembers; longer ones, as lines are where a script has no blanks, are counted anew.
REMEMBERED, LONGEST = 500_000, 100
_built: dict[tuple, ahocorasick.Automaton] = {}
_memos: dict[tuple, dict[str, int]] = {}


def automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    """Made once in each worker."""
    if vocabulary.name not in _built:
        made = ahocorasick.Automaton()
        for i in np.flatnonzero(vocabulary.usable).tolist():
            piece = vocabulary.pieces[i]
            made.add_word(piece, (len(piece), float(vocabulary.scores[i])))
        made.make_automaton()
        _built[vocabulary.name] = made
    return _built[vocabulary.name]


class Counter:
    """Counts with a memo that lives as long as the worker; when it is full, words that came first, mostly frequent ones, stay."""

    def __init__(self, vocabulary: Vocabulary):
        self.find = automaton(vocabulary).iter
        self.single = {p for p, u in zip(vocabulary.pieces, vocabulary.usable, strict=True) if u and len(p) == 1}
        self.unknown = vocabulary.unknown_score
        self.memo = _memos.setdefault(vocabulary.name, {})

    def word(self, word: str) -> int:
        """Pieces on the best path; ties go to the piece that starts earliest, sums are in double precision."""
        size = len(word)
        best, count = ([-math.inf] * (size + 1), [0] * (size + 1)) if size < 100_000 else (array("d", [-math.inf]) * (size + 1), array("q", [0]) * (size + 1))
        best[0] = 0.0
        if self.single.issuperset(word):
            for end, (length, score) in self.find(word):
                start = end + 1 - length
                reached = best[start] + score
                if reached > best[end + 1]:
                    best[end + 1] = reached
                    count[end + 1] = count[start] + 1
            return count[size]
        done = 0

        def uncovered(stop: int) -> None:
            """Steps over characters up to `stop` that no piece covers alone: as many pieces as bytes."""
            for k in range(done, stop):
                if word[k] not in self.single and best[k] + self.unknown > best[k + 1]:
                    best[k + 1], count[k + 1] = best[k] + self.unknown, count[k] + len(word[k].encode("utf-8", "surrogatepass"))

        for end, (length, score) in self.find(word):
            uncovered(end)
            done = max(done, end)
            start = end + 1 - length
            reached = best[start] + score
            if reached > best[end + 1]:
                best[end + 1], count[end + 1] = reached, count[start] + 1
        uncovered(size)
        return count[size]

    def text(self, text: str | None) -> int:
        memo, total = self.memo, 0
        for w in word_forms(text):
            n = memo.get(w)
            if n is None:
                n = self.word(w)
                if len(memo) < REMEMBERED and len(w) <= LONGEST:
                    memo[w] = n
            total += n
        return total


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, text: str) -> Iterator[pa.RecordBatch]:
    counter = Counter(vocabulary)
    for batch in batches:
        for part in slices(batch, text):
            n = [counter.text(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            yield part.append_column("n_tokens", pa.array(n, pa.int64()))


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """docs with n_tokens, the number of pieces of the best segmentation of the whole text.

    Null and empty texts have none. A character that no piece covers counts as many as its UTF-8 bytes. Repeated rows
    get equal results; a column n_tokens of docs is replaced; an empty table gives an empty table.
    """
    docs = docs.drop("n_tokens")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(functools.partial(_counted, vocabulary=vocabulary or load(), text=text), f"{schema}, n_tokens long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_tokens")
