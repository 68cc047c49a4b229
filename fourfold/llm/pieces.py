"""The vocabulary of a SentencePiece model as a unigram model, and the normalised text that it is matched against.

A model file's pieces and scores are read on the driver and go to the tasks with the function that uses them, so no
task opens a file. Text is normalised as the file says (identity, a leading space, spaces written as U+2581); no piece
goes on over a space into the next word and none of several characters holds a line feed, so the best path of a text is
made of the best paths of its words.

Scores of a BPE model are ranks with a minus, so its best path is that with the smallest sum of ranks: not the merges
that the model's own encoder makes. The library gives the same pieces when the file's type is set to unigram, as far as
its single precision and its pruning go.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import numpy as np

from .common import mix

SPACE = "▁"
#: Path of the model file; a parameter of the environment.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
UNKNOWN_PENALTY = 10.0
WORD_FORM = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
_BASE = 0x9E3779B97F4A7C15
_FILTER_BITS = 21


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    longest: int
    keys: np.ndarray = field(repr=False)
    key_ids: np.ndarray = field(repr=False)
    seen: np.ndarray = field(repr=False)

    @property
    def name(self) -> tuple:
        return (len(self.pieces), float(self.scores.sum()), self.pieces[-1])


def piece_key(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length * 0x51ED270B % (1 << 63)))


def _key(piece: str) -> np.uint64:
    total = 0
    for c in piece:
        total = (total * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return piece_key(np.array([total], dtype=np.uint64), len(piece))[0]


def build(pieces: list[str], scores: list[float], usable: list[bool], byte_ids: list[int], unknown: int) -> Vocabulary:
    """A vocabulary from its parts; usable: pieces that text is matched with; byte_ids: the pieces of the 256 bytes."""
    if any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and len(p) > 1) for p, u in zip(pieces, usable, strict=True) if u):
        raise ValueError("pieces that go on over a space or hold a line feed are not supported")
    if len(byte_ids) != 256:
        raise ValueError("a model with byte fallback is needed")
    values = np.array(scores, dtype=np.float32)
    mask = np.array(usable, dtype=bool)
    ids = np.flatnonzero(mask)
    keys = np.array([_key(pieces[i]) for i in ids], dtype=np.uint64)
    order = np.argsort(keys)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two pieces have one key")
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
    return Vocabulary(pieces, values, mask, np.array(byte_ids, dtype=np.int32), unknown, float(values[mask].min()) - UNKNOWN_PENALTY, max(len(pieces[i]) for i in ids), keys[order], ids[order].astype(np.int32), seen)


def check_model(sp) -> None:
    """Raise if a model's file asks for more than is done here: another type, another normalisation, pieces of its user's."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sp.serialized_model_proto())
    kind, norm = proto.trainer_spec, proto.normalizer_spec
    if kind.model_type not in (kind.UNIGRAM, kind.BPE):
        raise ValueError("only models of the types unigram and BPE have pieces with scores to search by")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or kind.treat_whitespace_as_suffix:
        raise ValueError("only models are supported that leave text as it is but for a leading space and spaces as U+2581")
    if any(p.type == p.USER_DEFINED for p in proto.pieces):
        raise ValueError("models with user-defined pieces are not supported")


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a model file, read on the driver; an error if the file asks for what is not done here."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or MODEL)
    check_model(sp)
    n = sp.get_piece_size()
    usable = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    return build([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], usable, [i for i in range(n) if sp.is_byte(i)], sp.unk_id())


def word_forms(text: str | None) -> list[str]:
    """The words of the normalised text: runs of spaces with what follows them, up to the next space or line feed."""
    if not text:
        return []
    return WORD_FORM.findall(SPACE + text.replace(" ", SPACE))


def probe(vocabulary: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (or -1) and scores of all substrings of equally long words, each word a row of code points.

    Both have the shape (words, start, length - 1), for lengths up to the longest piece.
    """
    n, size = points.shape
    most = min(size, vocabulary.longest)
    ids = np.full((n, size, most), -1, dtype=np.int32)
    values = points.astype(np.uint64) + np.uint64(1)
    sums = np.zeros((n, size), dtype=np.uint64)
    for length in range(1, most + 1):
        width = size - length + 1
        sums = sums[:, :width] * np.uint64(_BASE) + values[:, length - 1 :]
        keys = piece_key(sums, length)
        maybe = np.nonzero(vocabulary.seen[keys >> np.uint64(64 - _FILTER_BITS)])
        wanted = keys[maybe]
        at = np.minimum(np.searchsorted(vocabulary.keys, wanted), len(vocabulary.keys) - 1)
        hit = vocabulary.keys[at] == wanted
        ids[maybe[0][hit], maybe[1][hit], length - 1] = vocabulary.key_ids[at[hit]]
    scores = vocabulary.scores[ids]  # single precision, as in the file; sums of them are made in double
    scores[ids < 0] = -np.inf
    return ids, scores
