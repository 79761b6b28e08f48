"""Unigram view of a public SentencePiece vocabulary, shared by ops 1, 6 and 7.

The vocabulary file gives pieces and scores; no tokenizer is trained.  A text
is marked as the library does: one space in front, every space a U+2581.  No
piece continues over a space that follows another character, nor over a
tab or line feed (checked when loading), so a text is cut into *marked
words* there, and each distinct marked word is segmented once per worker and
kept in a bounded cache.
"""
from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

from . import textnum as X

MARK = "▁"
UNK_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()  # goes when the columns below are taken
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.normal = {p: i for i, p in enumerate(self.pieces) if kinds[i] in (1, 4)}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == 6}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces for characters it lacks")
        if any(MARK in p.lstrip(MARK) or "\t" in p or "\n" in p for p in self.normal):
            raise ValueError("a piece runs over white space; texts cannot be cut to words")
        self.unk_score = min(self.scores[i] for i in self.normal.values()) - UNK_PENALTY
        self.single = {p for p in self.normal if len(p) == 1}
        self.surface = [b""] * len(self.pieces)
        for p, i in self.normal.items():
            self.surface[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.surface[i] = bytes([b])


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def marked_words(buf: np.ndarray, off: np.ndarray):
    """Byte ranges of the marked words of a chunk of texts: (bytes with a space
    in front of every text, start, end, text index).  U+2581 in a text is a
    word of its own."""
    n = np.diff(off)
    lead = (n > 0).astype(np.int64)
    noff = off + np.concatenate([[0], np.cumsum(lead)])
    out = np.full(int(noff[-1]), 0x20, np.uint8)
    shift = np.repeat(np.cumsum(lead), n)
    out[np.arange(len(buf)) + shift] = buf
    space = out == 0x20
    control = (out == 9) | (out == 10)
    begin = control.copy()
    begin[1:] |= control[:-1] | (space[1:] & ~space[:-1])
    literal = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x96) & (out[2:] == 0x81)) if len(out) > 2 else np.zeros(0, np.int64)
    begin[literal] = True
    begin[literal[literal + 3 < len(out)] + 3] = True
    begin[noff[:-1][n > 0]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(out)) if len(start) else start
    return out, start, end, np.searchsorted(noff, start, side="right") - 1


class WordCache:
    """Results of distinct words, by hash: at most ``limit`` words and
    ``most_ids`` ids, then anew.

    ``solve(words)`` returns one tuple of numbers per word and, optionally, a
    list of ids per word; a batch never evicts its own words."""

    def __init__(self, solve: Callable[[list[bytes]], tuple[np.ndarray, list[list[int]] | None]], limit: int = 1 << 18, most_ids: int = 1 << 22):
        self.solve, self.limit, self.most_ids = solve, limit, most_ids
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.values = np.zeros((0, 0))
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def lookup(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(distinct hash index of each word, cache slot of each distinct word)."""
        h = X.Hasher(buf, 0).slices(start, end)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slot) > self.limit or len(self.flat) > self.most_ids:
            self.clear()
        keys = uniq.tolist()
        get = self.slot.get
        slots = np.array([get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            data = buf.tobytes()
            at = first[new]
            words = [data[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())]
            order = sorted(range(len(words)), key=words.__getitem__)
            numbers, ids = self.solve([words[i] for i in order])
            base = len(self.slot)
            for j, i in enumerate(order):
                k = int(new[i])
                self.slot[keys[k]] = base + j
                slots[k] = base + j
            self.values = numbers if base == 0 else np.concatenate([self.values, numbers])
            if ids is not None:
                self.flat = np.concatenate([self.flat, np.array([x for w in ids for x in w], np.int32)])
                self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(w) for w in ids])])
        return inverse, slots


_CACHES: dict[tuple, WordCache] = {}


def worker_cache(name: str, path: str, make: Callable[[Vocabulary], Callable]) -> WordCache:
    """One cache per Python worker, model and operator."""
    key = (name, path)
    if key not in _CACHES:
        _CACHES[key] = WordCache(make(vocabulary(path)))
    return _CACHES[key]
