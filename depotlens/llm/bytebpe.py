"""Encoding of whole texts with a byte-level BPE tokenizer of the tokenizers library.

The library takes a text apart by a pattern before it merges bytes, so a text
may be cut wherever no pattern token crosses and no match before or after
depends on the other side.  Texts are cut (vectorised, over many at once) into
such pieces, and the library encodes each distinct piece once per worker.

Cut points: before white space that follows a visible character; after a lone
control white space; between a letter or digit and ASCII punctuation, either
way, and between ASCII letters and digits.  Never next to an apostrophe
(contractions), after Unicode spaces or control characters, and only the first
kind in chunks that spell out a special token of the vocabulary.
"""
from __future__ import annotations

import os

import numpy as np

from .textnum import U64, mix

OTHER, LETTER, DIGIT, SPACE, PUNCT, QUOTE, CONTROL = range(7)
CLASS = np.zeros(256, np.uint8)
CLASS[:0x20] = CONTROL
CLASS[0x7F] = CONTROL
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[0x21:0x7F] = PUNCT
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER
CLASS[0x27] = QUOTE
LONG = 64
SLOTS = 1 << 21


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves,
    the other bytes for the characters from U+0100 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def latin_letters(buf: np.ndarray) -> np.ndarray:
    """Mask of the last bytes of the two-byte letters of Latin-1 and Latin Extended."""
    out = np.zeros(len(buf), bool)
    out[1:] = (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC9) & ~((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
    return out


def cuts(buf: np.ndarray, off: np.ndarray, coarse: bool) -> np.ndarray:
    """First byte of every piece; ``off`` bounds the texts in ``buf``."""
    n = len(buf)
    kind = CLASS[buf]
    a, b = kind[:-1], kind[1:]
    latin = latin_letters(buf)
    word = (kind == LETTER) | (kind == DIGIT) | latin
    # any other character beyond ASCII that could be a Unicode space
    odd = np.zeros(n, bool)
    odd[1:] = (buf[:-1] == 0xC2) & ((buf[1:] == 0x85) | (buf[1:] == 0xA0))
    odd[2:] |= (buf[:-2] == 0xE2) & ((buf[1:-1] == 0x80) | (buf[1:-1] == 0x81)) | (buf[:-2] == 0xE3) & (buf[1:-1] == 0x80) | (buf[:-2] == 0xE1) & ((buf[1:-1] == 0x9A) | (buf[1:-1] == 0xA0))
    visible = (kind != SPACE) & (kind != CONTROL) & ~odd
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    start = first[:n].copy()
    space = b == SPACE
    start[1:] |= space & visible[:-1]
    if not coarse:
        start[1:] |= (b == PUNCT) & word[:-1]
        start[1:] |= (a == PUNCT) & ((b == LETTER) | (b == DIGIT))
        start[1:] |= (a == LETTER) & (b == DIGIT) | (a == DIGIT) & (b == LETTER)
        alone = (kind == SPACE) & (buf != 0x20)
        alone[1:] &= visible[:-1] | first[1:n]
        start[1:] |= alone[:-1] & ((b == LETTER) | (b == DIGIT) | (b == PUNCT))
    return np.flatnonzero(start)


def piece_hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every piece of at most LONG bytes (0 is not used)."""
    padded = np.zeros(len(buf) + LONG + 8, np.uint8)
    padded[:len(buf)] = buf
    eight = np.ndarray((len(buf) + LONG + 1,), "<u8", padded.data, 0, (1,))  # the 8 bytes from every position
    keep = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2 ** 64 - 1], U64)
    x = eight[start] & keep[np.minimum(size, 8)]
    one = mix(x * U64(0x9E3779B97F4A7C15) + size.astype(U64))
    two = mix(x + size.astype(U64) * U64(0xD6E8FEB86659FD93))
    left = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(left):
        x = eight[start[left] + at] & keep[np.minimum(size[left] - at, 8)]
        one[left] = mix((one[left] ^ x) * U64(0x9E3779B97F4A7C15))
        two[left] = mix(two[left] * U64(0xA0761D6478BD642F) + x)
        at += 8
        left = left[size[left] > at]
    return np.where(one == 0, U64(1), one), two


class PieceCache:
    """Open addressing over piece hashes; an entry is a slice of ``flat``.
    Cleared when half full, so its size is bounded."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.one = np.zeros(SLOTS, U64)
        self.two = np.zeros(SLOTS, U64)
        self.entry = np.zeros(SLOTS, np.int32)
        self.begin = np.zeros(SLOTS // 2 + 2, np.int64)
        self.size = np.zeros(SLOTS // 2 + 2, np.int32)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = self.entries = 0

    def add(self, ids: list[list[int]]) -> np.ndarray:
        """Store id lists; their entry numbers."""
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(size.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.uint32)])
        self.flat[self.used:self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        number = np.arange(self.entries, self.entries + len(ids))
        if number.size and number[-1] >= len(self.size):
            grow = max(len(ids), len(self.size))
            self.begin, self.size = np.concatenate([self.begin, np.zeros(grow, np.int64)]), np.concatenate([self.size, np.zeros(grow, np.int32)])
        self.begin[number] = self.used + np.cumsum(size) - size
        self.size[number] = size
        self.used, self.entries = self.used + total, self.entries + len(ids)
        return number

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Entry of every hash pair, -1 where unknown."""
        at = (one & U64(SLOTS - 1)).astype(np.int64)
        have = self.one[at]
        found = np.where((have == one) & (self.two[at] == two), self.entry[at], -1)
        left = np.flatnonzero((found < 0) & (have != 0))
        while len(left):
            at[left] = (at[left] + 1) & (SLOTS - 1)
            p = at[left]
            same = (self.one[p] == one[left]) & (self.two[p] == two[left])
            found[left[same]] = self.entry[p[same]]
            left = left[~same & (self.one[p] != 0)]
        return found

    def put(self, one: np.ndarray, two: np.ndarray, entry: np.ndarray) -> None:
        """Insert distinct new pairs."""
        left, at = np.arange(len(one)), (one & U64(SLOTS - 1)).astype(np.int64)
        while len(left):
            p = at[left]
            free = np.flatnonzero(self.one[p] == 0)
            _, which = np.unique(p[free], return_index=True)
            took = left[free[which]]
            self.one[at[took]], self.two[at[took]], self.entry[at[took]] = one[took], two[took], entry[took]
            left = np.setdiff1d(left, took, assume_unique=True)
            at[left] = (at[left] + 1) & (SLOTS - 1)


class Encoder:
    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4  # bytes an id takes
        self.alphabet = byte_alphabet()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id = end_id
        self.cache = PieceCache()
        self.cache.add([[end_id]])

    def encode_pieces(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """Ids of pieces.  Letters, digits or punctuation alone, perhaps after
        one space, are one token of the pattern: merges alone encode them."""
        ends = np.cumsum(size)
        begin = ends - size
        data = buf[np.repeat(start - begin, size) + np.arange(int(ends[-1]))]
        kind, latin = CLASS[data], np.flatnonzero(latin_letters(data))
        kind[latin] = kind[latin - 1] = LETTER
        body = begin + ((data[begin] == 0x20) & (size > 1))
        kind[begin[body > begin]] = kind[body[body > begin]]
        low, high = np.minimum.reduceat(kind, begin), np.maximum.reduceat(kind, begin)
        one_kind = (low == high) & ((low == LETTER) | (low == DIGIT) | (low == PUNCT)) | (size == 1) & (low == SPACE)
        raw = data.tobytes()
        letters = raw.decode("latin-1").translate(self.alphabet)
        tokenize, out, rest = self.model.tokenize, [], []
        for i, (a, z, simple) in enumerate(zip(begin.tolist(), ends.tolist(), one_kind.tolist())):
            if simple:
                out.append([t.id for t in tokenize(letters[a:z])])
            else:
                out.append(None)
                rest.append((i, raw[a:z].decode()))
        for lo in range(0, len(rest), 256):
            some = rest[lo:lo + 256]
            for (i, _), e in zip(some, self.tokenizer.encode_batch_fast([s for _, s in some], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text), the end id behind every text."""
        n = len(off) - 1
        if self.cache.entries > SLOTS // 2:
            self.cache.clear()
            self.cache.add([[self.end_id]])
        if not len(buf):
            return np.full(n, self.end_id, np.uint32), np.ones(n, np.int64)
        raw = buf.tobytes()
        start = cuts(buf, off, any(s in raw for s in self.specials))
        size = np.diff(start, append=len(buf))
        one, two = piece_hashes(buf, start, size)
        entry = self.cache.find(one, two).astype(np.int64)
        long = np.flatnonzero(size > LONG)
        entry[long] = -1
        new = np.flatnonzero((entry < 0) & (size <= LONG))
        if len(new):
            _, index, inverse = np.unique(one[new], return_index=True, return_inverse=True)
            pick = new[index]
            alike = two[new] == two[pick][inverse]
            long = np.concatenate([long, new[~alike]])  # equal in one hash only: not kept
            added = self.cache.add(self.encode_pieces(buf, start[pick], size[pick]))
            self.cache.put(one[pick], two[pick], added)
            entry[new] = added[inverse]
        used, entries = self.cache.used, self.cache.entries
        if len(long):
            entry[long] = self.cache.add(self.encode_pieces(buf, start[long], size[long]))
        piece_off = np.searchsorted(start, off)
        entry = np.insert(entry, piece_off[1:], 0)
        sizes = self.cache.size[entry].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.cache.flat[np.repeat(self.cache.begin[entry] - (ends - sizes), sizes) + np.arange(ends[-1])]
        self.cache.used, self.cache.entries = used, entries  # long pieces are not kept
        upto = np.concatenate([[0], ends])[piece_off + np.arange(n + 1)]
        return ids, np.diff(upto)
