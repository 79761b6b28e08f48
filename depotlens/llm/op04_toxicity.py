"""Op 4, toxicity by a subsequence-kernel SVM with Nystroem landmarks.

Texts are read as symbols: letters without case (common digit and sign
stand-ins count as their letter), blank, other.  The kernel compares two
sentences (here windows of ``WINDOW`` symbols) by their common subsequences of
three symbols that span at most ``SPAN`` places; a subsequence weighs
DECAY ** (gaps), so a word still matches when characters are put between its
letters or some are left out.

Training uses a sample of labelled rows (at most ``PER_CLASS`` documents per
language and label, in the order of a hash of the id, each by its first
``SAMPLE_BYTES`` characters) and fits one model per language, so that a mark of
one language is held against clean documents of that language.  Sentences are
windows around words: toxic ones are those whose word begins with a mark, some
of them with inserted characters.  Marks are chosen one after another: the
stem, with the count from which on a document tells by it (1 to ``OFTEN``), of
the largest log-likelihood ratio between the toxic documents not yet covered
and the clean ones.  Clean sentences are random, plus, in ``ROUNDS`` rounds, the
windows of clean documents that score highest; words of clean documents that
begin with a mark by chance are left out.  ``LANDMARKS`` sentences give the
Nystroem map K(Z, Z) ** -1/2, on which a linear SVM (squared hinge) is fitted
on the driver.

Because a kernel value is linear in the subsequences of the scored text, the
map and the SVM fold into one table of weights per (symbol, symbol, symbol).
Two numbers are computed on the executors for every row and language: the
largest window sum and the sum of all windows above the SVM's boundary, so one
plain insult and several weak marks both count.  A logistic curve fitted to
the training documents turns them into a score; the largest one over the
languages is the document's.

Defined cases: null and empty texts score like a blank; null ids belong to
the training side's hash of ``null`` and are returned as null; rows may
repeat; without labelled rows of both classes every score is 0; no rows give
no rows; labels, lang, source and ids of a row never enter its score
(``lang`` only groups the training documents; without that column they are one
group, and so are the languages without a mark of their own).
"""
from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textnum as X
from .scratch import small_batches, table

WINDOW, SPAN, DECAY = 8, 6, 0.5
PER_CLASS, SAMPLE_BYTES, LANDMARKS, ROUNDS = 2000, 20_000, 320, 4
STEM = (4, 5, 6, 7, 8)  # a toxic word is known by its first bytes,
LEAST, OFTEN = 15.0, 4  # by this log-likelihood ratio, of documents that hold it 1 .. OFTEN times
SYMBOLS = 32
CLASS = np.full(256, 27, np.uint16)
CLASS[128:] = 28
CLASS[[0x20, *range(9, 14)]] = 0
for _i in range(26):
    CLASS[97 + _i] = CLASS[65 + _i] = _i + 1
for _c, _l in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.items():
    CLASS[ord(_c)] = ord(_l) - 96
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


@dataclass
class Part:
    weight: np.ndarray  # one per triple of symbols
    bias: float
    curve: np.ndarray  # of the largest window, the sum over all, and 1

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = np.clip(evidence(buf, off, self.weight, self.bias) @ self.curve[:2] + self.curve[2], -40, 40)
        return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    parts: list[Part]  # one per language

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.maximum.reduce([p.score(buf, off) for p in self.parts])


def triples(c: np.ndarray, gaps: tuple[int, int]) -> np.ndarray:
    """Code of the triple that starts at each position, for one pair of gaps."""
    a, b = gaps
    n = len(c) - a - b
    return (c[:n] << 10) | (c[a:a + n] << 5) | c[a + b:]


def features(symbols: np.ndarray) -> np.ndarray:
    """Weights of the subsequences that start in each row's window."""
    out = np.zeros((len(symbols), SYMBOLS ** 3), np.float32)
    row = np.arange(len(symbols))
    for a, b in GAPS:
        for i in range(WINDOW):
            code = (symbols[:, i].astype(np.int64) << 10) | (symbols[:, i + a].astype(np.int64) << 5) | symbols[:, i + a + b]
            np.add.at(out, (row, code), DECAY ** (a + b - 2))
    return out


def _window_sums(buf: np.ndarray, off: np.ndarray, weight: np.ndarray):
    """Sums of all windows, the first and the end of each text's, and the symbols."""
    n = np.diff(off)
    pad = WINDOW + SPAN
    noff = off + np.arange(len(off)) * pad + 1
    c = np.zeros(int(noff[-1]) + 2 * pad, np.uint16)
    c[np.arange(len(buf)) + np.repeat(np.arange(len(n)) * pad + 1, n)] = CLASS[buf]
    total = np.zeros(len(c), np.float64)
    for gap in range(2, SPAN):
        part = np.zeros(len(c) - gap, np.float32)
        for a, b in GAPS:
            if a + b == gap:
                part += weight[triples(c, (a, b))]
        total[:len(part)] += DECAY ** (gap - 2) * part
    sums = np.concatenate([[0.0], np.cumsum(total)])
    window = sums[WINDOW:] - sums[:-WINDOW]
    return window, noff[:-1] - 1, noff[:-1] + n, c


def _over(f: np.ufunc, window: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return f.reduceat(window, np.stack([start, ends], axis=1).ravel())[::2] if len(start) else np.zeros(0)


def evidence(buf: np.ndarray, off: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """Per text: the largest window margin (within -1 .. 1) and log(1 + the sum of the positive ones)."""
    window, start, ends, _ = _window_sums(buf, off, weight)
    window += bias
    best = _over(np.maximum, window, start, ends)
    return np.stack([np.clip(best, -1, 1), np.log1p(_over(np.add, np.maximum(window, 0, out=window), start, ends))], axis=1)


def margins(buf: np.ndarray, off: np.ndarray, weight: np.ndarray, where: bool = False):
    """Largest window sum of every text (and where it starts)."""
    window, start, ends, c = _window_sums(buf, off, weight)
    best = _over(np.maximum, window, start, ends)
    if not where:
        return best
    return best, np.array([a + int(np.argmax(window[a:max(z, a + 1)])) for a, z in zip(start, ends)]), c


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM by Newton steps on the active rows, classes of equal weight."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    c = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * cost * len(y)
    w = np.zeros(x.shape[1])
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ca = x[active], c[active]
        new = np.linalg.solve(reg + 2 * (xa * ca[:, None]).T @ xa, 2 * (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, rtol=1e-6, atol=1e-9):
            break
        w = 0.5 * (w + new)
    return w[:-1], float(w[-1])


def _windows(words: list[bytes], context: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Symbols of windows that hold a word after one place of its left text."""
    size = WINDOW + SPAN
    out = np.zeros((len(words), size), np.uint16)
    for i, (w, (left, right)) in enumerate(zip(words, context)):
        s = (left[-1:] + w + b" " + right)[:size].ljust(size)
        out[i] = CLASS[np.frombuffer(s, np.uint8)]
    return out


EDGE = np.zeros(256, bool)
EDGE[list(b".,;:!?\"'()*[]|-_")] = True


class Stems:
    """Words of some texts without signs at their edges, and all their stems."""

    def __init__(self, texts: list[bytes]):
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        w = X.Words(buf, self.off, lower=True)
        plain = np.flatnonzero(~EDGE[buf])
        a, z = np.searchsorted(plain, w.start), np.searchsorted(plain, w.end)
        some = z > a  # words of signs alone have no stem
        self.buf, self.doc = w.buf, w.doc[some]
        self.start, self.end = plain[a[some]], plain[z[some] - 1] + 1
        hasher = X.Hasher(self.buf, 0)
        at = [np.flatnonzero(self.end - self.start >= k) for k in STEM]
        self.word = np.concatenate(at)
        self.size = np.concatenate([np.full(len(i), k) for i, k in zip(at, STEM)])
        self.key = np.concatenate([hasher.slices(self.start[i], self.start[i] + k) for i, k in zip(at, STEM)])

    def held(self, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, document, times) of every stem, or of those in the sorted ``among``."""
        key, doc = self.key, self.doc[self.word]
        if among is not None:
            here = _within(among, key)
            key, doc = key[here], doc[here]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
        return key[first], doc[first], np.diff(np.append(first, len(key)))

    def marked(self, marks: np.ndarray) -> np.ndarray:
        """Words that begin with one of the sorted ``marks``."""
        return np.unique(self.word[_within(marks, self.key)])

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()

    def right(self, i: int) -> bytes:
        """What stands behind word ``i`` in its text, as far as a window reaches."""
        z = min(int(self.end[i]) + WINDOW + SPAN, int(self.off[self.doc[i] + 1]))
        return b" ".join(self.buf[self.end[i]:z].tobytes().split()).lstrip(b".,;:!?\"'()*[]|-_ ")


def _within(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _ratio(k1: np.ndarray, n1: int, k0: np.ndarray, n0: int) -> np.ndarray:
    """Log-likelihood ratio (G squared) of shares k1 / n1 > k0 / n0, else 0."""
    def term(a, e):
        return a * np.log(np.maximum(a, 1e-300) / np.maximum(e, 1e-300))
    share = (k1 + k0) / (n1 + n0)
    g = term(k1, n1 * share) + term(k0, n0 * share) + term(n1 - k1, n1 * (1 - share)) + term(n0 - k0, n0 * (1 - share))
    return np.where(k1 * n0 > k0 * n1, 2 * g, 0)


def _parts(texts: list[bytes], step: int = 64):
    """Stems of a few texts at a time, and the number of the first of them."""
    for a in range(0, len(texts), step):
        yield a, Stems(texts[a:a + step])


def _counts(texts: list[bytes], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, number of texts that hold each of them 1 .. OFTEN times)."""
    keys, total = np.zeros(0, X.U64) if among is None else among, None
    for _, s in _parts(texts):
        key, _, times = s.held(among)
        own, index = np.unique(key, return_inverse=True)
        n = np.stack([np.bincount(index[times >= m], minlength=len(own)) for m in range(1, OFTEN + 1)]).astype(np.int32)
        every = among if among is not None else np.union1d(keys, own)
        new = np.zeros((OFTEN, len(every)), np.int32)
        if total is not None:
            new[:, np.searchsorted(every, keys)] = total
        new[:, np.searchsorted(every, own)] += n
        keys, total = every, new
    return keys, total if total is not None else np.zeros((OFTEN, len(keys)), np.int32)


def _marks(bad: list[bytes], clean: list[bytes]) -> tuple[np.ndarray, bool]:
    """Sorted keys of the stems that tell toxic documents: again and again the
    one of the largest ratio among the documents not yet covered, then those
    that come with a chosen one (its companions, not its shorter forms); and
    whether the first one tells by standing there once."""
    n1, n0 = len(bad), len(clean)
    if not n1 or not n0:
        return np.zeros(0, X.U64), False
    keys, k1 = _counts(bad)
    able = (k1[0] >= 3) & (_ratio(k1[0], n1, 0 * k1[0], n0) >= LEAST)  # the most that its counts allow
    keys, k1 = keys[able], k1[:, able]
    k0 = _counts(clean, keys)[1]
    first = _ratio(k1, n1, k0, n0)
    able = first.max(0) >= LEAST if len(keys) else np.zeros(0, bool)
    keys, k0, first = keys[able], k0[:, able], first[:, able]
    if not len(keys):
        return keys, False
    held, shown = [], {}
    for a, s in _parts(bad):
        key, doc, times = s.held(keys)
        held.append((np.searchsorted(keys, key), doc + a, times))
        at = np.flatnonzero(_within(keys, s.key))
        for i in at[np.unique(s.key[at], return_index=True)[1]].tolist():
            begin = s.start[s.word[i]]
            shown[int(np.searchsorted(keys, s.key[i]))] = s.buf[begin:begin + s.size[i]].tobytes()
    index, doc, times = (np.concatenate(x) for x in zip(*held))
    chosen, once, open_ = [], False, np.ones(n1, bool)
    while True:
        live = open_[doc]
        k1 = np.stack([np.bincount(index[live & (times >= m)], minlength=len(keys)) for m in range(1, OFTEN + 1)])
        g = _ratio(k1, n1, k0, n0)
        best = g.max(0)
        i = max(np.flatnonzero(best >= best.max() - 1e-9).tolist(), key=lambda j: (len(shown[j]), shown[j]))
        m = int(np.argmax(g[:, i])) + 1
        if best[i] < LEAST or k1[m - 1, i] < 3:
            break
        once = once if chosen else m == 1
        chosen.append(i)
        open_[doc[(index == i) & (times >= m)]] = False
    if chosen:
        top = first.max(0)
        strong = np.flatnonzero(top >= max(LEAST, 0.3 * top[chosen].max()))
        for i in sorted(strong.tolist(), key=lambda j: -len(shown[j])):
            if not any(shown[j].startswith(shown[i]) for j in chosen):
                chosen.append(i)
    return keys[np.array(sorted(chosen), np.int64)], once


def fit(texts: list[bytes], toxic: np.ndarray, lang: list[str] | None = None, seed: int = 7) -> Model | None:
    """One part per language that has marks, and one for the other languages."""
    bad, clean = np.flatnonzero(toxic == 1), np.flatnonzero(toxic == 0)
    if not len(bad) or not len(clean):
        return None
    group = np.array(lang if lang is not None else [""] * len(texts), dtype=object)
    parts, rest = [], []
    for g in sorted(set(group[bad].tolist())):
        own = bad[group[bad] == g]
        marks, once = _marks([texts[i] for i in own], [texts[i] for i in clean[group[clean] == g]])
        if len(marks):
            parts.append(_fit_part(texts, own, clean, marks, once, seed))
        else:
            rest.append(own)
    if rest:
        own = np.sort(np.concatenate(rest))
        marks, once = _marks([texts[i] for i in own], [texts[i] for i in clean])
        if len(marks):
            parts.append(_fit_part(texts, own, clean, marks, once, seed))
    return Model(parts) if parts else None


def _fit_part(texts: list[bytes], bad: np.ndarray, clean: np.ndarray, marks: np.ndarray, once: bool, seed: int) -> Part:
    rng = np.random.default_rng(seed)
    toxic = [texts[i] for i in bad]
    held = [(a + int(s.doc[i]), *(int(x - s.off[s.doc[i]]) for x in (s.start[i], s.end[i])), s.text(i), s.right(i)) for a, s in _parts(toxic) for i in s.marked(marks).tolist()]
    at = rng.permutation(len(held))[:3000]
    words, ctx = [held[i][3] for i in at], [(b" ", held[i][4]) for i in at]
    for i in range(0, len(words), 6):
        words[i] = _disguised(words[i], i // 6, rng)
    good = _windows(words, ctx)
    blank = _blanked([texts[i] for i in clean], marks)

    def sample(n):
        out, right = [], []
        for _ in range(n):
            ws = X.LOWER[np.frombuffer(blank[int(rng.integers(len(blank)))], np.uint8)].tobytes().split() or [b" "]
            j = int(rng.integers(len(ws)))
            out.append(ws[j])
            right.append((b" ", b" ".join(ws[j + 1:j + 4])))
        return out, right

    rest = _windows(*sample(3000))
    for _ in range(ROUNDS):
        z = np.concatenate([good[rng.choice(len(good), min(len(good), LANDMARKS // 2), replace=False)], rest[-2000:][rng.choice(min(len(rest), 2000), LANDMARKS // 2, replace=False)]])
        fz = features(z)
        fz /= np.sqrt((fz ** 2).sum(1, keepdims=True)) + 1e-9
        value, vector = np.linalg.eigh((fz @ fz.T).astype(np.float64))
        root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T  # K(Z, Z) ** -1/2
        x = np.concatenate([_kernel(good, fz), _kernel(rest, fz)]) @ root
        y = np.concatenate([np.ones(len(good)), -np.ones(len(rest))])
        w, bias = _squared_hinge(x, y)
        weight = (root @ w @ fz).astype(np.float32)
        best, window = _swept(blank, weight)
        rest = np.concatenate([rest, window[np.argsort(-best)[:600]]])
    # logistic curve over the training documents
    if once:  # also with a single mark left
        toxic += _single(toxic, held, rng)
    x = np.concatenate([_evidence(part, weight, bias) for part in (toxic, [texts[i] for i in clean])])
    return Part(weight, bias, _logistic(x, np.repeat([1, 0], [len(toxic), len(clean)])))


def _disguised(w: bytes, mode: int, rng) -> bytes:
    """The word with inserted characters."""
    if len(w) < 2:
        return w
    if mode % 3 == 0:
        return bytes(bytearray(x for c in w for x in (c, 46)))[:-1]
    j = int(rng.integers(1, len(w)))
    return w[:j] + (bytes([int(rng.choice([45, 42, 46, 95]))]) if mode % 3 == 1 else w[j - 1:j]) + w[j:]


def _single(texts: list[bytes], held: list[tuple[int, int, int, bytes, bytes]], rng) -> list[bytes]:
    """The texts that hold marks with all but one of them blanked, that one
    disguised in every second text."""
    by: dict[int, list[tuple[int, int, bytes]]] = {}
    for d, a, z, word, _ in held:
        by.setdefault(d, []).append((a, z, word))
    out = []
    for n, (d, own) in enumerate(by.items()):
        t = bytearray(texts[d])
        for a, z, _ in own:
            t[a:z] = b" " * (z - a)
        a, z, word = own[int(rng.integers(len(own)))]
        t[a:z] = _disguised(word, n // 2, rng) if n % 2 else word
        out.append(bytes(t))
    return out


def _blanked(texts: list[bytes], marks: np.ndarray) -> list[bytes]:
    """The texts with blanks for the words that begin with a mark."""
    out = []
    for _, s in _parts(texts):
        i = s.marked(marks)
        buf = np.where(X.covered(len(s.buf), s.start[i], s.end[i]), 32, s.buf).astype(np.uint8)
        out += [buf[x:z].tobytes() for x, z in zip(s.off[:-1].tolist(), s.off[1:].tolist())]
    return out


def _evidence(texts: list[bytes], weight: np.ndarray, bias: float, step: int = 64) -> np.ndarray:
    parts = [texts[a:a + step] for a in range(0, len(texts), step)]
    return np.concatenate([evidence(np.frombuffer(b"".join(p), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in p])]), weight, bias) for p in parts])


def _swept(texts: list[bytes], weight: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Margin and best window of every text, a few texts at a time."""
    best, window = [], []
    for a in range(0, len(texts), step):
        part = texts[a:a + step]
        off = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        m, at, c = margins(np.frombuffer(b"".join(part), np.uint8), off, weight, where=True)
        best.append(m)
        window.append(np.stack([c[i:i + WINDOW + SPAN] for i in at]))
    return np.concatenate(best), np.concatenate(window)


def _kernel(symbols: np.ndarray, fz: np.ndarray, step: int = 128) -> np.ndarray:
    use = np.flatnonzero(fz.any(0))
    z = fz[:, use].T
    return np.concatenate([features(symbols[a:a + step])[:, use] @ z for a in range(0, len(symbols), step)]).astype(np.float64)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt's curve with his smoothed targets, classes as they come; more
    evidence never lowers a score."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for use in ([0, 1], [1], [0]):
        scale = np.maximum(x[:, use].std(0), 1e-9)
        a = np.concatenate([x[:, use] / scale, np.ones((len(x), 1))], axis=1)
        reg = np.diag([1e-2] * len(use) + [1e-6])
        w = np.zeros(len(use) + 1)

        def loss(w):
            z = a @ w
            return float((np.logaddexp(0, z) - t * z).sum() + w @ reg @ w / 2)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + reg, a.T @ (t - p) - reg @ w)
            size = 1.0
            while size > 1e-6 and loss(w + size * step) > loss(w):
                size /= 2
            w = w + size * step
            if np.abs(size * step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            break
    curve = np.zeros(3)
    curve[use] = np.maximum(w[:-1], 0) / scale
    curve[2] = w[-1]
    return curve


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a sample, bounded per language and label, of the rows of ``docs``
    that ``labels`` marks and whose crc32(id) mod 3 is not 1."""
    text = F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, SAMPLE_BYTES)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang")).filter(F.crc32(F.col("id").cast("string")) % 3 != 1)
    marks = labels.filter("toxic is not null").groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    rows = rows.join(marks, "id").filter("toxic in (0, 1)").withColumn("h", F.xxhash64("id"))
    # first the ids of the sample, then their texts, so that no other text moves
    kinds = sorted((r.lang, r.toxic) for r in rows.select("lang", "toxic").distinct().collect())
    chosen = {r.id: (int(r.toxic), r.lang) for g, k in kinds for r in rows.filter((F.col("lang") == g) & (F.col("toxic") == k)).orderBy("h", "id").limit(per_class).collect()}
    if not chosen:
        return None
    small_batches(docs.sparkSession)
    sample = docs.filter(F.col(id_col).isin(list(chosen))).select(F.col(id_col).cast("string").alias("id"), text.alias("text")).repartition(1)
    made = sample.mapInArrow(_fitted({str(k): v for k, v in chosen.items()}), "model binary").collect()
    return pickle.loads(made[0].model) if made else None


def _fitted(chosen: dict[str, tuple[int, str]]):
    """The fit over the bounded sample, in a task: the driver gets the model alone."""
    def run(batches):
        got = sorted((int(i), t) if i.lstrip("-").isdigit() else (i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        kinds = [chosen[str(i)] for i, _ in got]
        model = fit([t.encode() for _, t in got], np.array([k for k, _ in kinds], np.int64), [g for _, g in kinds])
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
    return run


def _scored(model: Model | None):
    def run(batches):
        for b in batches:
            for lo, hi, buf, off in X.chunks(X.text_column(b, "text")):
                s = model.score(buf, off) if model else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)), pa.array(s)], [*b.schema.names[:-1], "score"])
    return run


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % 3 == 1).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def with_scores(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """``docs`` with one column more, the score of its text; no row moves."""
    small_batches(docs.sparkSession)
    rows = docs.drop(name)

    def run(batches):
        for b in batches:
            parts = [model.score(buf, off) if model else np.zeros(hi - lo) for lo, hi, buf, off in X.chunks(X.text_column(b, text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], [*b.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
