"""Token-sort ratio (the public definition of the string scorer used by the
reference): both strings are split on whitespace, tokens sorted and
re-joined, and the score is 100·(1 − indel(a, b)/(len a + len b)) where
indel = len a + len b − 2·LCS(a, b).  (Levenshtein is *not* the same.)

``token_sort_ratio`` is a small per-pair helper; ``token_sort_ratio_udf`` is
its Arrow-batched pandas UDF for candidate pairs that Spark has already
blocked and partitioned.  It runs one dynamic programme over all pairs of a
chunk at once, after a bound from letter counts has dropped most of them.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

CELLS = 1 << 20  # letters of a chunk of pairs, padding included
BINS = 64


def _sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def _letters(texts: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, one row per text filled up with ``filler``; lengths)."""
    n = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(n.max(initial=0))), filler, np.uint32)
    inside = np.arange(out.shape[1]) < n[:, None]
    out[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, n


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of every pair.  A row of the
    usual table is a running maximum: each entry is the largest, so far in the
    row, of the entry above and the diagonal one plus a match."""
    x, _ = _letters(a, 0xFFFFFFFF)
    y, _ = _letters(b, 0xFFFFFFFE)
    row = np.zeros((len(a), x.shape[1] + 1), np.int32)
    for j in range(y.shape[1]):
        row[:, 1:] = np.maximum(row[:, 1:], row[:, :-1] + (x == y[:, j:j + 1]))
        np.maximum.accumulate(row, axis=1, out=row)
    return row[:, -1]


def _letter_bound(a: list[str], b: list[str]) -> np.ndarray:
    """At least the common subsequence of every pair: letters in common by
    count, told apart by code point modulo BINS."""
    def counts(texts):
        x, n = _letters(texts, 0)
        place = np.arange(len(texts))[:, None] * BINS + x % BINS
        return np.bincount(place[np.arange(x.shape[1]) < n[:, None]], minlength=len(texts) * BINS).reshape(-1, BINS)
    return np.minimum(counts(a), counts(b)).sum(axis=1)


def token_sort_ratios(a: list[str | None], b: list[str | None], threshold: float = 0.0) -> np.ndarray:
    """The ratio of every pair; 0 where it is known to be below ``threshold``."""
    out = np.zeros(len(a))
    known = {s: _sorted_tokens(s) for s in {*a, *b} if s is not None}
    pairs = [(i, known[x], known[y]) for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    pairs.sort(key=lambda p: max(len(p[1]), len(p[2])))
    while pairs:
        # the longest pair of a chunk sets its width; a pair alone may be wider
        take = max(1, min(len(pairs), CELLS // max(1, len(pairs[-1][1]), len(pairs[-1][2]))))
        pairs, part = pairs[:-take], pairs[-take:]
        at, x, y = (list(c) for c in zip(*part))
        total = np.array([len(s) + len(t) for s, t in zip(x, y)])
        score = np.where(total == 0, 100.0, 100.0 * (2 * _letter_bound(x, y)) / np.maximum(total, 1))
        left = np.flatnonzero((score >= threshold) & (total > 0))
        score[score < threshold] = 0.0
        if len(left):
            score[left] = 100.0 * (2 * common_subsequence([x[i] for i in left], [y[i] for i in left])) / total[left]
        out[at] = score
    return out


def token_sort_ratio(a: str | None, b: str | None) -> float:
    return float(token_sort_ratios([a], [b])[0])


def token_sort_ratio_udf(threshold: float = 0.0):
    """Column function of two strings: their ratio, 0 below ``threshold`` where
    letter counts already tell."""
    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(token_sort_ratios(a.tolist(), b.tolist(), threshold), dtype="float64")
    return ratio
