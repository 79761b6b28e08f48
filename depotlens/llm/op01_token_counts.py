"""Op 1, token counts without tokens: count-only Viterbi over Aho-Corasick matches.

An Aho-Corasick automaton of the unigram vocabulary enumerates every piece
that ends at each character of a marked word.  Dynamic programming carries
only the best score and its number of pieces per position.  Ties follow the
tokenizer: of equal scores the piece that starts first (the longest last
piece) wins.  A character without a piece of its own may stand as unknown at
the lowest score - 10 and then counts one token per UTF-8 byte.

Defined cases: null and empty texts have 0 tokens and score 0; U+2581 counts
as three byte tokens; ids may be null or repeat (one result row per row);
no rows give no rows; further columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X
from .scratch import small_batches, table
from .unigram import MARK, Vocabulary, default_model, marked_words, worker_cache

NONE = -float("inf")


def count_word(word: str, matches, single: set[str], unk_score: float) -> tuple[int, float]:
    """(pieces, score) of the best segmentation of one marked word.

    ``matches(word)`` yields (end index, (length, score)), longest first at
    each end, so that a strict comparison keeps the earliest start."""
    n = len(word)
    best, count = [0.0] + [NONE] * n, [0] * (n + 1)
    if single.issuperset(word):
        for end, (size, score) in matches(word):
            end += 1
            new = best[end - size] + score
            if new > best[end]:
                best[end] = new
                count[end] = count[end - size] + 1
        return count[n], best[n]
    at: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for end, m in matches(word):
        at[end + 1].append(m)
    for end in range(1, n + 1):
        for size, score in at[end]:
            new = best[end - size] + score
            if new > best[end]:
                best[end], count[end] = new, count[end - size] + 1
        c = word[end - 1]
        if c not in single and best[end - 1] + unk_score > best[end]:
            best[end], count[end] = best[end - 1] + unk_score, count[end - 1] + len(c.encode())
    return count[n], best[n]


def solver(v: Vocabulary):
    import ahocorasick
    auto = ahocorasick.Automaton()
    for piece, i in v.normal.items():
        auto.add_word(piece, (len(piece), v.scores[i]))
    auto.make_automaton()
    literal = MARK.encode()

    def solve(words: list[bytes]):
        out = np.zeros((len(words), 2))
        for i, w in enumerate(words):
            if w == literal:
                out[i] = 3, v.unk_score
            else:
                out[i] = count_word(w.decode().replace(" ", MARK), auto.iter, v.single, v.unk_score)
        return out, None
    return solve


def _counts(path: str):
    def run(batches):
        cache = worker_cache("count", path, solver)
        for b in batches:
            texts = X.text_column(b, "text")
            n, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for lo, hi, buf, off in X.chunks(texts):
                data, start, end, doc = marked_words(buf, off)
                inverse, slots = cache.lookup(data, start, end)
                if len(start):
                    value = cache.values[slots][inverse]
                    n[lo:hi] = np.bincount(doc, value[:, 0], hi - lo).astype(np.int64)
                    score[lo:hi] = np.bincount(doc, value[:, 1], hi - lo)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n), pa.array(score)], ["doc_id", "n_tokens", "score"])
    return run


def token_counts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, score (sum of piece scores)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counts(model or default_model()), "doc_id long, n_tokens long, score double")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
