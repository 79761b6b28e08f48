"""Op 7, LM scoring by the likelihood of a subword lattice.

A text is its words, each with a space in front, then an end mark.  The
probability of a word is the sum over every segmentation into pieces of a
public vocabulary (and the 256 single bytes), by a forward recursion in log
space.  The weights start from the vocabulary's scores (BPE ranks, read as
1 / (1 + rank)) and are fitted by expectation-maximisation over all distinct
training words; expected piece counts are summed in Spark, and only that
vector (one number per vocabulary piece) reaches the driver.  A word seen c
times in training has one arc more, over the whole word, of weight
(c - DISCOUNT) / N; the discounted mass weighs the subword paths:

    p(word) = max(c - DISCOUNT, 0) / N + DISCOUNT * kinds / N * lattice(word)
    p(end)  = training texts / N

The base score is the add-one unigram model over whole words.  Counts of the
most frequent words (at most ``HEAD``, a fixed bound) travel with the tasks;
all other words meet their counts in a join.

Defined cases: null and empty texts are the end mark alone; null ids are
hashed as the text ``null`` and returned as null; repeated rows are separate
texts; no rows give no rows; without training rows N is 0 and the piece
weights are the vocabulary's own (an end is then given 0.5); further columns are ignored.
"""
from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X
from .scratch import cut, small_batches, table
from .unigram import default_model, vocabulary

HEAD = 100_000
ROUNDS = 3
ALPHA = 0.01  # added to every expected count
DISCOUNT = 0.75  # of every training word's count, given to the subword paths
LOG10 = math.log(10)


class Lattice:
    """Pieces as byte strings with a hash index; weights are passed in."""

    def __init__(self, path: str):
        v = vocabulary(path)
        rank: dict[bytes, float] = {bytes([b]): 1e6 for b in range(256)}
        for p, i in v.normal.items():
            rank[v.surface[i]] = min(rank.get(v.surface[i], 1e9), -v.scores[i] if v.scores[i] > -1e8 else 1e6)
        self.pieces = [p for p in rank if b" " not in p[1:]]
        start = np.array([1 / (1 + rank[p]) for p in self.pieces])
        self.start = np.log(start / start.sum())
        self.longest = max(map(len, self.pieces))
        size = np.array([len(p) for p in self.pieces])
        flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        end = np.cumsum(size)
        keys = X.Hasher(flat, 0).slices(end - size, end)
        # two direct tables; what collides in both stays in a short sorted list
        self.first, self.second = np.full(1 << 18, -1, np.int32), np.full(1 << 18, -1, np.int32)
        self.keys, rest = np.append(keys, X.U64(0)), []
        for i, k in enumerate(keys.tolist()):
            a, b = k >> 46, k & ((1 << 18) - 1)
            if self.first[a] < 0:
                self.first[a] = i
            elif self.second[b] < 0:
                self.second[b] = i
            else:
                rest.append((k, i))
        rest.sort()
        self.rest_keys = np.array([k for k, _ in rest], X.U64)
        self.rest_ids = np.array([i for _, i in rest], np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece index of each hash, -1 where it is none."""
        i = self.first[(h >> X.U64(46)).astype(np.int64)]
        i = np.where(self.keys[i] == h, i, self.second[(h & X.U64((1 << 18) - 1)).astype(np.int64)])
        i = np.where(self.keys[i] == h, i, -1)
        if len(self.rest_keys):
            at = np.minimum(np.searchsorted(self.rest_keys, h), len(self.rest_keys) - 1)
            i = np.where(self.rest_keys[at] == h, self.rest_ids[at], i)
        return i

    def groups(self, words: list[bytes]):
        """Words of equal length together: (indices, length, hasher, starts)."""
        size = np.array([len(w) for w in words], np.int64)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            step = max(1, (1 << 21) // (n + 1))
            for a in range(0, len(at), step):
                part = at[a:a + step]
                flat = np.frombuffer(b"".join(b" " + words[i] for i in part.tolist()), np.uint8)
                yield part, n + 1, X.Hasher(flat, 0), np.arange(len(part)) * (n + 1)

    def arcs(self, n: int, h: X.Hasher, start: np.ndarray):
        """(end, size, words, piece ids) of every span that is a piece in some words."""
        for e in range(1, n + 1):
            for size in range(1, min(self.longest, e) + 1):
                i = self.find(h.slices(start + e - size, start + e))
                at = np.flatnonzero(i >= 0)
                if len(at):
                    yield e, size, at, i[at]

    def log_probability(self, words: list[bytes], weight: np.ndarray) -> np.ndarray:
        """Natural log of the marginal probability of each word."""
        out = np.zeros(len(words))
        for part, n, h, start in self.groups(words):
            forward = np.full((n + 1, len(part)), -np.inf)
            forward[0] = 0
            for e, size, at, i in self.arcs(n, h, start):
                forward[e, at] = np.logaddexp(forward[e, at], forward[e - size, at] + weight[i])
            out[part] = forward[n]
        return out

    def expected(self, words: list[bytes], count: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece, over all segmentations."""
        total = np.zeros(len(weight))
        for part, n, h, start in self.groups(words):
            forward = np.full((n + 1, len(part)), -np.inf)
            backward = forward.copy()
            forward[0], backward[n] = 0, 0
            arcs = list(self.arcs(n, h, start)) if n <= 64 else None
            for e, size, at, i in arcs if arcs is not None else self.arcs(n, h, start):
                forward[e, at] = np.logaddexp(forward[e, at], forward[e - size, at] + weight[i])
            for e, size, at, i in reversed(arcs if arcs is not None else list(self.arcs(n, h, start))):
                w = weight[i] + backward[e, at]
                share = np.exp(forward[e - size, at] + w - forward[n, at]) * count[part][at]
                np.add.at(total, i, share)
                backward[e - size, at] = np.logaddexp(backward[e - size, at], w)
        return total


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _words():
    def run(batches):
        for b in batches:
            train = b.column(b.schema.get_field_index("train")).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, buf, off in X.chunks(X.text_column(b, "text")):
                w = X.Words(buf, off, lower=True)
                _, first, inverse = np.unique(w.hashes(0), return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.strings(first), pa.binary()), pa.array(np.bincount(inverse, train[lo:hi][w.doc], len(first)).astype(np.int64)),
                     pa.array(np.bincount(inverse, minlength=len(first)).astype(np.int64))], ["word", "c", "n"])
    return run


def _gathered(batches, rows: int = 1 << 16):
    """The same rows in larger batches: the recursions run over many words at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _expect(path: str, weight: np.ndarray):
    def run(batches):
        lat = lattice(path)
        total = np.zeros(len(weight))
        for b in _gathered(batches):
            words = b.column(0).to_pylist()
            total += lat.expected(words, np.ones(len(words)), weight)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["piece", "e"])
    return run


def _marginal(path: str, weight: np.ndarray, total: int, kinds: int):
    def run(batches):
        lat = lattice(path)
        rest = math.log(DISCOUNT * kinds / total) if total and kinds else 0.0
        for b in _gathered(batches):
            c = b.column(1).to_numpy(zero_copy_only=False)
            seen = np.where(c > 0, np.log(np.maximum(c - DISCOUNT, 1 - DISCOUNT) / max(total, 1)), -np.inf)  # no arc of an unseen word
            words = b.column(0).to_pylist()
            flat = np.frombuffer(b"".join(words), np.uint8)
            end = np.cumsum([len(w) for w in words])
            h = X.Hasher(flat, 0).slices(end - np.array([len(w) for w in words]), end)
            yield pa.RecordBatch.from_arrays(
                [X.signed(h), b.column(1), b.column(2), pa.array(np.logaddexp(seen, rest + lat.log_probability(words, weight)) / LOG10)], ["h", "c", "n", "lp"])
    return run


def _score(head: tuple[np.ndarray, np.ndarray, np.ndarray], log_total: float):
    def run(batches):
        keys, count, lp = head
        for b in batches:
            for lo, hi, buf, off in X.chunks(X.text_column(b, "text")):
                k = hi - lo
                w = X.Words(buf, off, lower=True)
                uniq, inverse = np.unique(w.hashes(0).view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(keys, uniq), max(len(keys) - 1, 0))
                known = keys[at] == uniq if len(keys) else np.zeros(len(uniq), bool)
                if len(keys):
                    c, p = np.where(known, count[at], 0), np.where(known, lp[at], 0)
                else:
                    c, p = np.zeros(len(uniq), np.int64), np.zeros(len(uniq))
                base = np.where(known, np.log10(c + 1.0) - log_total, 0)
                far = ~known[inverse]
                pair, n = np.unique(w.doc[far].astype(np.int64) * (len(uniq) + 1) + inverse[far], return_counts=True)
                tail = pa.StructArray.from_arrays([pa.array(uniq[pair % (len(uniq) + 1)]), pa.array(n.astype(np.int64))], ["h", "k"])
                sums = [np.bincount(w.doc, x[inverse], k).astype(np.float64) for x in (base, p, (c > 0).astype(float))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("doc_id")).slice(lo, k), b.column(b.schema.get_field_index("train")).slice(lo, k),
                     pa.array(np.bincount(w.doc, minlength=k).astype(np.int64)), *(pa.array(x) for x in sums),
                     X.lists(tail, np.bincount(pair // (len(uniq) + 1), minlength=k))],
                    ["doc_id", "train", "n", "base", "lp", "known", "tail"])
    return run


def fit(words: DataFrame, model: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log weights of the pieces, by EM over the distinct ``words``."""
    lat = lattice(model)
    weight = lat.start
    for _ in range(rounds):
        total = np.zeros(len(weight))
        rows = words.mapInArrow(_expect(model, weight), "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e"))
        for r in rows.orderBy("piece").collect():
            total[r.piece] += r.e
        if total.sum() < 1:
            break
        total += ALPHA
        weight = np.log(total / total.sum())
    return weight


def lattice_scores(docs: DataFrame, train, model: str | None = None, rounds: int = ROUNDS, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, train, n_tokens, n_known,
    train_tokens, base_score, score.  ``train`` is a Boolean column."""
    model = model or default_model()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), train.alias("train"))
    words = cut(rows.select("train", "text").mapInArrow(_words(), "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    ends = rows.filter("train").count()
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    total, kinds = total + ends, kinds + (ends > 0)
    log_total = math.log10(total + kinds + 1) if total else 0.0

    weight = fit(words.filter("c > 0").select("word"), model, rounds)
    scored = cut(words.mapInArrow(_marginal(model, weight, total, kinds - (ends > 0)), "h long, c long, n long, lp double"), "scored")
    top = scored.orderBy(F.col("n").desc(), "h").limit(head).collect()
    top.sort(key=lambda r: r.h)
    known = (np.array([r.h for r in top], np.int64), np.array([r.c for r in top], np.int64), np.array([r.lp for r in top], np.float64))

    parts = rows.mapInArrow(_score(known, log_total), "doc_id long, train boolean, n long, base double, lp double, known double, tail array<struct<h:long,k:long>>")
    parts = cut(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    tail = parts.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.k").join(scored.select("h", "c", "lp"), "h")
    tail = tail.groupBy("row").agg(F.sum(F.col("k") * (F.log10(F.col("c") + 1.0) - log_total)).alias("tbase"), F.sum(F.col("k") * F.col("lp")).alias("tlp"),
                                   F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tknown"))
    zero = F.lit(0.0)
    end_base = math.log10(ends + 1) - log_total
    end_score = math.log10(ends / total) if ends else math.log10(0.5)  # any constant, without training rows
    return parts.drop("tail").join(tail, "row", "left").select(
        "doc_id", "train", (F.col("n") + 1).alias("n_tokens"), (F.col("known") + F.coalesce("tknown", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tbase", zero) + end_base).alias("base_score"),
        (F.col("lp") + F.coalesce("tlp", zero) + end_score).alias("score"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 7 != 2
    return lattice_scores(table(spark, sf_dir, "documents"), train).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
