"""Repeated windows of a corpus from phrases cut at content triggers.

Shared by the byte operator (op 3) and the word operator (op 8).  Windows of
``width`` symbols that share one trigger position form a run; the symbols they
cover are its phrase (``textnum.runs``).  Work narrows in steps, each a count
by fingerprint that Spark pre-aggregates before its shuffle:

1. triggers: only phrases whose trigger occurs twice can hold a repeat;
2. phrases: an equal phrase elsewhere decides all of its windows at once;
3. pieces (long windows only): where one trigger has several phrases, each
   distinct phrase sends, from one representative row, pieces of a few
   neighbouring windows, aligned to the trigger;
4. windows: where several pieces agree in the symbols common to all of their
   windows, each distinct piece sends its windows one by one.

No group is ever gathered: hot passages are single keys with a count, and the
joins that return counts to their rows are sort-merge joins that adaptive
execution can split.  Decisions rest on 128-bit fingerprints.  Decided windows
return to their texts as ranges of starts.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as X
from .scratch import cut, row_id, small_batches


@dataclass(frozen=True)
class Rule:
    """unit: ``byte`` or ``word``.  piece: windows in a piece, 0 for none.
    earlier: a window counts as repeated when it also starts in a document
    with a smaller id; else when it starts anywhere else."""
    unit: str
    width: int
    gram: int
    piece: int
    earlier: bool


class _Cuts:
    """Hashers and runs of a chunk of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, rule: Rule):
        if rule.unit == "byte":
            self.symbols, self.off = (lambda seed: buf), off
        else:
            w = X.Words(buf, off)
            self.symbols, self.off = w.hashes, w.offsets
        self.h0, self.width = X.Hasher(self.symbols(0), 0), rule.width
        self.doc, self.lo, self.hi, self.at, self.key = X.runs(self.h0, self.off, rule.gram, rule.width)

    @cached_property
    def h1(self) -> X.Hasher:
        return X.Hasher(self.symbols(1), 1)

    def pick(self, mask: np.ndarray) -> None:
        self.doc, self.lo, self.hi, self.at, self.key = self.doc[mask], self.lo[mask], self.hi[mask], self.at[mask], self.key[mask]

    def split(self, size: int) -> None:
        """Cut the runs to pieces; their key becomes the hash of what all
        windows of an uncut piece share."""
        if size == 1:
            at, which = X.expand(self.lo, self.hi)
            self.doc, self.lo, self.hi, self.key = self.doc[which], at, at, self.h0.slices(at, at + self.width)
            return
        near, far = (self.at - self.hi) // size, (self.at - self.lo) // size
        block, which = X.expand(near, far)
        top = self.at[which] - block * size  # last start of the uncut piece
        self.doc, self.at = self.doc[which], self.at[which]
        self.lo, self.hi = np.maximum(self.lo[which], top - size + 1), np.minimum(self.hi[which], top)
        self.key = self.h0.slices(top, top - size + 1 + self.width)

    def rows(self, ids: list[np.ndarray], names: list[str], limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.lo), limit):
            p = slice(a, a + limit)
            doc, lo, hi = self.doc[p], self.lo[p], self.hi[p]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[doc]) for x in ids), pa.array((lo - self.off[doc]).astype(np.int32)), pa.array((hi - self.off[doc]).astype(np.int32)),
                 X.signed(self.key[p]), X.signed(self.h0.slices(lo, hi + self.width)), X.signed(self.h1.slices(lo, hi + self.width))],
                [*names, "lo", "hi", "key", "p0", "p1"])


SENT = "rid long, tx long, lo int, hi int, key long, p0 long, p1 long"
FOUND = ["key", "p0", "p1"]


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _lists(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """Arrays of a list column; nulls are empty lists."""
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64) for x in b.column(b.schema.get_field_index(name))]


def _member(doc: np.ndarray, values: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Whether values[i] is in the set of text doc[i]."""
    out = np.zeros(len(values), bool)
    bounds = np.searchsorted(doc, np.arange(len(sets) + 1))
    for i, s in enumerate(sets):
        a, z = bounds[i], bounds[i + 1]
        if len(s) and z > a:
            out[a:z] = np.isin(values[a:z], s)
    return out


def _triggers(rule: Rule):
    def run(batches):
        for b in batches:
            rid = _numbers(b, "rid")
            for lo, hi, buf, off in X.chunks(X.text_column(b, "text")):
                c = _Cuts(buf, off, rule)
                order = np.lexsort((c.key, c.doc))
                doc, key = c.doc[order], c.key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(key)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[lo:hi][doc[at]]), X.signed(key[at]), pa.array(n.astype(np.int32))], ["rid", "key", "n"])
    return run


def _phrases(rule: Rule):
    def run(batches):
        for b in batches:
            ids, keys = [_numbers(b, "rid"), _numbers(b, "tx")], _lists(b, "keys")
            for lo, hi, buf, off in X.chunks(X.text_column(b, "text")):
                c = _Cuts(buf, off, rule)
                c.pick(_member(c.doc, c.key.view(np.int64), keys[lo:hi]))
                yield from c.rows([x[lo:hi] for x in ids], ["rid", "tx"])
    return run


def _splits(rule: Rule, sizes: list[int]):
    """Pieces of the asked runs (given by their first start), in steps of ``sizes``."""
    def run(batches):
        for b in batches:
            ids = [_numbers(b, "rid"), _numbers(b, "tx")]
            asked = _lists(b, "asked")
            for lo, hi, buf, off in X.chunks(X.text_column(b, "text")):
                c = _Cuts(buf, off, rule)
                for i, size in enumerate(sizes):
                    if i == len(sizes) - 1:
                        c.pick(_member(c.doc, c.lo - c.off[c.doc], asked[lo:hi]))
                    c.split(size)
                yield from c.rows([x[lo:hi] for x in ids], ["rid", "tx"])
    return run


def _cut_texts(rule: Rule):
    def run(batches):
        for b in batches:
            rid, tx = _numbers(b, "rid"), _numbers(b, "tx")
            first, last = _lists(b, "first"), _lists(b, "last")
            for lo, hi, buf, off in X.chunks(X.text_column(b, "text")):
                words = X.Words(buf, off) if rule.unit == "word" else None
                soff = off if words is None else words.offsets
                a = np.concatenate([soff[i] + x for i, x in enumerate(first[lo:hi])])
                z = np.concatenate([soff[i] + x + rule.width for i, x in enumerate(last[lo:hi])])
                gone = X.covered(int(soff[-1]), a.astype(np.int64), z.astype(np.int64))
                out = []
                for i in range(hi - lo):
                    g = gone[soff[i]:soff[i + 1]]
                    if words is None:
                        kept = buf[off[i]:off[i + 1]][~g].tobytes()
                    else:
                        kept = b" ".join(words.strings(soff[i] + np.flatnonzero(~g)))
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    out.append((int(rid[lo + i]), int(tx[lo + i]), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["rid", "tx", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def text_id(text_col: str = "text"):
    """Tells apart texts that share an id."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def remove_repeats(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (rid, tx, n_removed, n_spans, kept_sha256, kept bytes) of the texts
    that lose something.  Rows that repeat (same id and text) appear once."""
    small_batches(docs.sparkSession)
    texts = docs.select(row_id(id_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def triggers() -> DataFrame:
        return texts.mapInArrow(_triggers(rule), "rid long, key long, n int")

    def again(rows: DataFrame, *by: str) -> DataFrame:
        """Fingerprints that count as repeated; ``a`` is their smallest id."""
        if rule.earlier:
            return rows.groupBy(*by).agg(F.min("rid").alias("a"), F.max("rid").alias("z")).filter("a < z").select(*by, "a")
        n = F.sum("n") if "n" in rows.columns else F.count("*")
        return rows.groupBy(*by).agg(n.alias("n"), F.min("rid").alias("a")).filter("n > 1").select(*by, "a")

    def ranges(rows: DataFrame, repeated: DataFrame) -> DataFrame:
        hit = rows.join(repeated, FOUND)
        return (hit.filter("rid > a") if rule.earlier else hit).select("rid", "tx", "lo", "hi")

    def open_rows(rows: DataFrame, step: str) -> DataFrame:
        """(rid, tx, asked): for each distinct fingerprint under a key with
        several, the representative rows and where they start.  Where only
        smaller ids count, every text of the smallest id stands for it."""
        kinds = cut(rows.groupBy(*FOUND).agg(F.min(F.struct("rid", "tx")).alias("rep")), f"{step}-kinds")
        both = F.struct("p0", "p1")
        several = cut(kinds.groupBy("key").agg(F.min(both).alias("x"), F.max(both).alias("y")).filter("x != y").select("key"), f"{step}-several")
        reps = cut(kinds.join(several, "key", "left_semi").select(*FOUND, "rep.rid", "rep.tx"), f"{step}-reps")
        same = [*FOUND, "rid"] + ([] if rule.earlier else ["tx"])
        return rows.join(reps.select(*same), same, "left_semi").groupBy("rid", "tx").agg(F.collect_set("lo").alias("asked"))

    twice = cut(again(triggers(), "key").select("key"), "twice")
    found = cut(triggers().join(twice, "key", "left_semi").groupBy("rid").agg(F.collect_set("key").alias("keys")), "found", frees=(twice,))
    near = cut(texts.withColumn("tx", text_id("text")).join(found, "rid"), "near", frees=(found,))

    rows = cut(near.mapInArrow(_phrases(rule), SENT), "phrases")
    marks = cut(ranges(rows, cut(again(rows, *FOUND), "whole")), "marks")
    sizes: list[int] = []
    for size in ([rule.piece] if rule.piece else []) + [1]:
        sizes.append(size)
        asked = cut(open_rows(rows, f"by{size}"), "asked")
        rows = cut(near.select("rid", "tx", "text").join(asked, ["rid", "tx"]).mapInArrow(_splits(rule, list(sizes)), SENT), f"split{size}", frees=(rows,))
        marks = marks.union(cut(ranges(rows, cut(again(rows, *FOUND), "whole")), "marks"))

    spots = marks.distinct().groupBy("rid", "tx").agg(F.collect_list(F.struct("lo", "hi")).alias("s")) \
        .select("rid", "tx", F.col("s.lo").alias("first"), F.col("s.hi").alias("last"))
    last = near.select("rid", "tx", "text").join(spots, ["rid", "tx"])
    return last.mapInArrow(_cut_texts(rule), "rid long, tx long, n_removed long, n_spans long, kept_sha256 string, kept binary")
