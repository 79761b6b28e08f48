"""Op 6, SentencePiece encoding and decoding by a shared-prefix Viterbi.

The distinct marked words of a batch are sorted, which lays them out as a
trie in depth-first order.  Walking from one word to the next keeps the
forward scores, back pointers and open piece matches of the common prefix and
computes only the characters below the branch.  Ties: of equal scores the
piece that starts first wins.  Characters without a piece become byte pieces,
so every text decodes to itself.

Defined cases: null and empty texts give no pieces; null counts as empty and
decodes to the empty text; U+2581 in a text is written as byte pieces (the
library would turn it into a space); ids may be null or repeat (one row per
row); no rows give no rows; further columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X
from .scratch import small_batches, table
from .unigram import MARK, Vocabulary, default_model, marked_words, vocabulary, worker_cache

NONE = -float("inf")
CHUNK = 1 << 19  # bytes of text worked on at once
END = ""  # key of a piece's id in its trie node


def piece_trie(v: Vocabulary) -> dict:
    root: dict = {}
    for piece, i in v.normal.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[END] = i
    return root


def encode_sorted(words: list[str], v: Vocabulary, root: dict) -> list[list[int]]:
    """Best piece ids of sorted marked words, sharing work over prefixes."""
    best, back, last = [0.0], [(-1, -1)], ""
    open_: list[list[tuple[int, dict]]] = [[]]  # matches still running after each prefix
    scores, single, unk = v.scores, v.single, v.unk_score
    out = []
    for word in words:
        same = 0
        for a, b in zip(last, word):
            if a != b:
                break
            same += 1
        del best[same + 1:], back[same + 1:], open_[same + 1:]
        for j in range(same, len(word)):
            c = word[j]
            top, via, running = NONE, (-1, -1), []
            for start, node in open_[j]:
                node = node.get(c)
                if node is not None:
                    running.append((start, node))
                    i = node.get(END)
                    if i is not None and best[start] + scores[i] > top:
                        top, via = best[start] + scores[i], (start, i)
            node = root.get(c)
            if node is not None:
                running.append((j, node))
                i = node.get(END)
                if i is not None and best[j] + scores[i] > top:
                    top, via = best[j] + scores[i], (j, i)
            if c not in single and best[j] + unk > top:
                top, via = best[j] + unk, (j, -1)
            best.append(top)
            back.append(via)
            open_.append(running)
        ids: list[int] = []
        at = len(word)
        while at > 0:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(v.byte_ids[x] for x in reversed(word[start:at].encode()))
            at = start
        ids.reverse()
        out.append(ids)
        last = word
    return out


def solver(v: Vocabulary):
    root, literal = piece_trie(v), MARK.encode()
    mark_ids = [v.byte_ids[x] for x in literal]

    def solve(words: list[bytes]):
        normal = [w.decode().replace(" ", MARK) for w in words if w != literal]
        ids = encode_sorted(normal, v, root)
        if len(normal) < len(words):
            at = words.index(literal)
            ids.insert(at, mark_ids)
        return np.array([[len(x)] for x in ids], np.float64), ids
    return solve


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the concatenated slices begin..begin+size."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _encode_chunk(cache, buf, off):
    """(flat ids, number of ids per text)."""
    data, start, end, doc = marked_words(buf, off)
    inverse, slots = cache.lookup(data, start, end)
    slot = slots[inverse] if len(start) else np.zeros(0, np.int64)
    size = cache.begin[slot + 1] - cache.begin[slot]
    return cache.flat[_ragged(cache.begin[slot], size)], np.bincount(doc, size, len(off) - 1).astype(np.int64)


class _Surface:
    def __init__(self, v: Vocabulary):
        self.flat = np.frombuffer(b"".join(v.surface), np.uint8)
        self.size = np.array([len(s) for s in v.surface], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Decode; the marking space in front of a text goes."""
        size = self.size[ids]
        data = self.flat[_ragged(self.begin[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a + 1:z] if z > a else b"" for a, z in zip(ends[:-1], ends[1:])]


def _encode(path: str, check: bool):
    def run(batches):
        cache, surface = worker_cache("encode", path, solver), _Surface(vocabulary(path))
        for b in batches:
            ident = b.column(b.schema.get_field_index("doc_id"))
            for lo, hi, buf, off in X.chunks(X.text_column(b, "text"), CHUNK):
                ids, counts = _encode_chunk(cache, buf, off)
                cols = [ident.slice(lo, hi - lo), pa.array(counts), X.lists(pa.array(ids), counts)]
                if check:
                    texts, raw = surface.texts(ids, counts), buf.tobytes()
                    cols += [pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                             pa.array([t == raw[a:z] for t, a, z in zip(texts, off[:-1].tolist(), off[1:].tolist())], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "pieces", "decoded_sha256", "round_trip"][:len(cols)])
    return run


def _decode(path: str):
    def run(batches):
        surface = _Surface(vocabulary(path))
        for b in batches:
            col = b.column(b.schema.get_field_index("pieces"))
            rows = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) if x.is_valid else np.zeros(0, np.int64) for x in col]
            texts = surface.texts(np.concatenate([np.zeros(0, np.int64), *rows]), np.array([len(r) for r in rows], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "text"])
    return run


def encode(docs: DataFrame, model: str | None = None, check: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, pieces array<int>; with
    ``check`` also the SHA-256 of the decoded text and whether it equals the input."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    more = ", decoded_sha256 string, round_trip boolean" if check else ""
    return rows.mapInArrow(_encode(model or default_model(), check), f"doc_id long, n_pieces long, pieces array<int>{more}")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(doc_id, text) of rows of piece ids."""
    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).alias("pieces"))
    return rows.mapInArrow(_decode(model or default_model()), "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), check=True)
