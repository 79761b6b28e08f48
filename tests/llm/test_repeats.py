import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from depotlens.llm.op03_prefix_free import op3_prefix_free_dedup, prefix_free_dedup
from depotlens.llm.op08_relative_lz import op8_relative_lz, relative_lz_dedup

SCHEMA = "doc_id long, text string, key int, rid string"
PASSAGE = "the quick brown fox jumps over the lazy dog while seventeen other small animals look on quietly "
ROWS = [(1, "a b c d e f g h i j k l m n o p", 1, "x"), (2, "z a b c d e f g h i j k l m n o p q", 1, "x"), (3, None, 1, "x"), (4, "", None, None),
        (5, "ab " * 300, 1, "x"), (6, "xx " + "ab " * 200, 1, "x"), (7, PASSAGE * 3 + "tail one", 1, "x"), (8, "head " + PASSAGE * 2 + "tail two", 1, "x"),
        (9, "a b c d e f g h i j k l m n o p", 1, "x"), (9, "a b c d e f g h i j k l m n o p", 1, "x"), (None, PASSAGE + "end", 1, "x"), (11, " \t\n ", 1, "x"),
        (12, "é" * 500, 1, "x"), (13, "ü" + "é" * 450, 1, "x"), (14, "".join(chr(97 + i * i % 23) for i in range(30000)), 1, "x")]


def brute_bytes(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[a:a + width] for _, t in texts for a in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for a in range(len(t) - width + 1):
            if seen[t[a:a + width]] > 1:
                gone[a:a + width] = [True] * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False] + gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, width):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    low = defaultdict(lambda: 2 ** 63)
    rid = lambda i: -2 ** 63 if i is None else i
    for i, w in docs:
        for a in range(len(w) - width + 1):
            low[tuple(w[a:a + width])] = min(low[tuple(w[a:a + width])], rid(i))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if low[tuple(w[a:a + width])] < rid(i):
                gone[a:a + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [20, 120])
def test_bytes_small(spark, width):
    got = prefix_free_dedup(spark.createDataFrame(ROWS, SCHEMA), width=width).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes([r[:2] for r in ROWS], width)


@pytest.mark.parametrize("width", [4, 13])
def test_words_small(spark, width):
    got = relative_lz_dedup(spark.createDataFrame(ROWS, SCHEMA), width=width).drop("kept", "n_spans").collect()
    assert sorted(map(tuple, got), key=str) == brute_words([r[:2] for r in ROWS], width)


def test_given_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op3_prefix_free_dedup(spark, d).collect()), key=str) == brute_bytes(rows, 400)
    assert sorted(map(tuple, op8_relative_lz(spark, d).drop("n_spans").collect()), key=str) == brute_words(rows, 13)


def test_empty_and_kept(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_free_dedup(none).count() == 0 and relative_lz_dedup(none).count() == 0
    got = relative_lz_dedup(spark.createDataFrame(ROWS[:2], SCHEMA)).where(F.col("doc_id") == 2).first()
    assert bytes(got.kept) == b"z q" and got.n_spans == 1


def test_words_texts_that_share_an_id(spark):
    """Every text of an id gives way to a smaller id, also inside a phrase the texts have in common."""
    core = " ".join(f"core{i}" for i in range(16))
    common = " ".join(f"left{i}" for i in range(20)) + f" {core} " + " ".join(f"right{i}" for i in range(20))
    rows = [(1, f"before {core} after", 1, "x")] + [(7, f"own{i} start{i} {common} tail{i}", 1, "x") for i in range(4)] + [(None, common, 1, "x"), (None, f"null {common}", 1, "x")]
    got = relative_lz_dedup(spark.createDataFrame(rows, SCHEMA)).drop("kept", "n_spans").collect()
    assert sorted(map(tuple, got), key=str) == brute_words([r[:2] for r in rows], 13)
    rows = rows[:-2]
    got = relative_lz_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_removed for r in got) == [0, 16, 16, 16, 16]
