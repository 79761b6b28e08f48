import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from depotlens.llm.op07_lattice_lm import lattice, lattice_scores, op7_lattice_lm
from depotlens.llm.unigram import default_model

D = "/root/testdata/sf0.001"


def brute(word: bytes, weight: dict[bytes, float]) -> float:
    f = [1.0] + [0.0] * len(word)
    for e in range(1, len(word) + 1):
        f[e] = sum(f[s] * math.exp(weight[word[s:e]]) for s in range(e) if word[s:e] in weight)
    return math.log(f[-1])


def test_marginal_is_the_sum_over_segmentations():
    lat = lattice(default_model())
    weight = dict(zip(lat.pieces, lat.start))
    words = [b"the", b"andering", "straße".encode(), b"x", "日本".encode(), b"qzqzqz", b"!?.", b"a" * 40]
    got = lat.log_probability(words, lat.start)
    assert got == pytest.approx([brute(b" " + w, weight) for w in words], rel=1e-9)
    # expected uses weighted by size cover the word once
    size = np.array([len(p) for p in lat.pieces])
    assert float(lat.expected(words, np.ones(len(words)), lat.start) @ size) == pytest.approx(sum(len(w) + 1 for w in words), rel=1e-9)


def test_contract_and_held_out(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), t.encode())) for i, t in docs.items()}
    train = [i for i in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = {r.doc_id: r for r in op7_lattice_lm(spark, D).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (i not in set(train)) and r.train_tokens == n and r.n_tokens == len(words[i]) + 1
        assert r.n_known == sum(c[w] > 0 for w in words[i]) + 1
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]) + math.log10((len(train) + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(want, rel=1e-9)
    # the base gives every unknown word a share, so its total exceeds 1 and it is
    # no bound; the fit is held against the vocabulary's own weights instead
    split = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    raw = {r.doc_id: r.score for r in lattice_scores(spark.read.parquet(f"{D}/documents.parquet"), split, rounds=0).collect()}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(raw[r.doc_id] for r in held) + 0.3 * sum(r.n_tokens for r in held)
    assert all(r.score < 0 for r in got.values())


def test_head_and_tail_agree_and_edges(spark):
    rows = [(1, "A b c a", "en"), (2, None, None), (3, "", "en"), (None, "b z", "x"), (1, "A b c a", "en"), (5, "w" * 5000 + " a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, c string")
    a = sorted(map(tuple, lattice_scores(df, F.lit(True), head=1000).collect()), key=str)
    b = sorted(map(tuple, lattice_scores(df, F.lit(True), head=1).collect()), key=str)
    assert len(a) == len(rows)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)
    assert lattice_scores(df.limit(0), F.lit(True)).count() == 0
    assert all(r.score < 0 for r in lattice_scores(df, F.lit(False)).collect())


def test_long_unseen_word_has_its_own_marginal(spark):
    word = "q7" * 1000
    rows = [(1, "a b b"), (2, word), (3, "a " + "z" * 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice_scores(df, F.col("doc_id") == 1, rounds=0).collect()}
    lat = lattice(default_model())
    weight = dict(zip(lat.pieces, lat.start))
    size = max(map(len, weight))

    def long_sum(w: bytes) -> float:  # the brute-force sum in log space
        f = [0.0] + [-math.inf] * len(w)
        for e in range(1, len(w) + 1):
            f[e] = np.logaddexp.reduce([f[s] + weight[w[s:e]] for s in range(max(0, e - size), e) if w[s:e] in weight])
        return f[-1]

    n, kinds, end = 4, 2, math.log(1 / 4)  # training words and ends, distinct words
    paths = math.log(0.75 * kinds / n)
    a = np.logaddexp(math.log(0.25 / n), paths + long_sum(b" a"))
    assert got[2] == pytest.approx((paths + long_sum(b" " + word.encode()) + end) / math.log(10), rel=1e-9)
    assert got[3] == pytest.approx((a + paths + long_sum(b" " + b"z" * 600) + end) / math.log(10), rel=1e-9)
    assert got[2] < -1000  # no floor
