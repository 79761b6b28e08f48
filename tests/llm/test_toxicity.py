import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from depotlens.llm.op04_toxicity import CLASS, DECAY, GAPS, SPAN, WINDOW, features, margins, op4_toxicity, toxicity, train

D = next(d for d in ("/root/testdata/check_h", "/root/testdata/sf0.1") if os.path.isdir(d))


def test_margin_is_the_kernel_sum():
    rng = np.random.default_rng(1)
    weight = rng.normal(size=32 ** 3).astype(np.float32)
    texts = [b"", b"ab", b"the idiot was here", bytes(rng.integers(32, 122, 200).astype(np.uint8))]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = margins(np.frombuffer(b"".join(texts), np.uint8), off, weight)
    for t, m in zip(texts, got):
        c = np.concatenate([[0], CLASS[np.frombuffer(t, np.uint8)], np.zeros(3 * (WINDOW + SPAN), np.uint16)]).astype(int)
        sums = [sum(weight[c[j] * 1024 + c[j + a] * 32 + c[j + a + b]] * DECAY ** (a + b - 2) for j in range(i, i + WINDOW) for a, b in GAPS) for i in range(len(t) + 1)]
        assert abs(max(sums) - m) < 1e-3
    sym = CLASS[np.frombuffer(b" the idiot was her", np.uint8)][None, :WINDOW + SPAN]
    assert features(sym).sum() > 0


def test_held_out_and_hidden_insults(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    got = op4_toxicity(spark, D).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    hit = sum(r.predicted for r in held if r.toxic)
    false = sum(r.predicted for r in held if not r.toxic)
    print("recall", hit, sum(r.toxic for r in held), "false", false, sum(1 - r.toxic for r in held))
    assert false <= 0.005 * len(held) and hit >= (0.97 if D.endswith("check_h") else 0.5) * sum(r.toxic for r in held)
    model = train(docs, labels)
    base = docs.filter("lang = 'en'").join(labels.filter("toxic = 0"), "doc_id").first().text[:600]
    rows = [(i, base + s + base, None, 1) for i, s in enumerate([" ", " idiot ", " i.d.i.o.t ", " id-iot ", " worthless ", " patheetic "])] + [(None, None, 1, 1), (8, "", 1, 1), (8, "", 1, 1)]
    out = toxicity(spark.createDataFrame(rows, "doc_id long, text string, score int, held_out int"), model).collect()
    print([(r.doc_id, round(r.score, 3)) for r in out])
    assert [r.predicted for r in out] == [0, 1, 1, 1, 1, 1, 0, 0, 0]
    none = train(docs, labels.filter("toxic = 0"))
    assert toxicity(docs, none).agg(F.max("score")).first()[0] == 0 and toxicity(docs.limit(0), model).count() == 0


def test_held_out_of_every_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = op4_toxicity(spark, d).filter("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    by = {(r.lang, r.toxic): (r.hit, r.n) for r in got.groupBy("lang", "toxic").agg(F.sum("predicted").alias("hit"), F.count("*").alias("n")).collect()}
    print(by)
    for lang in ("en", "fr", "de", "es"):
        assert by[lang, 1][0] >= 0.75 * by[lang, 1][1] and by[lang, 0][0] <= 0.02 * by[lang, 0][1]
