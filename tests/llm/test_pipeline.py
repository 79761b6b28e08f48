import hashlib
from collections import Counter

import corpus_pipeline as C
from depotlens.llm import op04_toxicity
from depotlens.llm.op06_sentencepiece import decode
from depotlens.llm.op09_source_schedule import source_schedule
from test_jaccard import brute

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = op04_toxicity.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    bad = {r.doc_id for r in op04_toxicity.toxicity(docs, model).filter("predicted = 1").collect()}
    clean = C.toxicity(spark, docs, D)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(rows) - bad

    def again(df, name):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}-{hashlib.md5(name.encode()).hexdigest()[:4]}-{id(df)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    best = {}
    for i in set(rows) - bad:
        best[rows[i].text] = max(i, best.get(rows[i].text, i))
    unique = again(C.exact_dedup(spark, again(clean, "a"), D), "b")
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(best.values())

    near = again(C.near_dedup(spark, unique, D), "c")
    want = {i for i, _, c in brute([(i, rows[i].text) for i in sorted(best.values())]) if i == c}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == want

    mixed = again(C.mixing(spark, near, D), "d")
    plan = {r.doc_id: -(-r.taken // r.size) if r.size else 0 for r in source_schedule(near).collect()}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in plan.items() if n})

    coded = C.encoding(spark, mixed, D)
    assert Counter((r.doc_id, r.text) for r in decode(coded).collect()) == Counter((r.doc_id, r.text) for r in mixed.collect())


def test_run_and_odd_rows(spark, tmp_path):
    result = C.run(spark, D)
    assert result.count() > 0 and set(result.columns) == {"doc_id", "n_pieces", "pieces"}
    schema = spark.read.parquet(f"{D}/documents.parquet").schema
    rows = [(1, "a b c", None, None, 5), (1, "a b c", None, None, 5), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 30000, "en", "s", 60000), (3, "other", "en", "s", 5)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(1, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    out = C.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in out} <= {1, 3} and len(out) >= 2
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0
