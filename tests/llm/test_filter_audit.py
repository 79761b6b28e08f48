import re
from itertools import permutations

import pytest

from depotlens.llm.op11_filter_audit import COUNTS, failures, interaction_audit, op11_filter_audit

DOCS = "doc_id long, text string, source string, part int, fails string"
LABELS = "doc_id long, quality int, toxic int, lang string"
LONG = " ".join(f"word{i}" for i in range(60))


def brute(docs, labels):
    """Applies every order to every document, one after another."""
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        rows.append((part or "", fails, any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(got) == len(rows)
    return got


def test_small_cases(spark):
    docs = [(1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (None, LONG, "a"), (None, LONG, None), (3, None, "a"), (4, "", ""), (5, "ONE Two $5", "a"),
            (6, "same same same " * 40, "a"), (7, LONG + " | " + "X" * 90, "b"), (8, LONG.upper() * 400, "c"), (9, "é ñ " * 60, "a"), (1, "other text with the id of the first", "b")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (8, 0, 0)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS)
    got = result(interaction_audit(failures(d, spark.createDataFrame([(*r, "en") for r in labels], LABELS))))
    assert got == brute(docs, labels)


def test_no_documents_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert interaction_audit(failures(spark.createDataFrame([], DOCS), none)).count() == 0
    one = result(interaction_audit(failures(spark.createDataFrame([(1, "a b", "s", 1, "x")], DOCS), none)))
    assert one == brute([(1, "a b", "s")], []) and len(one) == 600


def test_more_parts_than_a_batch(spark):
    docs = [(i, LONG if i % 3 else "Ab # c", f"s{i % 150}") for i in range(400)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], DOCS)
    assert result(interaction_audit(failures(d, spark.createDataFrame([], LABELS)))) == brute(docs, [])


@pytest.mark.parametrize("sf", ["0.001"])
def test_query(spark, sf):
    path = f"/root/testdata/sf{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert result(op11_filter_audit(spark, path)) == brute(docs, labels)
