import hashlib
import re
from collections import defaultdict

import pytest

from depotlens.llm.op09_source_schedule import op9_source_schedule, source_schedule

SCHEMA = "doc_id long, text string, source string, size string, k int"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(docs, most=2, share=1.5):
    """Targets by filling up one source after another; words taken by reading each shuffled source word by word."""
    streams = defaultdict(list)
    for i, text, source in docs:
        streams[source].append((hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, size_of(text)))
    names = sorted(streams, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[3] for x in streams[s]) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(size.values())
    while open_:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= most * size[s]]
        if not over:
            target.update({s: left * weight[s] / sum(weight[x] for x in open_) for s in open_})
            break
        for s in over:
            target[s] = most * size[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    taken = defaultdict(list)
    for s in names:
        goal, at, got = int(target[s] + 1e-9), 0, defaultdict(int)
        for _ in range(most):
            for k, x in enumerate(sorted(streams[s])):
                got[k] += max(0, min(x[3], goal - at))
                at += x[3]
        taken[s] = sorted((x[2] if x[1] else None, x[3], got[k]) for k, x in enumerate(sorted(streams[s])) if x[1]) + \
            sorted((None, x[3], got[k]) for k, x in enumerate(sorted(streams[s])) if not x[1])
    return target, size, taken


def check(spark, docs, block):
    df = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in docs], SCHEMA)
    rows = source_schedule(df, block=block).collect()
    target, size, taken = brute(docs)
    assert len(rows) == len(docs)
    for s in size:
        mine = [r for r in rows if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in mine)
        got = sorted((r.doc_id, r.size, r.taken) for r in mine if r.doc_id is not None) + sorted((None, r.size, r.taken) for r in mine if r.doc_id is None)
        assert got == taken[s]
        assert sum(r.taken for r in mine) == int(target[s] + 1e-9) and all(r.taken <= 2 * r.size for r in mine)


@pytest.mark.parametrize("block", [1, 7, 256, 4096])
def test_takes_every_target_to_the_word(spark, block):
    """A hot source, sources far below a block, nulls, empty texts; the block does not matter."""
    docs = [(i, "w " * (i % 40), "hot") for i in range(400)] + [(1000 + i, "a b c d", f"tail{i % 60:02d}") for i in range(300)]
    docs += [(5000 + i, t, s) for i, (t, s) in enumerate([(None, "hot"), ("", "void"), (" \t", "void"), ("x y", None), ("z " * 9, ""), (None, None)])]
    docs += [(6000, "long " * 20_000, "one long text")]
    check(spark, docs, block)


def test_repeated_rows_and_null_ids(spark):
    docs = [(7, "a b c", "s")] * 5 + [(7, "other text of this id", "s"), (8, "d e", "t")]
    df = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in docs], SCHEMA)
    rows = source_schedule(df).collect()
    assert len(rows) == 7 and {r.source: sum(x.taken for x in rows if x.source == r.source) for r in rows} == {r.source: int(r.target) for r in rows}
    check(spark, [(None, "a b c", "s"), (1, "d e", "t"), (2, "f", "t")], 4)


def test_no_rows(spark):
    assert source_schedule(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in source_schedule(spark.createDataFrame([(1, "", "s", "x", 1)], SCHEMA)).collect()] == [0]


def test_reruns_agree(spark):
    one = sorted(map(tuple, op9_source_schedule(spark, "/root/testdata/sf0.001").collect()))
    assert one == sorted(map(tuple, op9_source_schedule(spark, "/root/testdata/sf0.001").collect()))
