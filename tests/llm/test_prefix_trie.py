import hashlib
import random
import zlib

import pytest

from depotlens.llm.op12_prefix_trie import op12_prefix_trie, paths, shared_heads, trie, turn_lists

SCHEMA = "conv_id long, turn long, role string, text string, path string, shard string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes as a dictionary of whole prefixes."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[:len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in members)]
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def run(df, shards=None):
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie(paths(shared_heads(turn_lists(df))), shards).collect()), key=str)


def random_rows(seed, convs, texts):
    r = random.Random(seed)
    ids = r.sample(range(-120, 400), convs)
    return [(c, r.choice([None, t]), r.choice(["user", "user", None]), r.choice(texts)) for c in ids for t in range(r.randint(1, 7))]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_random(spark, shards):
    rows = random_rows(shards, 90, ["a", "b", None, "", "é" * 9, "long " * 300])
    assert run(frame(spark, rows), shards) == brute(rows)


def test_hot_conversation_and_end(spark):
    """Two thirds are one conversation: its nodes span most shards and end there."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)] + [(c, t, "user", f"turn {t if t < 2 else c % 5}") for c in range(300, 420) for t in range(4)]
    assert run(frame(spark, rows), 16) == brute(rows)


def test_nulls_ties_repeats(spark):
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, None, None), (7, 1, "b", "x"), (7, 1, "a", "x"), (0, 2, "user", "z" * 5000), (0, 1, "system", ""),
            (101, 1, "ab", "c"), (102, 1, "a", "bc"), (100, 0, "user", "same"), (100, 0, "user", "same"), (-3, 5, "user", None), (250, 1, "user", "base is absent")]
    assert run(frame(spark, rows), 5) == brute(rows)


def test_no_rows(spark):
    assert run(frame(spark, [])) == [] and run(frame(spark, [(None, 1, "user", "x")])) == []


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in op12_prefix_trie(spark, path).collect()), key=str) == brute(rows)
