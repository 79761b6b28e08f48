import numpy as np

from depotlens.llm.op05_projection_forest import op5_projection_forest, projection_forest_links


def brute(rows, threshold=0.93):
    ok = []
    for i, (_, v, label) in enumerate(rows):
        x = np.array([np.nan if y is None else y for y in v], float) if v is not None else np.zeros(0)
        if label is not None and len(x) and np.isfinite(x).all() and x @ x > 0:
            ok.append((i, x / np.sqrt(x @ x), label))
    near = {i: set() for i in range(len(rows))}
    for a, (i, x, k) in enumerate(ok):
        for j, y, m in ok[a + 1:]:
            if k == m and len(x) == len(y) and x @ y >= threshold:
                near[i].add(j), near[j].add(i)
    out = []
    for i, (ident, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((ident, len(near[i]), comp, ident == comp))
    return sorted(out, key=str)


def test_given_embeddings(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op5_projection_forest(spark, d).collect()), key=str) == brute(rows)


def test_splits_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        for _ in range(25 if g else 60):
            rows.append((len(rows), (centre + 0.1 * rng.normal(size=16)).tolist(), g % 2))
    rows += [(len(rows) + i, rng.normal(size=16).tolist(), 0) for i in range(80)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, rows[0][1], None), (None, rows[0][1], 0),
             (3, rows[3][1], 1), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, unit string")
    want = brute(rows)
    got = sorted(map(tuple, projection_forest_links(df, leaf=40, block=30).collect()), key=str)
    links = sum(r[1] for r in want)
    assert len(got) == len(want) and sum(r[1] for r in got) >= 0.97 * links
    assert sorted(map(tuple, projection_forest_links(df, leaf=1000, block=50).collect()), key=str) == want
    assert projection_forest_links(df.limit(0)).count() == 0
