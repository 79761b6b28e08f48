"""Op 5, near-duplicate embeddings by a random-projection tree forest.

Each of ``trees`` trees splits the vectors of a label again and again along
random directions.  A node of more than ``leaf`` vectors is cut at the middle
of the widest gap between neighbouring quantiles (25 % to 75 %) of its
projections, so that dense groups stay whole; vectors within ``spill`` of the
cut go to both children.  A node whose projections hardly vary is a dense
group and becomes a leaf at any size.  All splits of a level are one
aggregation (approximate quantiles, pre-aggregated) and one join.

Inside a leaf vectors are compared in blocks of ``block``: every pair of
blocks is a group of its own, so a leaf with a third of all rows spreads over
tasks.  A pair that shares several leaves counts in the first one only (each
vector carries its leaves).  Every block pair returns link counts and the
edges of a spanning forest, never all pairs; components come from the edges.

Defined cases: null, zero or non-finite vectors and null labels link with
nothing; a null vec_id is returned as null with itself as component; rows
that repeat a vec_id are separate vectors that link like any others; vectors
of different lengths never link; no rows give no rows; further columns are
ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .scratch import cut, table

TREES, DEPTH, LEAF, SPILL, FLAT, BLOCK = 6, 24, 256, 0.03, 0.1, 1024
STEPS = [0.25 + 0.05 * i for i in range(11)]


def _directions(size: int, tree: int, depth: int) -> np.ndarray:
    d = np.random.default_rng([size, tree]).normal(size=(depth, size))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _project(trees: int, depth: int):
    def run(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            row, label, col = b.column(0), b.column(1), b.column(2)
            keep, unit, proj = [], [], []
            for i, x in enumerate(col):
                v = np.array([np.nan if y is None else y for y in x.as_py()], np.float64) if x.is_valid else np.zeros(0)
                norm = float(np.sqrt(v @ v)) if len(v) and np.isfinite(v).all() else 0.0
                if norm > 0 and np.isfinite(norm) and label[i].is_valid:
                    if len(v) not in made:
                        made[len(v)] = np.concatenate([_directions(len(v), t, depth) for t in range(trees)])
                    keep.append(i)
                    unit.append(v / norm)
                    proj.append((made[len(v)] @ unit[-1]).astype(np.float32))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [row.take(at), label.take(at), pa.array([len(u) for u in unit], pa.int32()), pa.array([u.tolist() for u in unit], pa.list_(pa.float64())),
                 pa.array([p.tolist() for p in proj], pa.list_(pa.float32()))], ["row", "label", "size", "unit", "proj"])
    return run


def forest(vectors: DataFrame, trees: int, depth: int, leaf: int, spill: float) -> DataFrame:
    """(row, tree, label, size, path): the leaves of every row of ``vectors``
    (row, label, size, proj)."""
    node = ["tree", "label", "size", "path"]
    open_ = vectors.select("row", "label", "size", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit("").alias("path"))
    leaves = None
    for level in range(depth):
        value = vectors.select("row", *[F.element_at("proj", t * depth + level + 1).alias(f"p{t}") for t in range(trees)])
        value = value.select("row", F.posexplode(F.array(*[F.col(f"p{t}") for t in range(trees)])).alias("tree", "p"))
        rows = cut(open_.join(value, ["row", "tree"]), "level")
        q = rows.groupBy(*node).agg(F.count("*").alias("n"), F.expr("percentile_approx(p, array(" + ", ".join(f"{s:.2f}D" for s in [0.1, *STEPS, 0.9]) + "), 1000)").alias("q"))
        gaps = F.expr(f"transform(sequence(1, {len(STEPS) - 1}), i -> struct(q[i + 1] - q[i] as gap, (q[i + 1] + q[i]) / 2 as at))")
        q = q.withColumn("cut", F.when((F.col("n") > leaf) & (F.expr(f"q[{len(STEPS) + 1}] - q[0]") > FLAT), F.array_max(gaps)["at"])).select(*node, "cut")
        rows = cut(rows.join(cut(q, "cuts"), node), "split", frees=(rows,))
        done = rows.filter("cut is null").select("row", *node)
        leaves = done if leaves is None else leaves.union(done)
        sides = F.array_compact(F.array(F.when(F.col("p") <= F.col("cut") + spill, F.lit("0")), F.when(F.col("p") >= F.col("cut") - spill, F.lit("1"))))
        open_ = rows.filter("cut is not null").select("row", "label", "size", "tree", "path", F.explode(sides).alias("side")) \
            .select("row", "label", "size", "tree", F.concat("path", "side").alias("path"))
        if open_.isEmpty():
            return leaves
    return leaves.union(open_.select("row", *node))


def _compare(threshold: float):
    def run(key, left):
        """One pair of blocks: counts of new links and a spanning forest."""
        a, b = left[left.side == 0], left[left.side == 1]
        same = len(b) == 0
        b = a if same else b
        x, y = np.stack(a.unit.to_numpy()), np.stack(b.unit.to_numpy())
        ra, rb = a.row.to_numpy(), b.row.to_numpy()
        la, lb = [set(s.tolist()) for s in a.leaves], [set(s.tolist()) for s in b.leaves]
        here = key[0]
        counts: dict[int, int] = {}
        root = {int(r): int(r) for r in np.concatenate([ra, rb])}

        def find(r):
            while root[r] != r:
                root[r] = root[root[r]]
                r = root[r]
            return r

        for i in range(len(x)):
            hit = np.flatnonzero((y @ x[i]) >= threshold)
            hit = hit[hit > i] if same else hit
            for j in hit.tolist():
                p, q = int(ra[i]), int(rb[j])
                if min(la[i] & lb[j]) != here:
                    continue
                counts[p] = counts.get(p, 0) + 1
                counts[q] = counts.get(q, 0) + 1
                u, v = find(p), find(q)
                if u != v:
                    root[max(u, v)] = min(u, v)
        import pandas as pd
        rows = list(counts)
        return pd.DataFrame({"row": rows, "n": [counts[r] for r in rows], "root": [find(r) for r in rows]}, columns=["row", "n", "root"]).astype("int64")
    return run


def projection_forest_links(vectors: DataFrame, threshold: float = 0.93, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, block: int = BLOCK,
                            depth: int = DEPTH, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    all_rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
                   .withColumn("row", F.monotonically_increasing_id()), "vectors")
    schema = "row long, label long, size int, unit array<double>, proj array<float>"
    good = cut(all_rows.select("row", "label", "v").mapInArrow(_project(trees, depth), schema), "projected")
    leaves = forest(good.drop("unit"), trees, depth, leaf, spill)
    # a leaf's number orders leaves by tree, so that "the first shared leaf" is well defined
    leaves = cut(leaves.select("row", F.xxhash64("tree", "label", "size", "path").alias("leaf")), "leaves")
    sized = leaves.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1")
    member = leaves.join(sized, "leaf").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    member = member.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    full = leaves.groupBy("row").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")).join(good.select("row", "unit"), "row")
    # block i meets every block j >= i of its leaf
    pairs = member.select("row", "leaf", F.expr(
        "explode(transform(sequence(0, blocks - 1), o -> struct(least(block, o) as i, greatest(block, o) as j, if(block <= o, 0, 1) as side)))").alias("m"))
    pairs = pairs.select("row", "leaf", "m.i", "m.j", "m.side").join(full, "row")
    found = cut(pairs.groupBy("leaf", "i", "j").applyInPandas(_compare(threshold), "row long, n long, root long"), "links")
    n_links = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    comp = components(found.filter("row != root").select(F.col("row").alias("a"), F.col("root").alias("b")))
    out = all_rows.select("row", "vec_id").join(n_links, "row", "left").join(comp.withColumnRenamed("node", "row"), "row", "left") \
        .withColumn("comp", F.coalesce("comp", "row"))
    low = out.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    return out.join(cut(low, "lowest"), "comp").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest_links(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reach AS (SELECT vec_id AS x, vec_id AS r FROM v UNION SELECT l.y, reach.r FROM reach JOIN links l ON l.x = reach.x),
c AS (SELECT x, min(r) AS r FROM reach GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.r AS component_id, vec_id = c.r AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
