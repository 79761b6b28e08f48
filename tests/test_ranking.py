"""Skew-safe rank and lag equal the single-task window on skewed data."""
import random

from pyspark.sql import Window, functions as F

from depotlens.operators.ranking import lag_within, rank_within


def _skewed(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.4 else f"g{rnd.randint(0, 30)}"
        rows.append((g, rnd.randint(0, 50), i))
    return spark.createDataFrame(rows, "g string, v int, id int")


def test_rank_within_equals_row_number(spark):
    df = _skewed(spark)
    ours = rank_within(df, ["g"], ["v", "id"], name="r", partitions=7)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    a = sorted(tuple(x) for x in ours.select("g", "v", "id", "r").collect())
    b = sorted(tuple(x) for x in ref.select("g", "v", "id", "r").collect())
    assert a == b


def test_lag_within_equals_lag(spark):
    df = _skewed(spark, seed=5)
    ours = lag_within(df, ["g"], ["v", "id"], ["id", "v"], partitions=5)
    w = Window.partitionBy("g").orderBy("v", "id")
    ref = df.select("*", F.lag("id").over(w).alias("prev_id"), F.lag("v").over(w).alias("prev_v"))
    a = sorted(tuple(x) for x in ours.select("g", "v", "id", "prev_id", "prev_v").collect())
    b = sorted(tuple(x) for x in ref.select("g", "v", "id", "prev_id", "prev_v").collect())
    assert a == b


def test_histogram_of_tied_values(spark):
    """95 % of a group share one value: one row of it per task is all that moves."""
    from depotlens.operators.ranking import histogram
    rnd = random.Random(2)
    rows = [("hot", 7 if rnd.random() < 0.95 else rnd.randint(0, 40)) for _ in range(4000)] + [(f"g{i % 9}", rnd.randint(0, 5)) for i in range(300)] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(r.g, r.v): (r.n, r.n_before, r.n_all) for r in histogram(df, ["g"], "v", {"n": F.count(F.lit(1))}, partitions=6).collect()}
    for g, v in set(rows):
        key = lambda x: (x is not None, x)
        mine = [x for h, x in rows if h == g]
        assert got[g, v] == (mine.count(v), sum(key(x) < key(v) for x in mine if (x is None) != (v is None) or x is not None and x < v), len(mine))
    assert len(got) == len(set(rows))


def test_medians_and_metrics_with_ties(spark):
    import statistics

    from depotlens.operators import training
    from depotlens.operators.demand import exact_medians
    rnd = random.Random(9)
    rows = [(rnd.choice([0.0, 0.0, 0.0, 1.0, rnd.random()]), rnd.choice([None, 3.0, 4.0]), rnd.randint(0, 1)) for _ in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    got = {r.feature: r.median for r in exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": statistics.median(r[0] for r in rows), "b": statistics.median(r[1] for r in rows if r[1] is not None)}
    pos, neg = [r[0] for r in rows if r[2] == 1], [r[0] for r in rows if r[2] == 0]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    r = training.auc(df, "y", "a").first()
    assert abs(r.auc - want) < 1e-12 and (r.npos, r.nneg) == (len(pos), len(neg))
    t = max(t for t in {x[0] for x in rows} if sum(p >= t for p in pos) >= 0.85 * len(pos))
    assert training.recall_threshold(df, 0.85, "y", "a").first().threshold == t
    none = df.limit(0)
    assert training.recall_threshold(none, 0.85, "y", "a").first().threshold == 0.5 and training.auc(none, "y", "a").first().auc is None
