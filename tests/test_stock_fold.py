"""Stock acceptance against a one-by-one fold, with hot batches over many partitions."""
import datetime as dt
import random

import numpy as np
import pytest

from depotlens.operators import stock_fold
from depotlens.operators.stock_fold import apply_stock_out, fold

SCHEMA = "batch_id string, movement_id string, movement_type string, quantity double, created_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def one_by_one(rows):
    out, stock = {}, {}
    for b, m, t, q, at in sorted(rows, key=lambda r: (r[4], r[1])):
        s, q = stock.get(b, 0.0), q or 0.0
        ok = t not in ("OUT", "WRITE_OFF") or s >= q
        s += q if t in ("IN", "RETURN") else -q if t in ("OUT", "WRITE_OFF") and ok else 0
        stock[b] = s
        out[m] = (b, ok, s)
    return out


def run(spark, rows, **options):
    got = apply_stock_out(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert len(got) == len(rows)
    return {r.movement_id: (r.batch_id, r.accepted, r.stock_after) for r in got}


def movements(seed, sizes, takes, most=9):
    r = random.Random(seed)
    rows = [(b, f"{b}-{k:06d}", r.choices(["IN", "RETURN", "OUT", "WRITE_OFF", "TRANSFER"], [3, 1, takes, 1, 1])[0], float(r.randint(0, most)), T0 + dt.timedelta(minutes=k // 3))
            for b, n in sizes.items() for k in range(n)]
    r.shuffle(rows)
    return rows


def test_refusal_takes_nothing(spark):
    rows = [("B", "m1", "IN", 10.0, T0), ("B", "m2", "OUT", 8.0, T0 + dt.timedelta(hours=1)),
            ("B", "m3", "OUT", 5.0, T0 + dt.timedelta(hours=2)), ("B", "m4", "OUT", 2.0, T0 + dt.timedelta(hours=3))]
    assert run(spark, rows) == {"m1": ("B", True, 10.0), "m2": ("B", True, 2.0), "m3": ("B", False, 2.0), "m4": ("B", True, 0.0)}


@pytest.mark.parametrize("seed,takes", [(1, 1), (2, 4), (3, 12)])
def test_hot_batch_over_many_partitions(spark, seed, takes):
    """A batch with most rows; plenty, balanced and short of stock."""
    rows = movements(seed, {"hot": 3000, "a": 5, "b": 40, "z": 300}, takes)
    log = []
    assert run(spark, rows, partitions=24, log=log) == one_by_one(rows)
    assert len(log) <= 12  # not one round a piece


def test_long_dependence(spark):
    """Large takes pass or fail by what came in many partitions before."""
    rows = movements(7, {"hot": 600}, 3, most=400) + [("hot", "first", "IN", 2500.0, T0 - dt.timedelta(days=1))]
    assert run(spark, rows, partitions=30) == one_by_one(rows)


def test_nulls_and_no_rows(spark):
    rows = [("B", "m1", "IN", None, T0), ("B", "m2", "OUT", 1.0, T0), ("B", "m3", None, 4.0, T0), (None, "n1", "OUT", 0.0, T0), (None, "n2", "IN", 3.0, T0)]
    assert run(spark, rows) == {"m1": ("B", True, 0.0), "m2": ("B", False, 0.0), "m3": ("B", True, 0.0), "n1": (None, True, 0.0), "n2": (None, True, 3.0)}
    assert apply_stock_out(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fold_of_one_batch():
    r = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 5000):
        kind, quantity = r.integers(-1, 2, n), r.integers(0, 9, n).astype(float)
        accepted, after = fold(kind, quantity, 3.0)
        s = 3.0
        for k in range(n):
            ok = kind[k] != -1 or s >= quantity[k]
            s += kind[k] * quantity[k] if ok else 0
            assert (accepted[k], after[k]) == (ok, s)


def test_short_batches_are_folded_together(monkeypatch):
    """Many small batches, a long one and one with an infinite quantity: as one
    by one, and only the last two are folded alone."""
    r = np.random.default_rng(5)
    sizes = [*r.integers(1, 20, 500).tolist(), 300, 7]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kind, quantity = r.integers(-1, 2, sum(sizes)), r.integers(0, 9, sum(sizes)) / 10
    quantity[-3] = np.inf
    want = [fold(kind[lo:lo + n], quantity[lo:lo + n], 4.0 if k == 0 else 0.0) for k, (lo, n) in enumerate(zip(starts, sizes))]
    alone = []
    monkeypatch.setattr(stock_fold, "fold", lambda *a: alone.append(1) or fold(*a))
    accepted, after = stock_fold.fold_many(kind, quantity, starts, 4.0)
    assert np.array_equal(accepted, np.concatenate([w[0] for w in want]))
    assert np.array_equal(after, np.concatenate([w[1] for w in want]), equal_nan=True)
    assert len(alone) == 2
