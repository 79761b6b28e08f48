"""Exact Python rounding in Spark and in the SQL oracle (property tests)."""
import math
import random

import duckdb
from hypothesis import given, settings, strategies as st

from depotlens.functions.numeric import py_round, py_round_cols, sql_py_round

TIES = [0.5075, 2.675, 0.125, 0.375, -2.5, 1.5, 0.0, 1e-9, 123456.785, 0.1 + 0.2, 0.615, 0.605]


def test_py_round_matches_python(spark):
    rnd = random.Random(7)
    vals = TIES + [rnd.uniform(-1e4, 1e4) for _ in range(2000)] + [rnd.randint(0, 10**6) / 1000 + 0.0005
                                                                     for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for n in (0, 1, 2, 3, 4):
        got = [r[0] for r in df.select(py_round("x", n)).collect()]
        assert got == [round(v, n) for v in vals]
        got2 = [r[0] for r in py_round_cols(df, {"r": ("x", n)}).select("r").collect()]
        assert got2 == [round(v, n) for v in vals]


@settings(max_examples=200, deadline=None)
@given(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), st.integers(min_value=0, max_value=5))
def test_sql_py_round_matches_python(x, n):
    con = duckdb.connect()
    got = con.execute(f"SELECT {sql_py_round(repr(float(x)), n)}").fetchone()[0]
    assert got == round(x, n) or (math.isclose(got, 0.0) and round(x, n) == 0.0)


def test_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    r = df.select(py_round("x", 2).alias("r")).collect()
    assert r[0].r is None and math.isnan(r[1].r)
