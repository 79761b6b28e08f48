"""Numeric column helpers.

``py_round`` rounds a double exactly like Python's ``round(x, n)``: on the
exact binary value, ties to even.  Spark's ``round`` rounds the shortest
decimal string half-up, so 0.5075 (stored as 0.50749999…) becomes 0.508 in
Spark but 0.507 in Python.  The tie test needs the exact product
x·2·10ⁿ, obtained error-free with Dekker's two-product (Veltkamp split), so
everything stays a JVM expression inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

SPLIT = 134217729.0  # 2^27 + 1


def _split(a: Column) -> tuple[Column, Column]:
    c = F.lit(SPLIT) * a
    hi = c - (c - a)
    return hi, a - hi


def _two_product_err(a: Column, b: float) -> tuple[Column, Column]:
    p = a * F.lit(b)
    ah, al = _split(a)
    bh, bl = _split(F.lit(b))
    err = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    return p, err


def _py_round_body(x: Column, n: int) -> Column:
    s = float(10 ** n)
    a = F.abs(x)
    f = F.floor(a * F.lit(s)).cast("double")
    p, err = _two_product_err(a, 2 * s)
    d = (p - (F.lit(2.0) * f + F.lit(1.0))) + err
    step = F.when(d > 0, F.lit(1.0)).when(d < 0, F.lit(0.0)).otherwise(f % 2)
    r = F.signum(x) * ((f + step) / F.lit(s)) + F.lit(0.0)
    return F.when(F.isnan(x), x).otherwise(r)


def py_round(x, n: int = 0) -> Column:
    """Python ``round(x, n)`` on a double column.

    The argument is used about 40 times by the expansion, so pass a column
    reference: project a compound value into a column first (Catalyst does
    not inline a costly expression into a consumer that uses it many times,
    and subexpression elimination evaluates the reference once)."""
    x = F.col(x) if isinstance(x, str) else x
    return _py_round_body(x.cast("double"), n)


def sql_py_round(expr: str, n: int = 0) -> str:
    """The same computation as DuckDB SQL text (argument bound once by a
    lambda over a one-element list)."""
    s = float(10 ** n)
    m = 2 * s
    v = "v__"
    a = f"abs({v})"
    f = f"CAST(floor({a} * CAST({s!r} AS DOUBLE)) AS DOUBLE)"

    def split(t):
        c = f"(CAST({SPLIT!r} AS DOUBLE) * {t})"
        hi = f"({c} - ({c} - {t}))"
        return hi, f"({t} - {hi})"

    p = f"({a} * CAST({m!r} AS DOUBLE))"
    ah, al = split(a)
    bh, bl = split(f"CAST({m!r} AS DOUBLE)")
    err = f"((({ah} * {bh} - {p}) + {ah} * {bl} + {al} * {bh}) + {al} * {bl})"
    d = f"(({p} - (2.0 * {f} + 1.0)) + {err})"
    up = (f"(CASE WHEN {d} > 0 THEN {f} + 1 WHEN {d} < 0 THEN {f} "
          f"WHEN {f} % 2 = 0 THEN {f} ELSE {f} + 1 END)")
    r = f"({up} / CAST({s!r} AS DOUBLE))"
    body = (f"CASE WHEN {v} IS NULL OR isnan({v}) THEN {v} "
            f"WHEN {v} < 0 THEN -{r} ELSE {r} + 0.0 END")
    return f"list_transform([CAST(({expr}) AS DOUBLE)], lambda {v}: {body})[1]"


def py_round_cols(df, specs: dict):
    """Add/replace columns ``{out: (source_column, n)}`` rounded like
    Python.  The intermediate terms are built in successive projections, so
    each generated method stays small (Catalyst does not merge a projection
    whose costly outputs are used several times by the next one)."""
    from pyspark.sql import DataFrame  # noqa: F401
    tmp = []
    cur = df
    p1 = []
    for i, (out, (src, n)) in enumerate(specs.items()):
        x = F.col(src).cast("double")
        p1 += [x.alias(f"_x{i}"), F.abs(x).alias(f"_a{i}")]
    cur = cur.select("*", *p1)
    p2 = []
    for i, (out, (src, n)) in enumerate(specs.items()):
        s = float(10 ** n)
        a = F.col(f"_a{i}")
        c = F.lit(SPLIT) * a
        p2 += [F.floor(a * F.lit(s)).cast("double").alias(f"_f{i}"), (a * F.lit(2 * s)).alias(f"_p{i}"),
               (c - (c - a)).alias(f"_h{i}")]
    cur = cur.select("*", *p2)
    p3 = []
    for i, (out, (src, n)) in enumerate(specs.items()):
        s = float(10 ** n)
        a, h, p, f = F.col(f"_a{i}"), F.col(f"_h{i}"), F.col(f"_p{i}"), F.col(f"_f{i}")
        bh, bl = _split(F.lit(2 * s))
        lo = a - h
        err = ((h * bh - p) + h * bl + lo * bh) + lo * bl
        p3.append(((p - (F.lit(2.0) * f + F.lit(1.0))) + err).alias(f"_d{i}"))
    cur = cur.select("*", *p3)
    outs = {}
    for i, (out, (src, n)) in enumerate(specs.items()):
        s = float(10 ** n)
        x, f, d = F.col(f"_x{i}"), F.col(f"_f{i}"), F.col(f"_d{i}")
        step = F.when(d > 0, F.lit(1.0)).when(d < 0, F.lit(0.0)).otherwise(f % 2)
        r = F.signum(x) * ((f + step) / F.lit(s)) + F.lit(0.0)
        outs[out] = F.when(F.isnan(x), x).otherwise(r)
        tmp += [f"_x{i}", f"_a{i}", f"_f{i}", f"_p{i}", f"_h{i}", f"_d{i}"]
    keep = [F.col(c) for c in df.columns if c not in outs]
    res = cur.select(*keep, *[v.alias(k) for k, v in outs.items()])
    order = [c for c in df.columns] + [k for k in outs if k not in df.columns]
    return res.select(*order)
