"""Text formatting that reproduces Python format specs on doubles.

Java's ``%.1f`` rounds half-up on the shortest decimal string while Python's
format rounds the exact binary value half-to-even; rounding first with
``py_round`` makes both agree (the formatted value is then never a tie).
Arguments are columns already rounded with ``py_round_cols`` to the
printed precision (for ``fmt_pct0``: to 2 decimals).
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt_fixed(c, decimals: int) -> Column:
    """Python ``f"{x:.{decimals}f}"`` of a value rounded to ``decimals``."""
    return F.format_string(f"%.{decimals}f", _c(c))


def fmt_pct0(c) -> Column:
    """Python ``f"{x:.0%}"`` of a value rounded to 2 decimals."""
    return F.concat(F.format_string("%.0f", _c(c) * 100), F.lit("%"))


def fmt_thousands0(c) -> Column:
    """Python ``f"{x:,.0f}"`` of a value rounded to 0 decimals."""
    return F.format_number(_c(c), 0)
