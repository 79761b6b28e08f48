"""Calendar column expressions (D-5, D-6, D-7, E-4)."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..config import PEAK_MONTHS


def weekday_mon0(d: Column) -> Column:
    """Day of week with Monday = 0 … Sunday = 6."""
    return F.weekday(d)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def festival_flag(d: Column, festival_dates: list[str], window_days: int = 7) -> Column:
    """1 if ``d`` lies within ±window_days of any festival date.  The date
    list is a literal array, so no join is needed."""
    if not festival_dates:
        return F.lit(0)
    arr = F.array(*[F.lit(x).cast("date") for x in festival_dates])
    return F.exists(arr, lambda f: F.abs(F.datediff(d, f)) <= window_days).cast("int")


def season_code(month: Column) -> Column:
    """0 = Nov–Feb, 1 = Mar–May, 2 = Jun–Sep, 3 = Oct."""
    return (F.when(month.isin(11, 12, 1, 2), 0)
            .when(month.isin(3, 4, 5), 1)
            .when(month.isin(6, 7, 8, 9), 2)
            .otherwise(3))


def peak_season(category: Column, month: Column) -> Column:
    """E-4: 1 when ``month`` is a peak month of the category (lower-cased,
    spaces to underscores); unknown categories peak all year."""
    key = F.regexp_replace(F.lower(F.coalesce(category, F.lit(""))), " ", "_")
    m = F.create_map(*[x for k, months in PEAK_MONTHS.items()
                       for x in (F.lit(k), F.array(*[F.lit(v) for v in months]))])
    months = m[key]
    return F.when(months.isNull(), 1).otherwise(F.array_contains(months, month).cast("int"))
