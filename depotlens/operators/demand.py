"""Demand: daily sales, gap filling, features and the 14-day forecast.

Grain is (depot_id, product_id, date).  Every depot is handled in the same
job; the series key is ``SERIES = (product_id, depot_id)``.  A series holds
at most one row per calendar day, so window functions over a series are
bounded by the calendar, never by the data volume.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import py_round_cols
from ..functions.calendar import cyclic, festival_flag, season_code, weekday_mon0
from ..sources.tpch import as_of_lit, as_of_ts

SERIES = ["product_id", "depot_id"]
ATTRS = ["product_category", "is_cold_chain", "depot_region"]

FEATURE_COLS = [
    "lag_1", "lag_7", "lag_14", "lag_30",
    "rolling_avg_7", "rolling_avg_30", "rolling_std_7",
    "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos",
    "is_festival_week", "season_code",
    "product_category_enc", "depot_region_enc", "is_cold_chain",
]


def daily_demand(movements: DataFrame, products: DataFrame, depots: DataFrame,
                 as_of: str, days: int | None = 60, depot_filter: DataFrame | None = None) -> DataFrame:
    """SRC-8: OUT units per (product, depot, day) over the last ``days`` days,
    or over the whole history (``days=None``).

    The movement filter reaches the scan; the aggregate is partial/final so
    map-side combining shrinks the shuffle to one row per key and task.
    """
    m = movements.where(F.col("movement_type") == "OUT")
    if days is not None:
        m = m.where((F.col("created_at") >= as_of_ts(as_of) - F.expr(f"INTERVAL {days} DAYS"))
                    & (F.col("created_at") <= as_of_ts(as_of)))
    if depot_filter is not None:
        m = m.join(depot_filter, "depot_id", "left_semi")
    daily = m.groupBy("product_id", "depot_id", F.to_date("created_at").alias("date")).agg(
        F.sum("quantity").alias("units_sold"))
    p = products.select("product_id", "product_category", "is_cold_chain")
    d = depots.select("depot_id", F.col("region").alias("depot_region"))
    return daily.join(p, "product_id").join(d, "depot_id").select(
        "product_id", "depot_id", "date", "units_sold", *ATTRS)


def with_date_bounds(sales: DataFrame) -> DataFrame:
    """Adds ``_lo``/``_hi``: the global min and max date of the input.  One
    scalar subquery (a partial/final aggregate returning one struct) is
    projected once; later expressions refer to the columns, so the
    subquery is planned and run a single time."""
    b = sales.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    return sales.select("*", b.alias("_b")).select("*", F.col("_b.lo").alias("_lo"),
                                                   F.col("_b.hi").alias("_hi")).drop("_b")


def fill_missing_dates(sales: DataFrame) -> DataFrame:
    """D-1: every existing (product, depot) pair × every day between the
    global min and max date; missing units → 0; attributes re-attached from
    one row per pair.

    The calendar is generated per pair with ``explode(sequence(...))`` against
    the scalar bounds, not by a join against a calendar table.
    """
    attrs = [a for a in ATTRS if a in sales.columns]
    pairs = with_date_bounds(sales).groupBy(*SERIES).agg(
        *[F.min_by(a, "date").alias(a) for a in attrs], F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    grid = pairs.select(*SERIES, *attrs, F.explode(F.sequence("_lo", "_hi")).alias("date"))
    measures = [c for c in sales.columns if c not in set(SERIES) | set(ATTRS) | {"date"}]
    m = sales.select(*SERIES, "date", *measures)
    out = grid.join(m, SERIES + ["date"], "left")
    return out.select(*SERIES, "date", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in measures],
                      *[a for a in ATTRS if a in sales.columns])


def demand_features(filled: DataFrame, festival_dates: list[str] | None = None,
                    codes: DataFrame | None = None, drop_warmup: bool = True) -> DataFrame:
    """D-2 … D-9: lags (rows), rolling means/std of the previous rows,
    calendar encodings, festival week, season and category codes; warm-up
    rows (any lag or rolling mean null) dropped.  One window spec → one
    shuffle on the series key."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    w7 = w.rowsBetween(-7, -1)
    w30 = w.rowsBetween(-30, -1)
    u = F.col("units_sold")
    month = F.month("date")
    msin, mcos = cyclic(month, 12)
    dsin, dcos = cyclic(weekday_mon0(F.col("date")), 7)
    df = filled.select(
        "*",
        F.lag(u, 1).over(w).alias("lag_1"),
        F.lag(u, 7).over(w).alias("lag_7"),
        F.lag(u, 14).over(w).alias("lag_14"),
        F.lag(u, 30).over(w).alias("lag_30"),
        F.when(F.count(u).over(w7) >= 3, F.avg(u).over(w7)).alias("rolling_avg_7"),
        F.when(F.count(u).over(w30) >= 10, F.avg(u).over(w30)).alias("rolling_avg_30"),
        F.when(F.count(u).over(w7) >= 3, F.coalesce(F.stddev_samp(u).over(w7), F.lit(0.0)))
         .otherwise(F.lit(0.0)).alias("rolling_std_7"),
        msin.alias("month_sin"), mcos.alias("month_cos"),
        dsin.alias("day_of_week_sin"), dcos.alias("day_of_week_cos"),
        festival_flag(F.col("date"), festival_dates or []).alias("is_festival_week"),
        season_code(month).alias("season_code"),
    )
    if codes is None:
        codes = category_codes(filled)
    cat = codes.where(F.col("kind") == "product_category").select(
        F.col("value").alias("product_category"), F.col("code").alias("product_category_enc"))
    reg = codes.where(F.col("kind") == "depot_region").select(
        F.col("value").alias("depot_region"), F.col("code").alias("depot_region_enc"))
    # code tables are one row per distinct value; AQE broadcasts them after
    # measuring them (no unconditional hint: their size comes from the data)
    df = (df.join(cat, "product_category", "left")
            .join(reg, "depot_region", "left")
            .withColumn("product_category_enc", F.coalesce("product_category_enc", F.lit(-1)))
            .withColumn("depot_region_enc", F.coalesce("depot_region_enc", F.lit(-1)))
            .withColumn("is_cold_chain", F.col("is_cold_chain").cast("int")))
    if not drop_warmup:
        return df
    return df.dropna(subset=["lag_1", "lag_7", "lag_14", "lag_30", "rolling_avg_7", "rolling_avg_30"])


def category_codes(df: DataFrame) -> DataFrame:
    """D-8: lexical-order integer code per distinct category / region value
    (``kind, value, code``).  Saved with a model to avoid re-coding skew
    (H-5).  The distinct value sets are tiny; the window runs over them
    only, never over the facts."""
    vals = (df.select(F.lit("product_category").alias("kind"), F.col("product_category").alias("value"))
            .unionByName(df.select(F.lit("depot_region").alias("kind"), F.col("depot_region").alias("value")))
            .where(F.col("value").isNotNull()).distinct())
    return vals.select("kind", "value",
                       (F.row_number().over(Window.partitionBy("kind").orderBy("value")) - 1).alias("code"))


def exact_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact median of each column (nulls skipped; mean of the two middle
    values for an even count) as rows ``(feature, median)``.

    Distributed: the columns are unpivoted to (feature, value) and counted by
    value, so that ties collapse before they are ordered; the one or two
    values at the middle positions are read off the cumulated counts."""
    from .ranking import histogram
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                         for c in cols])).alias("kv")).select("kv.*") \
             .where(F.col("value").isNotNull() & ~F.isnan("value"))
    h = histogram(long, ["feature"], "value", {"n": F.count(F.lit(1))})

    def holds(place):  # the value at this position (from 1) is this one
        return ((F.col("n_before") < place) & (place <= F.col("n_before") + F.col("n"))).cast("int")
    times = holds(F.floor((F.col("n_all") + 1) / 2)) + holds(F.floor(F.col("n_all") / 2) + 1)
    return h.withColumn("_t", times).where("_t > 0").groupBy("feature").agg((F.sum(F.col("value") * F.col("_t")) / 2).alias("median"))


def inference_median_fill(features: DataFrame) -> DataFrame:
    """D-10: remaining nulls in a feature column → the column's exact median
    (the 16 medians – one small row each – become literals of the fill)."""
    med = {r["feature"]: r["median"] for r in exact_medians(features, FEATURE_COLS).collect()}
    return features.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med.get(c)).cast("double")).alias(c)
                             if c in FEATURE_COLS else F.col(c) for c in features.columns])


def trend_slope(sales: DataFrame) -> DataFrame:
    """D-11: OLS slope of units on the row index 0..n-1 in date order per
    series; fewer than 5 rows → 0."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    idx = sales.select(*SERIES, "units_sold", (F.row_number().over(w) - 1).cast("double").alias("x"))
    return idx.groupBy(*SERIES).agg(
        F.when(F.count("*") < 5, F.lit(0.0))
         .otherwise(F.coalesce(F.regr_slope("units_sold", "x"), F.lit(0.0))).alias("demand_trend_slope"))


def forecast_fallback(sales: DataFrame, horizon_days: int = 14, tail_days: int = 30) -> DataFrame:
    """D-13 (no model): gap-fill, daily rate = mean of the last 30 filled
    days, clipped at 0; 14-day units; trend slope on the filled series.

    Computed from sufficient statistics instead of materialising the
    calendar: after gap filling every series covers the same N days
    [min_date, max_date], so the tail mean is Σ units of the last 30 days ÷
    min(N, 30) and the regression on x = day offset needs only Σy and Σxy
    per series (Σx, Σx² are closed forms of N).  Work is O(sales rows), one
    partial/final aggregate, no window, no sort.
    """
    sb = with_date_bounds(sales)
    x = F.datediff("date", "_lo").cast("double")
    in_tail = F.datediff("_hi", "date") < tail_days
    g = sb.groupBy(*SERIES).agg(
        F.sum(F.when(in_tail, F.col("units_sold")).otherwise(0.0)).alias("tail_sum"),
        F.sum("units_sold").alias("sy"),
        F.sum(x * F.col("units_sold")).alias("sxy"),
        F.first((F.datediff("_hi", "_lo") + 1).cast("double")).alias("n"),
    )
    n = F.col("n")
    sx = n * (n - 1) / 2
    sxx = (n - 1) * n * (2 * n - 1) / 6
    slope = (n * F.col("sxy") - sx * F.col("sy")) / (n * sxx - sx * sx)
    rate = F.greatest(F.col("tail_sum") / F.least(n, F.lit(float(tail_days))), F.lit(0.0))
    raw = g.select("product_id", "depot_id", (rate * horizon_days).alias("u14"), rate.alias("rate"),
                   F.when(n < 5, F.lit(0.0)).otherwise(slope).alias("slope"))
    out = py_round_cols(raw, {"predicted_units_14d": ("u14", 2), "predicted_daily_rate": ("rate", 4),
                              "demand_trend_slope": ("slope", 4)})
    return out.select("product_id", "depot_id", "predicted_units_14d", "predicted_daily_rate",
                      "demand_trend_slope")


def demand_forecast(movements: DataFrame, products: DataFrame, depots: DataFrame,
                    as_of: str) -> DataFrame:
    """Flagship: SRC-8 → D-1 → D-11 → D-13 for every depot at once."""
    return forecast_fallback(daily_demand(movements, products, depots, as_of))


def daily_from_mapped(mapped: DataFrame) -> DataFrame:
    """Sales rows of a mapped client file → one row per (product, depot,
    day) (Q-5 collapse, Q-6 positive filter)."""
    s = mapped.where((F.col("units_sold") > 0) & F.col("date").isNotNull() & F.col("product_id").isNotNull())
    return s.groupBy("product_id", "depot_id", "date").agg(
        F.sum("units_sold").alias("units_sold"), F.min("product_category").alias("product_category"),
        F.min("is_cold_chain").alias("is_cold_chain"), F.min("depot_region").alias("depot_region"))
