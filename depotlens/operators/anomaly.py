"""Movement and temperature anomalies (A-*).

Baselines are grouped aggregates (mean, sample std) joined back to the rows;
no window over a whole category or device, so a hot key is pre-aggregated
map-side instead of landing in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import py_round_cols
from ..config import MOVEMENT_CODES
from ..sources.tpch import as_of_ts
from .expiry import days_between


def _std_or_one(std):
    return F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)


def category_baselines(movements: DataFrame, products: DataFrame, as_of: str, lookback_days: int = 30,
                       keys: tuple = ("depot_id", "product_category")) -> DataFrame:
    """A-1: mean and sample std of quantity per (depot, category) over the
    lookback; std 0/null → 1."""
    m = movements.where((F.col("created_at") >= as_of_ts(as_of) - F.expr(f"INTERVAL {lookback_days} DAYS"))
                        & (F.col("created_at") <= as_of_ts(as_of)))
    m = m.join(products.select("product_id", "product_category"), "product_id")
    return m.groupBy(*keys).agg(F.avg("quantity").alias("mean"),
                                _std_or_one(F.stddev_samp("quantity")).alias("std"))


def anomaly_features(movements: DataFrame, products: DataFrame, batches: DataFrame, as_of: str,
                     lookback_days: int = 30) -> DataFrame:
    """A-2: hour, weekday (Mon=0), batch age (days ≥ 0), movement code,
    signed z vs the (depot, category) baseline (unknown → 0) and velocity
    deviation vs the product's own lookback mean."""
    m = movements.join(products.select("product_id", "product_category"), "product_id") \
                 .join(batches.select("batch_id", F.col("created_at").alias("batch_created_at")), "batch_id", "left")
    base = category_baselines(movements, products, as_of, lookback_days)
    recent = movements.where((F.col("created_at") >= as_of_ts(as_of) - F.expr(f"INTERVAL {lookback_days} DAYS"))
                             & (F.col("created_at") <= as_of_ts(as_of)))
    pavg = recent.groupBy("depot_id", "product_id").agg(F.avg("quantity").alias("product_avg"))
    j = m.join(base, ["depot_id", "product_category"], "left").join(pavg, ["depot_id", "product_id"], "left")
    codes = F.create_map(*[x for k, v in MOVEMENT_CODES.items() for x in (F.lit(k), F.lit(v))])
    q = F.col("quantity")
    return j.select(
        "movement_id", "batch_id", "product_id", "depot_id",
        F.hour("created_at").alias("hour_of_day"),
        F.weekday("created_at").alias("day_of_week"),
        F.greatest(F.coalesce(days_between(F.col("created_at"), F.col("batch_created_at")), F.lit(0)),
                   F.lit(0)).cast("int").alias("batch_age_days"),
        F.coalesce(codes[F.col("movement_type")], F.lit(0)).alias("movement_type_enc"),
        F.when(F.col("mean").isNull(), F.lit(0.0)).otherwise((q - F.col("mean")) / F.col("std"))
         .alias("quantity_zscore"),
        ((q - F.coalesce(F.col("product_avg"), q))
         / F.greatest(F.coalesce(F.col("product_avg"), F.lit(1.0)), F.lit(1.0))).alias("velocity_deviation"),
        q.alias("quantity"),
    )


def score_movements(movements: DataFrame, baselines: DataFrame,
                    keys: tuple = ("depot_id", "product_category")) -> DataFrame:
    """A-3: z = |q − mean| ÷ max(std, 1); unknown category → 0."""
    j = movements.join(baselines, list(keys), "left")
    z = F.when(F.col("mean").isNull(), F.lit(0.0)).otherwise(
        F.abs(F.col("quantity") - F.col("mean")) / F.greatest(F.col("std"), F.lit(1.0)))
    return j.withColumn("z_score", z).drop("mean", "std")


def anomaly_flags(movements: DataFrame, products: DataFrame, as_of: str, hold: float = 2.5,
                  alert: float = 2.0, recent_days: int = 2, lookback_days: int = 30) -> DataFrame:
    """A-4: score the last 2 days' movements against the 30-day (depot,
    category) baseline; z > hold → ANOMALY_HOLD, z > alert → ANOMALY_ALERT
    (strict), other rows dropped; z rounded to 2."""
    base = category_baselines(movements, products, as_of, lookback_days)
    recent = movements.where((F.col("created_at") >= as_of_ts(as_of) - F.expr(f"INTERVAL {recent_days} DAYS"))
                             & (F.col("created_at") <= as_of_ts(as_of)))
    recent = recent.join(products.select("product_id", "product_category"), "product_id")
    s = score_movements(recent, base)
    action = F.when(F.col("z_score") > hold, "ANOMALY_HOLD").when(F.col("z_score") > alert, "ANOMALY_ALERT")
    s = py_round_cols(s.withColumn("action", action), {"z_score_r": ("z_score", 2)})
    return s.select("depot_id", "movement_id", "batch_id", "product_id",
                    F.col("z_score_r").alias("z_score"), "action",
                    F.col("quantity").cast("double").alias("quantity"), "movement_type") \
            .where(F.col("action").isNotNull())


def temperature_anomalies(readings: DataFrame, hold: float = 2.5, alert: float = 2.0,
                          value_col: str = "temperature") -> DataFrame:
    """A-5: per-device mean/std over all readings (nulls skipped, std 0/null
    → 1); z = |t − mean| ÷ std; all rows kept with z, action, is_excursion."""
    base = readings.groupBy("device_id").agg(F.avg(value_col).alias("_mean"),
                                             _std_or_one(F.stddev_samp(value_col)).alias("_std"))
    j = readings.join(base, "device_id", "left")
    z = F.when(F.col("_mean").isNull() & F.col(value_col).isNotNull(), F.lit(0.0)) \
         .otherwise(F.abs((F.col(value_col) - F.col("_mean")) / F.col("_std")))
    action = F.when(z > hold, "ANOMALY_HOLD").when(z > alert, "ANOMALY_ALERT")
    return j.select(*readings.columns, z.alias("z_score"), action.alias("action"),
                    action.isNotNull().alias("is_excursion"))
