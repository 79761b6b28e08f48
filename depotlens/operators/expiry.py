"""Expiry: active batches, features, formula score, liquidation date (E-*).

``as_of`` is a DATE and day counts are ``datediff`` between dates (H-1).
Where one side is a timestamp the elapsed time is floored to whole days.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import py_round_cols
from ..config import CATEGORY_RISK, CATEGORY_RISK_DEFAULT
from ..functions.calendar import peak_season
from ..sources.tpch import as_of_lit, as_of_ts
from .ledger import sold_per_batch

FEATURE_COLS = [
    "sales_velocity_weekly", "days_till_expiry", "pct_life_remaining", "seasonality_flag",
    "demand_trend_slope", "velocity_ratio", "category_risk_score", "is_cold_chain", "shelf_life_days",
]


def days_between(end: Column, start: Column) -> Column:
    """Whole days elapsed from ``start`` to ``end`` (floored), for
    timestamp/date mixes."""
    return F.floor((F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / 86400)


def active_batches(batches: DataFrame, products: DataFrame, movements: DataFrame, as_of: str) -> DataFrame:
    """E-1: batches ⋈ products ⟕ ΣOUT; unexpired and received − ΣOUT > 0."""
    rem = F.col("quantity_received") - F.coalesce(F.col("sold_qty"), F.lit(0.0))
    p = products.select("product_id", "product_category", "is_cold_chain", "default_shelf_life_days", "ptr")
    return (batches.join(p, "product_id").join(sold_per_batch(movements), "batch_id", "left")
            .where((F.col("expiry_date") > as_of_lit(as_of)) & (rem > 0))
            .select("batch_id", "product_id", "depot_id", "expiry_date", "quantity_received",
                    rem.alias("quantity_remaining"), "product_category", "is_cold_chain",
                    "default_shelf_life_days", "ptr", "created_at"))


def liquidation_date(as_of: str, remaining: Column, velocity_weekly: Column, buffer_days: int = 14) -> Column:
    """E-10: velocity ≤ 0 → as_of + 7; else as_of + floor(remaining ÷
    (velocity/7)) + buffer.  ``floor`` equals int() for non-negative values (H-2)."""
    days = F.floor(remaining / (velocity_weekly / F.lit(7.0))).cast("int") + F.lit(buffer_days)
    return F.when(velocity_weekly <= 0, F.date_add(as_of_lit(as_of), 7)) \
            .otherwise(F.date_add(as_of_lit(as_of), days))


def expiry_risk_formula(active: DataFrame, as_of: str, decimals: int = 3) -> DataFrame:
    """E-11: time pressure = clip(1 − max(days,0)/max(shelf,1), 0, 1);
    risk = min(0.6·pressure + 0.4·0.5, 1); liquidation date with an assumed
    velocity of 1 unit/week (H-15: slow-mover factor 0.5)."""
    days_left = F.greatest(F.datediff("expiry_date", as_of_lit(as_of)), F.lit(0))
    shelf = F.greatest(F.coalesce(F.col("default_shelf_life_days"), F.lit(365)), F.lit(1))
    pressure = F.least(F.greatest(F.lit(1.0) - days_left / shelf, F.lit(0.0)), F.lit(1.0))
    risk = F.least(pressure * 0.6 + F.lit(0.5) * 0.4, F.lit(1.0))
    remaining = F.greatest(F.col("quantity_remaining").cast("double"), F.lit(0.0))
    raw = active.select(
        "batch_id", "product_id", "depot_id", risk.alias("_risk"),
        liquidation_date(as_of, remaining, F.lit(1.0)).alias("recommended_liquidation_date"))
    raw = py_round_cols(raw, {"expiry_risk_score": ("_risk", decimals)})
    return raw.select("batch_id", "product_id", "depot_id", "expiry_risk_score",
                      "recommended_liquidation_date", F.lit("formula").alias("method"))


def expiry_model_gate(batches: DataFrame, as_of: str, min_expired: int = 50, min_days: int = 180) -> DataFrame:
    """E-12: per depot, use the model iff ≥ 50 expired batches still hold
    stock and the first batch is ≥ 180 days old."""
    g = batches.groupBy("depot_id").agg(
        F.count_if((F.col("expiry_date") < as_of_lit(as_of)) & (F.col("quantity_remaining") > 0))
         .alias("expired_count"),
        F.coalesce(days_between(as_of_ts(as_of), F.min("created_at")), F.lit(0)).cast("long").alias("data_days"))
    return g.withColumn("use_model", (F.col("expired_count") >= min_expired) & (F.col("data_days") >= min_days))


def sales_velocity(batches: DataFrame, movements: DataFrame, as_of: str) -> DataFrame:
    """E-2: Σ OUT of the last 30 days ÷ (30/7); when that is 0 the lifetime
    Σ OUT ÷ max(days(min(expiry, as_of) − created)/7, 1).  Both sums come
    from one grouped pass over the OUT movements."""
    out = movements.where(F.col("movement_type") == "OUT")
    recent = F.col("created_at") >= as_of_ts(as_of) - F.expr("INTERVAL 30 DAYS")
    v = out.groupBy("batch_id").agg(
        F.sum(F.when(recent, F.col("quantity")).otherwise(0.0)).alias("recent_out"),
        F.sum("quantity").alias("total_out"))
    b = batches.select("batch_id", "expiry_date", "created_at").join(v, "batch_id", "left")
    recent_vel = F.coalesce(F.col("recent_out"), F.lit(0.0)) / F.lit(30.0 / 7.0)
    end = F.least(F.col("expiry_date"), as_of_lit(as_of))
    age_weeks = F.greatest(days_between(end, F.col("created_at")) / F.lit(7.0), F.lit(1.0))
    life_vel = F.coalesce(F.col("total_out"), F.lit(0.0)) / age_weeks
    return b.select("batch_id", F.when(recent_vel == 0.0, life_vel).otherwise(recent_vel)
                    .alias("sales_velocity_weekly"))


def category_risk(category: Column) -> Column:
    """E-7: base expiry rate by lower(category), default 0.20."""
    m = F.create_map(*[x for k, v in CATEGORY_RISK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.lower(category)], F.lit(CATEGORY_RISK_DEFAULT))


def expiry_features(batches: DataFrame, products: DataFrame, movements: DataFrame, as_of: str,
                    demand: DataFrame | None = None, category_avg: DataFrame | None = None) -> DataFrame:
    """E-2 … E-9: the 9 features plus the label; nulls in features → 0.

    Category mean velocity (E-6) is a grouped aggregate joined back – never a
    window over a whole category – and a null category gets mean 1.0.
    """
    p = products.select("product_id", "product_category", "is_cold_chain", "default_shelf_life_days")
    b = batches.join(p, "product_id").join(sales_velocity(batches, movements, as_of), "batch_id", "left")
    b = b.withColumn("sales_velocity_weekly", F.coalesce("sales_velocity_weekly", F.lit(0.0)))
    today = as_of_lit(as_of)
    b = (b.withColumn("days_till_expiry", F.datediff("expiry_date", today))
          .withColumn("shelf_life_days", F.greatest(F.col("default_shelf_life_days"), F.lit(1)))
          .withColumn("pct_life_remaining", F.least(F.greatest(
              F.col("days_till_expiry") / F.col("shelf_life_days"), F.lit(0.0)), F.lit(1.0)))
          .withColumn("seasonality_flag", peak_season(F.col("product_category"), F.month(today))))
    if demand is not None:
        b = b.join(demand.select("product_id", "depot_id", "demand_trend_slope"), ["product_id", "depot_id"], "left")
        b = b.withColumn("demand_trend_slope", F.coalesce("demand_trend_slope", F.lit(0.0)))
    else:
        b = b.withColumn("demand_trend_slope", F.lit(0.0))
    if category_avg is None:
        category_avg = (b.where(F.col("product_category").isNotNull()).groupBy("product_category")
                        .agg(F.avg("sales_velocity_weekly").alias("avg_cat_velocity")))
    b = b.join(F.broadcast(category_avg), "product_category", "left") \
         .withColumn("avg_cat_velocity", F.coalesce("avg_cat_velocity", F.lit(1.0)))
    b = (b.withColumn("velocity_ratio", F.least(
            F.col("sales_velocity_weekly") / F.greatest(F.col("avg_cat_velocity"), F.lit(0.1)), F.lit(5.0)))
          .withColumn("category_risk_score", category_risk(F.col("product_category")))
          .withColumn("is_cold_chain", F.col("is_cold_chain").cast("int"))
          .withColumn("label", F.when(F.col("expiry_date") < today,
                                      (F.col("quantity_remaining") > 0).cast("int"))))
    return b.select("batch_id", "product_id", "depot_id",
                    *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURE_COLS], "label")


def expiry_risk_model(active: DataFrame, features: DataFrame, model, as_of: str) -> DataFrame:
    """E-13: score = P(expire unsold) from a fitted Spark ML pipeline whose
    output has a ``probability`` vector; liquidation date from the batch's
    own velocity; rounded to 3 decimals."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(features)
    p = py_round_cols(scored.select("batch_id", vector_to_array("probability")[1].alias("_p"),
                                    "sales_velocity_weekly"), {"expiry_risk_score": ("_p", 3)}).drop("_p")
    a = active.select("batch_id", "product_id", "depot_id", "quantity_remaining")
    return a.join(p, "batch_id").select(
        "batch_id", "product_id", "depot_id", "expiry_risk_score",
        liquidation_date(as_of, F.greatest(F.col("quantity_remaining"), F.lit(0.0)),
                         F.col("sales_velocity_weekly")).alias("recommended_liquidation_date"),
        F.lit("model").alias("method"))
