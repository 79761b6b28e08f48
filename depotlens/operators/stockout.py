"""Stock-out risk (S-*)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import py_round_cols
from .ledger import _balance


def stockout_risk(movements: DataFrame, products: DataFrame, demand: DataFrame | None,
                  default_lead: int = 7) -> DataFrame:
    """S-1: movement balance per (depot, product) kept when ≥ 0; lead time
    = product lead or 7; rate = max(predicted daily rate, 0.01); days =
    stock ÷ rate; will_stockout = days < lead (strict)."""
    st = movements.groupBy("depot_id", "product_id").agg(_balance().alias("stock"))
    st = st.where(F.col("stock") >= 0).join(products.select("product_id", "lead_time_days"), "product_id")
    if demand is not None:
        st = st.join(demand.select("depot_id", "product_id", "predicted_daily_rate"),
                     ["depot_id", "product_id"], "left")
    else:
        st = st.withColumn("predicted_daily_rate", F.lit(None).cast("double"))
    stock = F.greatest(F.col("stock"), F.lit(0.0))
    lead = F.coalesce(F.col("lead_time_days"), F.lit(default_lead)).cast("double")
    rate = F.greatest(F.coalesce(F.col("predicted_daily_rate"), F.lit(0.0)), F.lit(0.01))
    days = stock / rate
    raw = st.select("depot_id", "product_id", stock.alias("_stock"), days.alias("_days"),
                    lead.alias("lead_time_days"), (days < lead).alias("will_stockout"))
    raw = py_round_cols(raw, {"current_stock": ("_stock", 2), "days_until_stockout": ("_days", 1)})
    return raw.select("depot_id", "product_id", "current_stock", "days_until_stockout", "lead_time_days",
                      "will_stockout")


def stockout_risk_offline(stock: DataFrame, forecast: DataFrame | None, default_lead: int = 7) -> DataFrame:
    """S-2: from a stock table (depot_id, product_id, units_available[,
    lead_time_days]) and a forecast; negative stock clipped to 0, missing
    rate 0.01, missing lead 7."""
    s = stock
    if "lead_time_days" not in s.columns:
        s = s.withColumn("lead_time_days", F.lit(None).cast("double"))
    if forecast is not None:
        s = s.join(forecast.select("depot_id", "product_id", "predicted_daily_rate"),
                   ["depot_id", "product_id"], "left")
    else:
        s = s.withColumn("predicted_daily_rate", F.lit(None).cast("double"))
    stock_v = F.greatest(F.coalesce(F.col("units_available").cast("double"), F.lit(0.0)), F.lit(0.0))
    lead = F.coalesce(F.col("lead_time_days").cast("double"), F.lit(float(default_lead)))
    rate = F.greatest(F.coalesce(F.col("predicted_daily_rate"), F.lit(0.01)), F.lit(0.01))
    days = stock_v / rate
    raw = s.select("depot_id", "product_id", stock_v.alias("_stock"), days.alias("_days"),
                   lead.alias("lead_time_days"), (days < lead).alias("will_stockout"))
    raw = py_round_cols(raw, {"current_stock": ("_stock", 2), "days_until_stockout": ("_days", 1)})
    return raw.select("depot_id", "product_id", "current_stock", "days_until_stockout", "lead_time_days",
                      "will_stockout")
