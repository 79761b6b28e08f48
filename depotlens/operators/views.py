"""Output views (J-*): narrow score tables enriched for the decision rules.

Score tables carry ``run_date``; demand is joined on (product, depot,
run_date).  The product table is a small dimension (AQE broadcasts it after
measuring it); batches join by key with a shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def v_expiry_predictions(expiry: DataFrame, batches: DataFrame, products: DataFrame) -> DataFrame:
    """J-1: expiry ⋈ batches ⋈ products → remaining_qty, ptr, product_name."""
    b = batches.select(F.col("batch_id"), F.col("product_id").alias("b_product_id"),
                       F.col("quantity_remaining").alias("remaining_qty"))
    p = products.select(F.col("product_id").alias("b_product_id"), "ptr",
                        F.col("canonical_name").alias("product_name"))
    return expiry.drop("product_id").join(b, "batch_id").join(p, "b_product_id") \
                 .withColumnRenamed("b_product_id", "product_id")


def v_stockout_risks(stockout: DataFrame, products: DataFrame, demand: DataFrame) -> DataFrame:
    """J-2: stockout ⋈ products ⟕ demand on (product, depot, run_date)."""
    p = products.select("product_id", F.col("canonical_name").alias("product_name"))
    d = demand.select("product_id", "depot_id", "run_date", "predicted_units_14d")
    return stockout.join(p, "product_id").join(d, ["product_id", "depot_id", "run_date"], "left")


def v_fefo_rankings(fefo: DataFrame, batches: DataFrame, products: DataFrame, demand: DataFrame) -> DataFrame:
    """J-3: fefo ⋈ batches ⋈ products ⟕ demand (product taken from batches)."""
    f = fefo.select("depot_id", "batch_id", "run_date", "priority_rank", "priority_score", "ml_override",
                    "expiry_risk_score", "days_till_expiry")
    b = batches.select("batch_id", "product_id", F.col("quantity_remaining").alias("units_available"),
                       "expiry_date")
    p = products.select("product_id", F.col("canonical_name").alias("product_name"))
    d = demand.select("product_id", "depot_id", "run_date", "predicted_units_14d")
    return f.join(b, "batch_id").join(p, "product_id").join(d, ["product_id", "depot_id", "run_date"], "left")


def v_anomaly_flags(flags: DataFrame, products: DataFrame) -> DataFrame:
    """J-4: flags ⟕ products; product_name = coalesce(product, stored)."""
    p = products.select("product_id", F.col("canonical_name").alias("_pname"))
    stored = F.col("product_name") if "product_name" in flags.columns else F.lit(None).cast("string")
    j = flags.join(p, "product_id", "left")
    return j.select(*[c for c in flags.columns if c != "product_name"],
                    F.coalesce(F.col("_pname"), stored).alias("product_name"))
