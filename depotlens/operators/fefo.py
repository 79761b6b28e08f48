"""First-expiry-first-out dispatch ranking (F-1)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import py_round_cols
from ..sources.tpch import as_of_lit
from .ranking import rank_within


def fefo_rank(active: DataFrame, expiry: DataFrame | None, as_of: str, threshold: float = 0.6,
              skew_safe: bool = True) -> DataFrame:
    """F-1: override = risk > threshold (strict); score = −1000·risk when
    overridden else days to expiry; rank ascending per depot with batch_id
    as the tie-break.  The per-depot rank is computed skew-safely: a depot
    holds a large share of all batches, so it must not be one window task."""
    a = active.select("batch_id", "product_id", "depot_id", "expiry_date", "quantity_remaining")
    if expiry is not None:
        a = a.join(expiry.select("batch_id", "expiry_risk_score"), "batch_id", "left")
    else:
        a = a.withColumn("expiry_risk_score", F.lit(None).cast("double"))
    risk = F.coalesce(F.col("expiry_risk_score"), F.lit(0.0))
    days = F.datediff("expiry_date", as_of_lit(as_of))
    override = risk > threshold
    score = F.when(override, -(risk * 1000)).otherwise(days.cast("double"))
    r = a.select("batch_id", "product_id", "depot_id", "expiry_date",
                 F.col("quantity_remaining").cast("double").alias("remaining_qty"),
                 risk.alias("_risk"), override.alias("ml_override"),
                 days.alias("days_till_expiry"), score.alias("_score"))
    r = py_round_cols(r, {"expiry_risk_score": ("_risk", 3), "priority_score": ("_score", 4)})
    r = r.select("batch_id", "product_id", "depot_id", "expiry_date", "remaining_qty",
                 "expiry_risk_score", "ml_override", "days_till_expiry", "priority_score")
    if skew_safe:
        return rank_within(r, ["depot_id"], ["priority_score", "batch_id"], name="priority_rank")
    from pyspark.sql import Window
    return r.withColumn("priority_rank", F.row_number().over(
        Window.partitionBy("depot_id").orderBy("priority_score", "batch_id")))
