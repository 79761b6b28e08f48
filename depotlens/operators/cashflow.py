"""Net cash flow of the last 14 days (G-3)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.tpch import as_of_lit


def net_cashflow(transactions: DataFrame, depots: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """G-3: Σ(INFLOW +, OUTFLOW −, other 0) since as_of − 14 days per depot
    (depots without rows → 0) and whether it is negative."""
    t = transactions.where((F.col("transaction_date") >= F.date_sub(as_of_lit(as_of), days))
                           & (F.col("transaction_date") <= as_of_lit(as_of)))
    signed = (F.when(F.col("transaction_type") == "INFLOW", F.col("amount"))
              .when(F.col("transaction_type") == "OUTFLOW", -F.col("amount")).otherwise(F.lit(0)))
    g = t.groupBy("depot_id").agg(F.sum(signed).alias("net"))
    j = depots.select("depot_id").join(g, "depot_id", "left")
    net = F.coalesce(F.col("net").cast("double"), F.lit(0.0))
    return j.select("depot_id", net.alias("net_14d"), (net < 0).alias("cashflow_negative"))
