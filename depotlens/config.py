"""Thresholds and lookup values.

``DEFAULTS`` are the fallback values used when no configuration row exists.
Lookup order for a key is: depot row -> global row -> ``DEFAULTS`` (the
reference reads rows without regard to depot, H-9; we resolve it).
"""
from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
DEFAULTS: dict = {
    "fefo_override_threshold": 0.6,
    "expiry_critical_threshold": 0.85,
    "expiry_warning_threshold": 0.60,
    "anomaly_hold_threshold": 2.5,
    "anomaly_alert_threshold": 2.0,
    "temp_cold_chain_min": 2.0,
    "temp_cold_chain_max": 8.0,
    "temp_general_min": 15.0,
    "temp_general_max": 25.0,
    "temp_deep_freeze": -20.0,
    "expiry_alert_days_critical": 30,
    "expiry_alert_days_warning": 60,
    "expiry_alert_days_early": 120,
    "default_lead_time_days": 7,
    "dso_warning_threshold": 60,
    "cashflow_reorder_reduction": 0.3,
    "exact_match_tolerance": 0.01,
    "consolidated_match_tolerance": 0.02,
    "consolidation_invoice_limit": 5,
    "approval_expiry_hours": 24,
    "iot_silence_alert_minutes": 35,
    "festival_dates": [
        "2025-10-02", "2025-10-12", "2025-10-20",
        "2025-10-23", "2025-11-05", "2025-11-15",
        "2025-12-25", "2026-01-14", "2026-01-26",
        "2026-03-14", "2026-04-06", "2026-04-14",
        "2026-06-13", "2026-08-15", "2026-09-29",
        "2026-10-20", "2026-11-08",
    ],
    "mape_target": 0.15,
    "auc_target": 0.80,
    "recall_target": 0.85,
}

# Historical expiry base rate by product category (default 0.20).
CATEGORY_RISK = {
    "antibiotic": 0.25,
    "cold_chain": 0.40,
    "seasonal_otc": 0.35,
    "vitamin": 0.15,
    "pain_relief": 0.10,
    "antidiabetic": 0.20,
    "cardiac": 0.20,
    "gi": 0.18,
    "respiratory": 0.22,
    "thyroid": 0.12,
}
CATEGORY_RISK_DEFAULT = 0.20

# Peak-demand months by category; a category not listed peaks all year.
ALL_YEAR = list(range(1, 13))
PEAK_MONTHS = {
    "antibiotic": [10, 11, 12, 1, 2, 3],
    "cold_chain": ALL_YEAR,
    "otc_cold": [10, 11, 12, 1, 2],
    "ors": [6, 7, 8, 9],
    "antidiabetic": ALL_YEAR,
    "vitamin": [10, 11, 12, 1],
    "pain_relief": ALL_YEAR,
    "gi": [4, 5, 6, 7, 8, 9],
    "respiratory": [10, 11, 12, 1, 2],
    "cardiac": ALL_YEAR,
    "thyroid": ALL_YEAR,
}

# Movement type codes of the anomaly features (unknown -> 0).
MOVEMENT_CODES = {"IN": 0, "OUT": 1, "RETURN": 2, "WRITE_OFF": 3, "TRANSFER": 4}

# Decision priorities (lower runs first) and rule order for ties.
ACTION_PRIORITY = {
    "ANOMALY_HOLD": 1,
    "SUGGEST_LIQUIDATION": 2,
    "FLAG_PRIORITY_DISPATCH": 3,
    "SUGGEST_REORDER": 4,
    "DISPATCH_PLAN": 5,
    "ANOMALY_ALERT": 6,
}
RULE_ORDER = ["anomaly", "expiry", "reorder", "dispatch"]

# Request-burst limits per key kind (per 60 s session of hits).
BURST_LIMITS = {"user": 500, "ip": 100}
BURST_GAP_SECONDS = 60
# ---------------------------------------------------------------------------


@dataclass
class Config:
    """Resolved thresholds passed explicitly to every operator (H-6)."""
    values: dict = field(default_factory=lambda: dict(DEFAULTS))

    def get(self, key, default=None):
        return self.values.get(key, DEFAULTS.get(key, default))

    def with_overrides(self, **kw) -> "Config":
        v = dict(self.values)
        v.update(kw)
        return Config(v)


def parse_value(text):
    """Config values are JSON text when they parse, else plain text."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return text


def resolve_config(config_rows: DataFrame, depots: DataFrame) -> DataFrame:
    """SRC-10: per (depot, key) the effective value: depot row, then global
    row (``depot_id IS NULL``), then the built-in default.

    ``config_rows(depot_id, key, value)`` is a small table.  Each depot gets
    the known keys by exploding a literal key list (no cross join).
    """
    spark = config_rows.sparkSession
    defaults = spark.createDataFrame(
        [(k, json.dumps(v)) for k, v in DEFAULTS.items()], "key string, default_value string")
    per_depot = config_rows.where(F.col("depot_id").isNotNull()).groupBy("depot_id", "key").agg(
        F.max("value").alias("depot_value"))
    glob = config_rows.where(F.col("depot_id").isNull()).groupBy("key").agg(
        F.max("value").alias("global_value"))
    grid = depots.select("depot_id", F.explode(F.array(*[F.lit(k) for k in DEFAULTS])).alias("key"))
    grid = grid.unionByName(per_depot.select("depot_id", "key")).distinct()
    return (grid.join(per_depot, ["depot_id", "key"], "left")
            .join(glob, "key", "left")
            .join(defaults, "key", "left")
            .select("depot_id", "key",
                    F.coalesce("depot_value", "global_value", "default_value").alias("value")))
