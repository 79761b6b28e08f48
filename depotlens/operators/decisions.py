"""Rule-based decisions over the scores and conflict resolution (G-*).

Each rule maps one enriched view to decision rows with a common schema;
all depots at once.  Thresholds come from an explicit ``Config`` (H-6).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import ACTION_PRIORITY, RULE_ORDER, Config
from ..functions.numeric import py_round_cols
from ..functions.text import fmt_fixed, fmt_pct0, fmt_thousands0
from .ranking import rank_within

DECISION_COLS = ["depot_id", "agent", "action_type", "approval_tier", "batch_id", "product_id",
                 "conflict_key", "rule_no", "reason", "payload"]


def _decision(df: DataFrame, agent: str, rule: str, action: Column, tier: Column, key: Column,
              reason: Column, payload: Column, batch: Column | None = None,
              product: Column | None = None) -> DataFrame:
    """Common decision schema; ``reason`` is projected first so the payload
    refers to it instead of repeating the formatting expressions."""
    df = df.withColumn("reason", reason)
    reason = F.col("reason")
    return df.select(
        "depot_id", F.lit(agent).alias("agent"), action.alias("action_type"), tier.alias("approval_tier"),
        (batch if batch is not None else F.lit(None).cast("string")).alias("batch_id"),
        (product if product is not None else F.lit(None).cast("string")).alias("product_id"),
        key.alias("conflict_key"), F.lit(RULE_ORDER.index(rule) + 1).alias("rule_no"),
        reason.alias("reason"), F.to_json(payload).alias("payload"))


def conflict_key_default(action: Column, batch: Column, product: Column, depot: Column) -> Column:
    """G-7: action + batch id, else product id, else depot id."""
    return F.concat(action, F.lit("_"), F.coalesce(F.nullif(batch, F.lit("")), F.nullif(product, F.lit("")), depot))


def anomaly_decisions(flags_view: DataFrame) -> DataFrame:
    """G-1: HOLD → (ANOMALY_HOLD, APPROVE); otherwise (ANOMALY_ALERT, NOTIFY)."""
    f = flags_view.withColumn("_z", F.coalesce(F.col("z_score").cast("double"), F.lit(0.0))) \
                  .withColumn("_q", F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))) \
                  .withColumn("_name", F.coalesce(F.col("product_name"), F.lit("Unknown")))
    f = py_round_cols(f, {"_z1": ("_z", 1), "_q0": ("_q", 0)})
    hold = F.col("action") == "ANOMALY_HOLD"
    reason = F.concat(F.col("_name"), F.lit(": Z-score "), fmt_fixed("_z1", 1), F.lit(" on "),
                      F.coalesce(F.col("movement_type"), F.lit("")), F.lit(" of "), fmt_fixed("_q0", 0),
                      F.lit(" units — "),
                      F.when(hold, F.lit("batch HELD pending investigation.")).otherwise(F.lit("flagged for review.")))
    payload = F.struct(F.col("_z").alias("z_score"), F.col("_q").alias("quantity"), "movement_type", "movement_id",
                       F.col("_name").alias("product_name"), reason.alias("reason"))
    return _decision(f, "AnomalyAgent", "anomaly",
                     F.when(hold, "ANOMALY_HOLD").otherwise("ANOMALY_ALERT"),
                     F.when(hold, "APPROVE").otherwise("NOTIFY"),
                     F.concat(F.lit("anomaly_"), F.coalesce(F.col("batch_id"), F.lit(""))), reason, payload,
                     batch=F.col("batch_id"), product=F.col("product_id"))


def expiry_decisions(expiry_view: DataFrame, config: Config) -> DataFrame:
    """G-2: risk ≥ critical → (SUGGEST_LIQUIDATION, APPROVE) with loss =
    round(remaining·ptr, 2); risk ≥ warning → (FLAG_PRIORITY_DISPATCH,
    NOTIFY); both inclusive.  Null remaining/ptr count as 0 (H-3)."""
    crit = float(config.get("expiry_critical_threshold"))
    warn = float(config.get("expiry_warning_threshold"))
    e = (expiry_view
         .withColumn("_risk", F.coalesce(F.col("expiry_risk_score").cast("double"), F.lit(0.0)))
         .withColumn("_rem", F.coalesce(F.col("remaining_qty").cast("double"), F.lit(0.0)))
         .withColumn("_ptr", F.coalesce(F.col("ptr").cast("double"), F.lit(0.0)))
         .withColumn("_name", F.coalesce(F.col("product_name"), F.lit("Unknown")))
         .withColumn("_liq", F.coalesce(F.col("recommended_liquidation_date").cast("string"), F.lit("")))
         .withColumn("_loss_raw", F.col("_rem") * F.col("_ptr")))
    e = py_round_cols(e.where(F.col("_risk") >= warn), {"_loss": ("_loss_raw", 2), "_risk2": ("_risk", 2)})
    e = py_round_cols(e, {"_loss0": ("_loss", 0)})
    is_crit = F.col("_risk") >= crit
    reason = F.when(is_crit, F.concat(F.col("_name"), F.lit(": expiry risk "), fmt_pct0("_risk2"),
                                      F.lit(" — critical. Liquidate by "), F.col("_liq"), F.lit(" or lose ₹"),
                                      fmt_thousands0("_loss0"), F.lit("."))) \
              .otherwise(F.concat(F.col("_name"), F.lit(": expiry risk "), fmt_pct0("_risk2"),
                                  F.lit(" — priority dispatch recommended.")))
    payload = F.struct(F.col("_risk").alias("risk_score"), F.col("_liq").alias("recommended_liquidation_date"),
                       F.when(is_crit, F.col("_loss")).alias("estimated_loss_if_ignored_inr"),
                       F.col("_rem").alias("remaining_qty"), F.col("_name").alias("product_name"),
                       "method", reason.alias("reason"))
    return _decision(e, "ExpiryPreventionAgent", "expiry",
                     F.when(is_crit, "SUGGEST_LIQUIDATION").otherwise("FLAG_PRIORITY_DISPATCH"),
                     F.when(is_crit, "APPROVE").otherwise("NOTIFY"),
                     F.concat(F.lit("expiry_"), F.col("batch_id")), reason, payload,
                     batch=F.col("batch_id"), product=F.col("product_id"))


def liquidation_products(expiry_view: DataFrame, config: Config) -> DataFrame:
    """G-8: (depot, product) with an expiry risk ≥ critical."""
    crit = float(config.get("expiry_critical_threshold"))
    return expiry_view.where(F.col("expiry_risk_score") >= crit).select("depot_id", "product_id").distinct()


def held_batches(flags_view: DataFrame) -> DataFrame:
    """G-8: (depot, batch) under ANOMALY_HOLD."""
    return flags_view.where(F.col("action") == "ANOMALY_HOLD").select("depot_id", "batch_id").distinct()


def reorder_decisions(stockout_view: DataFrame, liquidating: DataFrame, cashflow: DataFrame,
                      reduction: float = 0.30) -> DataFrame:
    """G-4: skip products under liquidation (anti join); only when days <
    1.5·lead; qty = max(trunc(units_14d), 1), with negative cash flow
    max(trunc(qty·0.7), 1); days < lead → (APPROVE, CRITICAL) else
    (NOTIFY, NORMAL).  The rule's own 30 % reduction is used, as in the
    reference (the configured key is never read)."""
    s = stockout_view.join(liquidating, ["depot_id", "product_id"], "left_anti") \
                     .join(cashflow.select("depot_id", "cashflow_negative"), "depot_id", "left")
    s = (s.withColumn("_days", F.coalesce(F.col("days_until_stockout").cast("double"), F.lit(0.0)))
          .withColumn("_lead", F.coalesce(F.col("lead_time_days").cast("double"), F.lit(7.0)))
          .withColumn("_u14", F.coalesce(F.col("predicted_units_14d").cast("double"), F.lit(0.0)))
          .withColumn("_neg", F.coalesce(F.col("cashflow_negative"), F.lit(False)))
          .withColumn("_name", F.coalesce(F.col("product_name"), F.lit("Unknown"))))
    s = s.where(F.col("_days") < F.col("_lead") * 1.5)
    base = F.greatest(F.floor(F.col("_u14")).cast("long"), F.lit(1))
    qty = F.when(F.col("_neg"), F.greatest(F.floor(base * (1 - reduction)).cast("long"), F.lit(1))).otherwise(base)
    s = py_round_cols(s.withColumn("_qty", qty), {"_days0": ("_days", 0), "_lead0": ("_lead", 0),
                                                  "_days_r": ("_days", 1)})
    critical = F.col("_days") < F.col("_lead")
    reason = F.concat(F.col("_name"), F.lit(": stock out in "), fmt_fixed("_days0", 0), F.lit(" days (lead time "),
                      fmt_fixed("_lead0", 0), F.lit(" days). Suggest ordering "), F.col("_qty").cast("string"),
                      F.lit(" units."),
                      F.when(F.col("_neg"), F.lit(" [qty reduced 30% — cashflow negative]")).otherwise(F.lit("")))
    payload = F.struct(F.col("_name").alias("product_name"), F.col("_qty").alias("reorder_qty"),
                       F.col("_days_r").alias("days_until_stockout"), F.col("_lead").alias("lead_time_days"),
                       F.col("current_stock").cast("double").alias("current_stock"),
                       F.when(critical, "CRITICAL").otherwise("NORMAL").alias("urgency"),
                       F.col("_neg").alias("cashflow_adjusted"), reason.alias("reason"))
    return _decision(s, "ReorderAgent", "reorder", F.lit("SUGGEST_REORDER"),
                     F.when(critical, "APPROVE").otherwise("NOTIFY"),
                     F.concat(F.lit("reorder_"), F.col("product_id")), reason, payload,
                     product=F.col("product_id"))


def dispatch_decisions(fefo_view: DataFrame, held: DataFrame, demand: DataFrame | None = None) -> DataFrame:
    """G-5: skip held batches; units = min(available, predicted 14-day units)
    (view value, else the forecast of the product in the depot, else 0);
    drop ≤ 0; (DISPATCH_PLAN, AUTO).  Demand is not shared out between the
    batches of a product, as in the reference."""
    f = fefo_view.join(held, ["depot_id", "batch_id"], "left_anti")
    if demand is not None:
        d = demand.select("depot_id", "product_id", F.col("predicted_units_14d").alias("_fd"))
        f = f.join(d, ["depot_id", "product_id"], "left")
    else:
        f = f.withColumn("_fd", F.lit(None).cast("double"))
    f = (f.withColumn("_avail", F.coalesce(F.col("units_available").cast("double"), F.lit(0.0)))
          .withColumn("_d14", F.coalesce(F.col("predicted_units_14d").cast("double"), F.col("_fd"), F.lit(0.0)))
          .withColumn("_name", F.coalesce(F.col("product_name"), F.lit("Unknown"))))
    f = f.withColumn("_units", F.least("_avail", "_d14")).where(F.col("_units") > 0)
    f = py_round_cols(f, {"_units0": ("_units", 0), "_avail0": ("_avail", 0)})
    reason = F.concat(F.col("_name"), F.lit(": dispatch "), fmt_fixed("_units0", 0), F.lit(" units (expires in "),
                      F.col("days_till_expiry").cast("string"), F.lit("d, rank #"),
                      F.col("priority_rank").cast("string"), F.lit(")"))
    payload = F.struct(F.col("_units0").alias("units_to_dispatch"), F.col("_avail0").alias("units_available"),
                       F.col("_d14").alias("predicted_units_14d"), "days_till_expiry",
                       F.col("expiry_date").cast("string").alias("expiry_date"), "priority_rank", "ml_override",
                       F.col("_name").alias("product_name"), reason.alias("reason"))
    return _decision(f, "DispatchAgent", "dispatch", F.lit("DISPATCH_PLAN"), F.lit("AUTO"),
                     F.concat(F.lit("dispatch_"), F.col("batch_id")), reason, payload,
                     batch=F.col("batch_id"), product=F.col("product_id"))


def priority_of(action: Column) -> Column:
    m = F.create_map(*[x for k, v in ACTION_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[action], F.lit(99))


def resolve_decisions(decisions: list[DataFrame]) -> DataFrame:
    """G-6: union of the rule outputs; SUGGEST_REORDER dropped for products
    of the depot with a SUGGEST_LIQUIDATION; ordered per depot by priority,
    then rule order, then the natural key (``seq``).  The per-depot order is
    a skew-safe rank, not a global single-partition sort."""
    u = decisions[0]
    for d in decisions[1:]:
        u = u.unionByName(d)
    liq = u.where(F.col("action_type") == "SUGGEST_LIQUIDATION").where(F.col("product_id").isNotNull()) \
           .select("depot_id", "product_id").distinct()
    reorders = u.where(F.col("action_type") == "SUGGEST_REORDER").join(liq, ["depot_id", "product_id"], "left_anti")
    kept = u.where(F.col("action_type") != "SUGGEST_REORDER").unionByName(reorders)
    kept = kept.withColumn("priority", priority_of(F.col("action_type")))
    return rank_within(kept, ["depot_id"], ["priority", "rule_no", "conflict_key", "batch_id", "product_id"],
                       name="seq")


def run_rule(name: str, state: dict, config: Config) -> DataFrame:
    """Run one rule by name; unknown name → ValueError."""
    rules = {
        "anomaly": lambda: anomaly_decisions(state["anomaly_view"]),
        "expiry": lambda: expiry_decisions(state["expiry_view"], config),
        "reorder": lambda: reorder_decisions(state["stockout_view"],
                                             liquidation_products(state["expiry_view"], config),
                                             state["cashflow"]),
        "dispatch": lambda: dispatch_decisions(state["fefo_view"], held_batches(state["anomaly_view"]),
                                               state.get("demand")),
    }
    if name not in rules:
        raise ValueError(f"Unknown rule: '{name}'. Available: {sorted(rules)}")
    return rules[name]()


def run_status(outcomes: DataFrame) -> DataFrame:
    """G-9: from (depot_id, stage, outcome): demand FAILED → FAILED; any
    FAILED or FALLBACK → PARTIAL; else SUCCESS."""
    g = outcomes.groupBy("depot_id").agg(
        F.bool_or((F.col("stage") == "demand") & (F.col("outcome") == "FAILED")).alias("_df"),
        F.bool_or(F.col("outcome").isin("FAILED", "FALLBACK")).alias("_any"))
    return g.select("depot_id", F.when(F.col("_df"), "FAILED").when(F.col("_any"), "PARTIAL")
                    .otherwise("SUCCESS").alias("status"))


def run_summary(status: DataFrame) -> DataFrame:
    """G-9: one row with the number of depots and of each run status."""
    return status.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == x).alias(x.lower()) for x in ("SUCCESS", "PARTIAL", "FAILED")])


def notify_queue(status: DataFrame, excursion_alerts: DataFrame | None, run_date: str) -> DataFrame:
    """G-10: queued alert rows – one per depot whose run FAILED and one per
    temperature excursion – with a JSON payload."""
    failed = status.where(F.col("status") == "FAILED").select(
        "depot_id", F.lit("PIPELINE_FAILED").alias("alert_type"),
        F.to_json(F.struct("depot_id", "status", F.lit(run_date).alias("run_date"))).alias("payload"))
    out = failed
    if excursion_alerts is not None:
        out = out.unionByName(excursion_alerts.select("depot_id", "alert_type", "payload"))
    return out.withColumn("status", F.lit("QUEUED"))


def compliance_snapshot(depots: DataFrame, alerts: DataFrame) -> DataFrame:
    """G-11: open (queued) alerts per depot; ``ok`` when none, else
    ``attention``."""
    open_ = alerts.where(F.col("status") == "QUEUED").groupBy("depot_id").agg(F.count(F.lit(1)).alias("open_issues"))
    j = depots.select("depot_id").join(open_, "depot_id", "left")
    n = F.coalesce(F.col("open_issues"), F.lit(0)).cast("long")
    return j.select("depot_id", n.alias("open_issues"), F.when(n == 0, "ok").otherwise("attention").alias("status"))
