"""Nightly scoring for all depots in one lazy plan, and its sinks.

demand → (expiry ∥ stock-out) → FEFO → anomaly → decisions, every stage a
DataFrame keyed by depot, with one explicit ``run_date`` (H-10).  Stages
with several consumers (demand, expiry) are written once to the shared
checkpoint folder by ``run_nightly`` so they are not recomputed and survive
executor loss.
"""
from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..config import Config
from ..operators import anomaly, cashflow, decisions, demand, expiry, fefo, stockout, views
from ..sources import tpch
from .catalog import Catalog


class Scores:
    """Score stages for all active depots, built on first use.  With
    ``c.materialize`` a stage read by several consumers (demand, active
    batches, expiry) is checkpointed to the shared folder when first built,
    so a query that needs only one view does not compute the others.

    ``history``: folder of earlier runs.  A depot for which demand, expiry or
    FEFO gives no rows goes on with its rows of the day before (SRC-11); the
    ``*_today`` stages are what this run itself found and what it writes."""

    def __init__(self, c: Catalog, config: Config, history: str | None = None):
        self.c, self.config, self.rd, self.history = c, config, c.as_of, history

    def _or_before(self, today: DataFrame, name: str) -> DataFrame:
        if self.history is None:
            return today
        from .sinks import DatedTable
        day = str(date.fromisoformat(self.rd) - timedelta(days=1))
        before = DatedTable(self.c.spark, f"{self.history}/{name}").read(today.schema, [day])
        found = previous_run_fallback(today, before, self.c.depots.where("is_active"), self.rd)
        # the rules look at one run date
        return found.drop("source").withColumn("run_date", F.lit(self.rd).cast("date"))

    def _mat(self, df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True) if self.c.materialize else df

    def _active_only(self, df: DataFrame) -> DataFrame:
        # FIL-3: only active depots enter a run (the depot table is a small dimension)
        return df.join(self.c.depots.where("is_active").select("depot_id"), "depot_id", "left_semi")

    @cached_property
    def demand(self) -> DataFrame:
        return self._or_before(self.demand_today, "demand_predictions")

    @cached_property
    def demand_today(self) -> DataFrame:
        c = self.c
        return self._mat(_dated(demand.forecast_fallback(
            demand.daily_demand(c.movements, c.products, c.depots.where("is_active"), self.rd)), self.rd))

    @cached_property
    def active(self) -> DataFrame:
        c = self.c
        return self._mat(expiry.active_batches(c.batches, c.products, c.movements, self.rd))

    @cached_property
    def expiry_all(self) -> DataFrame:
        return self._mat(_dated(expiry.expiry_risk_formula(self.active, self.rd), self.rd))

    @cached_property
    def expiry(self) -> DataFrame:
        return self._or_before(self.expiry_today, "expiry_predictions")

    @cached_property
    def expiry_today(self) -> DataFrame:
        return self._active_only(self.expiry_all)

    @cached_property
    def stockout(self) -> DataFrame:
        c = self.c
        return self._active_only(_dated(stockout.stockout_risk(
            c.movements, c.products, self.demand, int(self.config.get("default_lead_time_days"))), self.rd))

    @cached_property
    def fefo(self) -> DataFrame:
        return self._or_before(self.fefo_today, "fefo_rankings")

    @cached_property
    def fefo_today(self) -> DataFrame:
        return self._active_only(_dated(fefo.fefo_rank(
            self.active, self.expiry_all, self.rd, float(self.config.get("fefo_override_threshold"))), self.rd))

    @cached_property
    def anomaly(self) -> DataFrame:
        c = self.c
        return self._active_only(_dated(anomaly.anomaly_flags(
            tpch.anomaly_movements(c.movements), c.products, self.rd,
            float(self.config.get("anomaly_hold_threshold")),
            float(self.config.get("anomaly_alert_threshold"))), self.rd))

    @cached_property
    def cashflow(self) -> DataFrame:
        c = self.c
        return self._active_only(cashflow.net_cashflow(c.payment_transactions, c.depots, self.rd))


def _dated(df: DataFrame, run_date: str) -> DataFrame:
    return df.withColumn("run_date", F.lit(run_date).cast("date"))


def score_all(c: Catalog, config: Config | None = None) -> Scores:
    """All score stages (built lazily, see ``Scores``)."""
    return Scores(c, config or Config())


class _LazyState(dict):
    """dict whose values are built on first access."""

    def __init__(self, builders: dict):
        super().__init__()
        self._b = builders

    def __getitem__(self, k):
        if not dict.__contains__(self, k):
            dict.__setitem__(self, k, self._b[k]())
        return dict.__getitem__(self, k)

    def get(self, k, default=None):
        return self[k] if k in self._b else default

    def __contains__(self, k):
        return k in self._b


def decision_state(c: Catalog, s: Scores) -> dict:
    """G-12: the inputs of the rules, restricted to one run_date; each is
    built only when a rule reads it."""
    return _LazyState({
        "expiry_view": lambda: views.v_expiry_predictions(s.expiry, c.batches, c.products),
        "stockout_view": lambda: views.v_stockout_risks(s.stockout, c.products, s.demand),
        "fefo_view": lambda: views.v_fefo_rankings(s.fefo, c.batches, c.products, s.demand),
        "anomaly_view": lambda: views.v_anomaly_flags(s.anomaly, c.products),
        "cashflow": lambda: s.cashflow,
        "demand": lambda: s.demand,
    })


def nightly_decisions(c: Catalog, config: Config | None = None) -> DataFrame:
    config = config or Config()
    st = decision_state(c, score_all(c, config))
    rules = [decisions.run_rule(n, st, config) for n in ("anomaly", "expiry", "reorder", "dispatch")]
    return decisions.resolve_decisions(rules).withColumn("run_date", F.lit(c.as_of).cast("date"))


def stage_outcomes(c: Catalog, s: Scores) -> DataFrame:
    """(depot, stage, outcome) for every active depot.  SUCCESS: the run found
    rows; FALLBACK: it goes on with those of the day before.  Without either,
    demand is FAILED, stock-out SKIPPED, and expiry and FEFO go on empty, which
    the run log also calls FALLBACK."""
    dep = c.depots.where("is_active").select("depot_id")
    frames = {"demand": (s.demand_today, s.demand), "expiry": (s.expiry_today, s.expiry), "stockout": (s.stockout, s.stockout), "fefo": (s.fefo_today, s.fefo)}
    without = {"demand": "FAILED", "stockout": "SKIPPED"}
    out = None
    for stage, (today, used) in frames.items():
        o = dep.join(today.select("depot_id").distinct().withColumn("_has", F.lit(True)), "depot_id", "left")
        if s.history is not None and used is not today:
            o = o.join(used.select("depot_id").distinct().withColumn("_used", F.lit(True)), "depot_id", "left")
        else:
            o = o.withColumn("_used", F.lit(None).cast("boolean"))
        o = o.select("depot_id", F.lit(stage).alias("stage"),
                     F.when(F.col("_has"), "SUCCESS").when(F.col("_used"), "FALLBACK").otherwise(without.get(stage, "FALLBACK")).alias("outcome"))
        out = o if out is None else out.unionByName(o)
    return out


def previous_run_fallback(today: DataFrame, yesterday: DataFrame, depots: DataFrame, run_date: str) -> DataFrame:
    """SRC-11: depots with no rows at ``run_date`` take their rows of
    ``run_date − 1`` (tagged FALLBACK); others keep today's (tagged CURRENT)."""
    have = today.select("depot_id").distinct()
    missing = depots.select("depot_id").join(have, "depot_id", "left_anti")
    prev = yesterday.where(F.col("run_date") == F.date_sub(F.lit(run_date).cast("date"), 1)) \
                    .join(missing, "depot_id", "left_semi")
    return today.withColumn("source", F.lit("CURRENT")).unionByName(prev.withColumn("source", F.lit("FALLBACK")))


def run_nightly(c: Catalog, out_dir: str, config: Config | None = None) -> DataFrame:
    """The nightly run for all active depots: score stages, decisions and the
    run log written to the tables in ``out_dir``.  Keyed upserts for demand,
    expiry and stock-out (SNK-1), partition replace for FEFO and anomaly flags
    (SNK-2), insert-ignore for decisions (SNK-3): a second run of a date gives
    the same tables and leaves decided actions as they are.  Returns the
    per-depot run status; ``decisions.run_summary`` adds it up."""
    from . import sinks
    config = config or Config()
    s = Scores(c, config, history=out_dir)
    st = decision_state(c, s)
    rules = [decisions.run_rule(n, st, config) for n in ("anomaly", "expiry", "reorder", "dispatch")]
    dec = decisions.resolve_decisions(rules).withColumn("run_date", F.lit(c.as_of).cast("date")).withColumn("status", F.lit("PENDING"))
    dec = dec.checkpoint()
    status = decisions.run_status(stage_outcomes(c, s)).withColumn("run_date", F.lit(c.as_of).cast("date")).checkpoint()
    sinks.upsert_by_key(s.demand_today, f"{out_dir}/demand_predictions", ["depot_id", "product_id", "run_date"])
    sinks.upsert_by_key(s.expiry_today, f"{out_dir}/expiry_predictions", ["depot_id", "batch_id", "run_date"])
    sinks.upsert_by_key(s.stockout, f"{out_dir}/stockout_calculations", ["depot_id", "product_id", "run_date"])
    targets = c.depots.where("is_active").select("depot_id", F.lit(c.as_of).cast("date").alias("run_date"))
    sinks.replace_partition(s.fefo_today, f"{out_dir}/fefo_rankings", targets)
    sinks.replace_partition(s.anomaly, f"{out_dir}/anomaly_flags", targets)
    sinks.insert_ignore(dec, f"{out_dir}/agent_actions", ["depot_id", "conflict_key", "run_date"], ["priority", "seq"])
    sinks.upsert_by_key(status, f"{out_dir}/pipeline_run_logs", ["depot_id", "run_date"])
    return status
