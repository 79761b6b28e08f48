"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory.  Each reads the whole canonical tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import demand
from .catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("demand_forecast")
def q_demand_forecast(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return demand.demand_forecast(c.movements, c.products, c.depots, c.as_of)


# ---------------------------------------------------------------- helpers
def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round every double column (comparison with the SQL oracle must not
    depend on the summation order of floating-point aggregates)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType

    from ..functions.numeric import py_round_cols
    specs = {f.name: (f.name, decimals) for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    return py_round_cols(df, specs) if specs else df


class Whole(Catalog):
    """All facts, whatever their date: for operators that have no "now"."""

    def __init__(self, spark, sf_dir, **options):
        super().__init__(spark, sf_dir, bounded=False, **options)


def _history(c: Catalog) -> DataFrame:
    return demand.daily_demand(c.movements, c.products, c.depots, c.as_of, days=None)


def _sales(c: Catalog) -> DataFrame:
    return demand.daily_demand(c.movements, c.products, c.depots, c.as_of)


def _forecast(c: Catalog) -> DataFrame:
    return demand.forecast_fallback(_sales(c))


# ---------------------------------------------------------------- demand
@register("daily_demand")
def q_daily_demand(spark, sf_dir):
    return rounded(_sales(Catalog(spark, sf_dir)))


@register("fill_missing_dates")
def q_fill_missing_dates(spark, sf_dir):
    # the daily aggregate feeds the bounds, the pairs and the measures: write it once
    return rounded(demand.fill_missing_dates(_sales(Catalog(spark, sf_dir)).checkpoint(eager=True)))


def _features_cols(df):
    return df.select("product_id", "depot_id", "date", "units_sold", *demand.FEATURE_COLS)


@register("demand_features")
def q_demand_features(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    from ..config import DEFAULTS
    # the daily aggregate feeds the bounds, the pairs, the measures and the
    # code table: write it once instead of re-running the fact join for each
    f = demand.demand_features(demand.fill_missing_dates(_sales(c).checkpoint(eager=True)),
                               DEFAULTS["festival_dates"])
    return rounded(_features_cols(f))


@register("inference_median_fill")
def q_inference_median_fill(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    from ..config import DEFAULTS
    f = demand.demand_features(demand.fill_missing_dates(_sales(c).checkpoint(eager=True)),
                               DEFAULTS["festival_dates"], drop_warmup=False)
    f = _features_cols(f).checkpoint(eager=True)  # read by the medians and by the fill
    return rounded(demand.inference_median_fill(f))


@register("trend_slope")
def q_trend_slope(spark, sf_dir):
    return rounded(demand.trend_slope(_sales(Catalog(spark, sf_dir))))


# ---------------------------------------------------------------- ledger
from ..operators import anomaly, expiry, fefo, ledger, stockout  # noqa: E402
from ..sources import tpch  # noqa: E402


@register("current_stock")
def q_current_stock(spark, sf_dir):
    return ledger.current_stock(Whole(spark, sf_dir).movements)


@register("batch_stock")
def q_batch_stock(spark, sf_dir):
    return ledger.batch_stock(Whole(spark, sf_dir).movements)


@register("stock_ledger")
def q_stock_ledger(spark, sf_dir):
    c = Whole(spark, sf_dir)
    return rounded(ledger.stock_ledger(c.batches, c.products, c.movements, c.as_of, sort=True))


@register("stock_by_product")
def q_stock_by_product(spark, sf_dir):
    c = Whole(spark, sf_dir)
    # the ledger feeds both the rows and the per-product totals: write it once
    led = ledger.stock_ledger(c.batches, c.products, c.movements, c.as_of).checkpoint(eager=True)
    return rounded(ledger.stock_by_product(led))


@register("batch_timeline")
def q_batch_timeline(spark, sf_dir):
    c = Whole(spark, sf_dir)
    return rounded(ledger.batch_timeline(c.batches, c.products, c.movements))


# ---------------------------------------------------------------- expiry
def _active(c: Catalog) -> DataFrame:
    return expiry.active_batches(c.batches, c.products, c.movements, c.as_of)


@register("active_batches")
def q_active_batches(spark, sf_dir):
    return rounded(_active(Catalog(spark, sf_dir)).drop("ptr"))


@register("sales_velocity")
def q_sales_velocity(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return rounded(expiry.sales_velocity(c.batches, c.movements, c.as_of))


@register("expiry_features")
def q_expiry_features(spark, sf_dir):
    c = Catalog(spark, sf_dir, materialize=True)
    return rounded(expiry.expiry_features(c.batches, c.products, c.movements, c.as_of, demand=_forecast(c)))


@register("expiry_risk_formula")
def q_expiry_risk_formula(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return expiry.expiry_risk_formula(_active(c), c.as_of)


@register("expiry_model_gate")
def q_expiry_model_gate(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return expiry.expiry_model_gate(c.batches, c.as_of)


# ---------------------------------------------------------------- stock-out, FEFO
@register("stockout_risk")
def q_stockout_risk(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return stockout.stockout_risk(c.movements, c.products, _forecast(c))


@register("stockout_risk_offline")
def q_stockout_risk_offline(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    stock = ledger.current_stock(c.movements).withColumnRenamed("current_stock", "units_available") \
        .join(c.products.select("product_id", "lead_time_days"), "product_id")
    return stockout.stockout_risk_offline(stock, _forecast(c))


@register("fefo_rank")
def q_fefo_rank(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    a = _active(c)
    return fefo.fefo_rank(a, expiry.expiry_risk_formula(a, c.as_of), c.as_of)


# ---------------------------------------------------------------- anomaly
@register("category_baselines")
def q_category_baselines(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return rounded(anomaly.category_baselines(tpch.anomaly_movements(c.movements), c.products, c.as_of))


@register("anomaly_features")
def q_anomaly_features(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return rounded(anomaly.anomaly_features(tpch.anomaly_movements(c.movements), c.products, c.batches, c.as_of))


@register("anomaly_flags")
def q_anomaly_flags(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return anomaly.anomaly_flags(tpch.anomaly_movements(c.movements), c.products, c.as_of)


@register("temperature_anomalies")
def q_temperature_anomalies(spark, sf_dir):
    return rounded(anomaly.temperature_anomalies(Catalog(spark, sf_dir).readings))


# ---------------------------------------------------------------- reconciliation
from ..operators import cashflow, invoices as invoice_ops, reconcile  # noqa: E402


@register("open_invoices")
def q_open_invoices(spark, sf_dir):
    from pyspark.sql import functions as F
    return reconcile.open_invoices(Whole(spark, sf_dir).invoices).withColumn(
        "total_amount", F.col("total_amount").cast("double"))


@register("match_exact")
def q_match_exact(spark, sf_dir):
    c = Whole(spark, sf_dir)
    return reconcile.match_exact(c.payments, reconcile.open_invoices(c.invoices))


@register("match_partial")
def q_match_partial(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    return reconcile.match_partial(c.payments, reconcile.open_invoices(c.invoices)).withColumn(
        "total_amount", F.col("total_amount").cast("double"))


@register("match_consolidated")
def q_match_consolidated(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    oi = reconcile.open_invoices(c.invoices)
    rest = reconcile.unmatched(c.payments, reconcile.match_exact(c.payments, oi), reconcile.match_partial(c.payments, oi))
    m = reconcile.match_consolidated(rest, oi)
    return m.select("payment_id", "n", F.array_join("ids", ",").alias("invoice_ids"))


def _cascade(c: Catalog) -> DataFrame:
    return reconcile.match_cascade(c.payments, c.invoices)


@register("match_cascade")
def q_match_cascade(spark, sf_dir):
    from pyspark.sql import functions as F
    return _cascade(Whole(spark, sf_dir)).withColumn("balance_remaining", F.col("balance_remaining").cast("double"))


@register("apply_scheme")
def q_apply_scheme(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    return reconcile.apply_scheme(_cascade(c), c.discount_schemes).select(
        "payment_id", "reconciliation_status", F.col("balance_remaining").cast("double").alias("balance_remaining"),
        F.col("scheme_deduction").cast("double").alias("scheme_deduction"))


@register("match_sequential")
def q_match_sequential(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    return reconcile.match_sequential(c.payments, c.invoices).withColumn("balance_remaining", F.col("balance_remaining").cast("double"))


@register("retailer_statement")
def q_retailer_statement(spark, sf_dir):
    c = Whole(spark, sf_dir)
    return rounded(reconcile.retailer_statement(c.invoices, c.payments, c.retailers, c.as_of))


@register("aging_report")
def q_aging_report(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return rounded(reconcile.aging_report(c.invoices, c.payments, c.as_of))


@register("dso")
def q_dso(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return rounded(reconcile.dso(c.retailers, c.invoices, c.as_of))


@register("duplicate_invoices")
def q_duplicate_invoices(spark, sf_dir):
    return invoice_ops.duplicate_invoices(Whole(spark, sf_dir).invoices)


@register("net_cashflow")
def q_net_cashflow(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return rounded(cashflow.net_cashflow(c.payment_transactions, c.depots, c.as_of))


# ---------------------------------------------------------------- views and decisions
from ..config import Config  # noqa: E402
from ..operators import decisions, views  # noqa: E402
from . import nightly  # noqa: E402

# The formula path caps expiry risk at 0.8 (H-18); the decision queries run
# with critical = 0.75 so that liquidation and reorder suppression occur.
DECISION_CONFIG = Config().with_overrides(expiry_critical_threshold=0.75)


def _state(spark, sf_dir):
    c = Catalog(spark, sf_dir, materialize=True)
    return c, nightly.decision_state(c, nightly.score_all(c, DECISION_CONFIG))


@register("v_expiry_predictions")
def q_v_expiry(spark, sf_dir):
    from pyspark.sql import functions as F
    _, st = _state(spark, sf_dir)
    return rounded(st["expiry_view"].withColumn("ptr", F.col("ptr").cast("double")))


@register("v_stockout_risks")
def q_v_stockout(spark, sf_dir):
    return rounded(_state(spark, sf_dir)[1]["stockout_view"])


@register("v_fefo_rankings")
def q_v_fefo(spark, sf_dir):
    return rounded(_state(spark, sf_dir)[1]["fefo_view"])


@register("v_anomaly_flags")
def q_v_anomaly(spark, sf_dir):
    return rounded(_state(spark, sf_dir)[1]["anomaly_view"])


def _no_payload(df):
    return df.drop("payload")


@register("anomaly_decisions")
def q_anomaly_decisions(spark, sf_dir):
    return _no_payload(decisions.run_rule("anomaly", _state(spark, sf_dir)[1], DECISION_CONFIG))


@register("expiry_decisions")
def q_expiry_decisions(spark, sf_dir):
    return _no_payload(decisions.run_rule("expiry", _state(spark, sf_dir)[1], DECISION_CONFIG))


@register("reorder_decisions")
def q_reorder_decisions(spark, sf_dir):
    return _no_payload(decisions.run_rule("reorder", _state(spark, sf_dir)[1], DECISION_CONFIG))


@register("dispatch_decisions")
def q_dispatch_decisions(spark, sf_dir):
    return _no_payload(decisions.run_rule("dispatch", _state(spark, sf_dir)[1], DECISION_CONFIG))


@register("resolve_decisions")
def q_resolve_decisions(spark, sf_dir):
    return _no_payload(nightly.nightly_decisions(Catalog(spark, sf_dir, materialize=True), DECISION_CONFIG))


@register("run_status")
def q_run_status(spark, sf_dir):
    c = Catalog(spark, sf_dir, materialize=True)
    return decisions.run_status(nightly.stage_outcomes(c, nightly.score_all(c, DECISION_CONFIG)))


# ---------------------------------------------------------------- drift
from ..operators import drift  # noqa: E402

DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _drift_frames(spark, sf_dir):
    from pyspark.sql import functions as F
    li = Catalog(spark, sf_dir).raw("lineitem").select("l_shipdate", *DRIFT_FEATURES)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


@register("psi")
def q_psi(spark, sf_dir):
    b, c = _drift_frames(spark, sf_dir)
    return drift.psi(b, c, DRIFT_FEATURES)


@register("drift_report")
def q_drift_report(spark, sf_dir):
    b, c = _drift_frames(spark, sf_dir)
    return drift.drift_report(b, c, DRIFT_FEATURES + ["not_a_column"])


# ---------------------------------------------------------------- cold chain (batch form of the stream)
from ..operators import sessions  # noqa: E402
from ..streaming import coldchain  # noqa: E402


def _parsed(c: Catalog):
    return coldchain.parse_readings(coldchain.readings_as_messages(c.readings))


def _thresholds(c: Catalog):
    devices = c.readings.select("device_id", "depot_id").distinct()
    return coldchain.device_thresholds(devices, c.batches, c.products, c.as_of)


@register("parse_readings")
def q_parse_readings(spark, sf_dir):
    return rounded(_parsed(Catalog(spark, sf_dir)).select("message_id", "depot_id", "device_id", "temperature", "ts",
                                                          "dead_letter"))


@register("device_thresholds")
def q_device_thresholds(spark, sf_dir):
    return _thresholds(Catalog(spark, sf_dir))


def _flagged(c: Catalog):
    p = _parsed(c).where("NOT dead_letter").select("message_id", "depot_id", "device_id", "temperature", "ts")
    return coldchain.flag_excursions(p, _thresholds(c))


@register("flag_excursions")
def q_flag_excursions(spark, sf_dir):
    return rounded(_flagged(Catalog(spark, sf_dir)))


@register("device_heartbeat")
def q_device_heartbeat(spark, sf_dir):
    return coldchain.device_heartbeat(_parsed(Catalog(spark, sf_dir)).where("NOT dead_letter"))


@register("excursion_alerts")
def q_excursion_alerts(spark, sf_dir):
    return coldchain.excursion_alerts(_flagged(Catalog(spark, sf_dir))).drop("payload")


def _hits(c: Catalog):
    from pyspark.sql import functions as F
    e = c.raw("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    users = e.select(F.col("event_id").alias("hit_id"), F.lit("user").alias("kind"),
                     F.col("user_id").cast("string").alias("key"), "ts")
    ips = e.select((F.col("event_id") + F.lit(10**12)).alias("hit_id"), F.lit("ip").alias("kind"),
                   F.concat(F.lit("ip-"), (F.col("user_id") % 7).cast("string")).alias("key"), "ts")
    return users.unionByName(ips)


@register("request_bursts")
def q_request_bursts(spark, sf_dir):
    return sessions.request_bursts(_hits(Catalog(spark, sf_dir)), gap_seconds=60)


# ---------------------------------------------------------------- quality and ingest
from ..operators import quality  # noqa: E402
from ..sources import ingest  # noqa: E402


@register("client_demand_12m")
def q_client_demand_12m(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Catalog(spark, sf_dir)
    client_depots = c.depots.where(F.col("client_id") == "CLIENT-0").select("depot_id")
    return rounded(demand.daily_demand(c.movements, c.products, c.depots, c.as_of, days=365,
                                       depot_filter=client_depots))


@register("validate_sales")
def q_validate_sales(spark, sf_dir):
    c = Whole(spark, sf_dir)
    return quality.validate_sales(_history(c), c.as_of)


@register("validate_batches")
def q_validate_batches(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return quality.validate_batches(c.batches, c.as_of)


@register("training_sufficiency")
def q_training_sufficiency(spark, sf_dir):
    c = Whole(spark, sf_dir)
    return quality.training_sufficiency(_history(c), c.batches, c.depots, c.as_of)


@register("row_constraints")
def q_row_constraints(spark, sf_dir):
    from pyspark.sql import functions as F
    r = quality.row_constraints(Catalog(spark, sf_dir).invoice_lines)
    return r.select("invoice_id", "line_no", F.array_join("violations", ",").alias("violations"), "is_valid")


def _raw_out_rows(c: Catalog):
    from pyspark.sql import functions as F
    m = c.movements.where(F.col("movement_type") == "OUT").join(
        c.products.select("product_id", "product_category", "is_cold_chain"), "product_id").join(
        c.depots.select("depot_id", F.col("region").alias("depot_region")), "depot_id")
    return m.select("product_id", "depot_id", F.to_date("created_at").alias("date"),
                    F.col("quantity").alias("units_sold"), "product_category", "is_cold_chain", "depot_region")


@register("collapse_duplicates")
def q_collapse_duplicates(spark, sf_dir):
    return rounded(quality.collapse_duplicates(_raw_out_rows(Whole(spark, sf_dir))))


@register("positive_sales_filter")
def q_positive_sales_filter(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    rows = _raw_out_rows(c).withColumn("units_sold", F.col("units_sold") - 5)
    return rounded(quality.positive_sales_filter(rows))


@register("union_sources")
def q_union_sources(spark, sf_dir):
    c = Whole(spark, sf_dir)
    _, stats = quality.union_sources({"recent": _sales(c), "client": _history(c)},
                                     ["product_id", "depot_id", "date", "units_sold"])
    return stats


def _client_export(c: Catalog):
    """A client-style export derived from OUT movements: messy headers,
    day-first dates as text, quantities as text."""
    from pyspark.sql import functions as F
    m = c.movements.where(F.col("movement_type") == "OUT")
    return m.select(F.date_format("created_at", "dd-MM-yyyy").alias(" Voucher Date "),
                    F.concat(F.lit("  "), F.col("product_id"), F.lit(" ")).alias("Item Name"),
                    F.col("quantity").cast("string").alias("Qty."),
                    F.col("depot_id").alias("GODOWN"),
                    F.col("batch_id").alias("Batch No"),
                    F.col("movement_id").alias("Voucher No"))


@register("ingest_frame")
def q_ingest_frame(spark, sf_dir):
    c = Whole(spark, sf_dir)
    mapped, _ = ingest.map_schema(ingest.ingest_frame(_client_export(c)), client_id="CLIENT-0")
    return rounded(mapped)


@register("unpivot_drug_sales")
def q_unpivot_drug_sales(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    out = c.movements.where(F.col("movement_type") == "OUT").select(
        F.to_date("created_at").alias("date"), "product_id", "quantity")
    products = sorted(r[0] for r in c.products.select("product_id").collect())  # column names only (brand domain)
    wide = out.groupBy("date").pivot("product_id", products).agg(F.sum("quantity"))
    return rounded(ingest.unpivot_drug_sales(wide))


@register("store_sales")
def q_store_sales(spark, sf_dir):
    """SRC-5, PRJ-8: orders as daily store sales, nations as stores."""
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    sales = c.raw("orders").join(c.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("Store"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("Sales"), F.max((F.col("o_custkey") % 7 != 0).cast("int")).alias("Open"))
    stores = c.raw("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("Store"), F.substring("n_name", 1, 1).alias("StoreType"), F.col("n_name").alias("Assortment"))
    return rounded(ingest.map_store_sales(ingest.load_store_sales(sales, stores)))


@register("wide_daily_sales")
def q_wide_daily_sales(spark, sf_dir):
    """SRC-6, PRJ-7: sales per day and movement type as a wide CSV with calendar columns, read back and unpivoted."""
    from pyspark.sql import functions as F
    m = Whole(spark, sf_dir).movements
    wide = m.groupBy(F.to_date("created_at").alias("day")).pivot("movement_type", ["IN", "OUT", "RETURN"]).agg(F.sum("quantity"))
    path = _sink_path(spark)
    wide.select(F.date_format("day", "d/M/yyyy").alias("datum"), F.col("IN").alias("IN01"), F.col("OUT").alias("OUT1"), F.col("RETURN").alias("RET1"),
                F.year("day").alias("Year"), F.date_format("day", "EEEE").alias("weekday_name")).write.option("header", True).csv(path)
    return rounded(ingest.unpivot_drug_sales(ingest.load_wide_daily_sales(spark, path)))


@register("otc_sales")
def q_otc_sales(spark, sf_dir):
    """SRC-1, SRC-7, PRJ-9: a client export written as one semicolon CSV (of part files), the first of its folder read and mapped."""
    path = _sink_path(spark)
    _client_export(Whole(spark, sf_dir)).write.option("header", True).option("sep", ";").option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/export.csv")
    return rounded(ingest.map_otc_sales(ingest.strip_strings(ingest.load_otc(spark, path)))[0])


# ---------------------------------------------------------------- sinks
def _sink_rows(c: Catalog) -> DataFrame:
    """OUT units per depot, product and day of the last three days."""
    from pyspark.sql import functions as F
    m = c.movements.where((F.col("movement_type") == "OUT") & (F.to_date("created_at") > F.date_sub(F.lit(c.as_of).cast("date"), 3)))
    return m.groupBy("depot_id", "product_id", F.to_date("created_at").alias("run_date")).agg(F.sum("quantity").alias("units")).checkpoint()


def _sink_path(spark) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex[:12]}"


@register("sink_upsert")
def q_sink_upsert(spark, sf_dir):
    """SNK-1: all rows, then a second run of the last two days that doubles all but one depot."""
    from . import sinks
    rows, path, key = _sink_rows(Catalog(spark, sf_dir)), _sink_path(spark), ["depot_id", "product_id", "run_date"]
    sinks.upsert_by_key(rows, path, key)
    sinks.upsert_by_key(rows.where("run_date > DATE '2001-07-30' AND depot_id <> 'ASIA'").withColumn("units", 2 * rows["units"]), path, key)
    return rounded(sinks.DatedTable(spark, path).read(rows.schema))


@register("sink_replace_partition")
def q_sink_replace_partition(spark, sf_dir):
    """SNK-2: two depots' rows of the last day are replaced, one of them by nothing."""
    from pyspark.sql import functions as F

    from . import sinks
    c = Catalog(spark, sf_dir)
    rows, path = _sink_rows(c), _sink_path(spark)
    sinks.replace_partition(rows, path, rows)
    targets = c.depots.where("depot_id IN ('ASIA', 'EUROPE')").select("depot_id", F.lit(c.as_of).cast("date").alias("run_date"))
    sinks.replace_partition(rows.where("depot_id = 'EUROPE'").withColumn("units", rows["units"] + 1), path, targets)
    return rounded(sinks.DatedTable(spark, path).read(rows.schema))


@register("sink_insert_ignore")
def q_sink_insert_ignore(spark, sf_dir):
    """SNK-3: actions of two depots exist; a second run proposes all, several per key."""
    from pyspark.sql import functions as F

    from . import sinks
    rows, path, key = _sink_rows(Catalog(spark, sf_dir)), _sink_path(spark), ["depot_id", "product_id", "run_date"]
    sinks.insert_ignore(rows.where("depot_id IN ('ASIA', 'EUROPE')").withColumn("status", F.lit("APPROVED")), path, key, ["units"])
    more = rows.withColumn("units", F.explode(F.array(rows["units"] + 2, rows["units"] + 1))).withColumn("status", F.lit("PENDING"))
    sinks.insert_ignore(more, path, key, ["units"])
    return rounded(sinks.DatedTable(spark, path).read(more.schema))


@register("sink_append_log")
def q_sink_append_log(spark, sf_dir):
    """SNK-4: the same rows appended twice, read back for the last day only."""
    from . import sinks
    rows, path = _sink_rows(Catalog(spark, sf_dir)), _sink_path(spark)
    sinks.append_log(rows, path)
    sinks.append_log(rows, path)
    return rounded(sinks.DatedTable(spark, path).read(rows.schema, ["2001-08-01"]))


@register("run_status_fallback")
def q_run_status_fallback(spark, sf_dir):
    """SRC-11, G-9: one depot has no movements today and goes on with the tables of the day before."""
    from . import sinks

    class Shut(Catalog):
        @property
        def movements(self):
            return super().movements.where("depot_id <> 'ASIA'")
    home = _sink_path(spark)
    before = nightly.Scores(Catalog(spark, sf_dir, as_of="2001-07-31", materialize=True), DECISION_CONFIG)
    sinks.upsert_by_key(before.demand_today, f"{home}/demand_predictions", ["depot_id", "product_id", "run_date"])
    sinks.upsert_by_key(before.expiry_today, f"{home}/expiry_predictions", ["depot_id", "batch_id", "run_date"])
    c = Shut(spark, sf_dir, materialize=True)
    return nightly.stage_outcomes(c, nightly.Scores(c, DECISION_CONFIG, history=home))


# ---------------------------------------------------------------- training
from ..operators import training  # noqa: E402


@register("chronological_split")
def q_chronological_split(spark, sf_dir):
    return rounded(training.chronological_split(_history(Whole(spark, sf_dir))))


@register("walk_forward_folds")
def q_walk_forward_folds(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    return rounded(training.walk_forward_folds(_history(c), training.quarterly_folds(c.as_of),
                                               supplementary=F.col("depot_id") == "MIDDLE EAST"))


def _daily_by_product(c: Catalog):
    from pyspark.sql import functions as F
    return c.movements.where(F.col("movement_type") == "OUT").groupBy(
        F.to_date("created_at").alias("date"), "product_id").agg(F.sum("quantity").alias("units_sold"))


@register("synthesise_batches")
def q_synthesise_batches(spark, sf_dir):
    b, _ = training.synthesise_batches(_daily_by_product(Whole(spark, sf_dir)))
    return rounded(b)


@register("synthesise_movements")
def q_synthesise_movements(spark, sf_dir):
    _, m = training.synthesise_batches(_daily_by_product(Whole(spark, sf_dir)))
    return rounded(m)


@register("time_series_folds")
def q_time_series_folds(spark, sf_dir):
    c = Whole(spark, sf_dir)
    b = c.batches.select("batch_id", "created_at")
    return training.time_series_folds(b, ["created_at", "batch_id"], k=5)


@register("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    f = expiry.expiry_features(c.batches, c.products, c.movements, c.as_of).where("label IS NOT NULL")
    return training.stratified_folds(f.select("batch_id", "label"), "label", "batch_id", k=5)


def _scored_batches(c: Catalog):
    from pyspark.sql import functions as F
    f = expiry.expiry_features(c.batches, c.products, c.movements, c.as_of).where("label IS NOT NULL")
    return f.select("batch_id", "label", (F.lit(1.0) / (F.lit(1.0) + F.col("sales_velocity_weekly"))).alias("score"))


@register("model_auc")
def q_model_auc(spark, sf_dir):
    return rounded(training.auc(_scored_batches(Catalog(spark, sf_dir))))


@register("recall_threshold")
def q_recall_threshold(spark, sf_dir):
    return rounded(training.recall_threshold(_scored_batches(Catalog(spark, sf_dir))))


@register("confusion_counts")
def q_confusion_counts(spark, sf_dir):
    return training.confusion(_scored_batches(Catalog(spark, sf_dir)), 0.5)


@register("demand_mape")
def q_demand_mape(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    s = _sales(c).select("product_id", "depot_id", "units_sold")
    p = s.join(demand.forecast_fallback(_sales(c)).select("product_id", "depot_id", "predicted_daily_rate"),
               ["product_id", "depot_id"])
    return rounded(training.mape(p, y="units_sold", p="predicted_daily_rate"))


@register("demand_forecast_model")
def q_demand_forecast_model(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    from ..config import DEFAULTS
    f = demand.demand_features(demand.fill_missing_dates(_sales(c)), DEFAULTS["festival_dates"])
    f = f.checkpoint(eager=True)  # read by every boosting round and by the scoring pass
    model, _ = training.train_demand(f, demand.FEATURE_COLS, max_iter=20)
    return training.demand_forecast_model(model, f)


@register("expiry_risk_model")
def q_expiry_risk_model(spark, sf_dir):
    c = Catalog(spark, sf_dir, materialize=True)
    # read by the forest, the calibration and the scoring pass: write once
    feats = expiry.expiry_features(c.batches, c.products, c.movements, c.as_of).checkpoint(eager=True)
    forest, iso = training.train_expiry(feats, expiry.FEATURE_COLS, num_trees=30)
    from pyspark.sql import functions as F
    scored = training.score_expiry(forest, iso, feats).select(
        "batch_id", F.col("score"), "sales_velocity_weekly")
    active = _active(c)
    from ..functions.numeric import py_round_cols
    j = active.join(scored, "batch_id")
    j = py_round_cols(j, {"expiry_risk_score": ("score", 3)})
    return j.select("batch_id", "product_id", "depot_id", "expiry_risk_score",
                    expiry.liquidation_date(c.as_of, F.greatest(F.col("quantity_remaining"), F.lit(0.0)),
                                            F.col("sales_velocity_weekly")).alias("recommended_liquidation_date"),
                    F.lit("model").alias("method"))


# ---------------------------------------------------------------- invoice text, names, ledger updates
def _invoice_texts(c: Catalog):
    from pyspark.sql import functions as F
    i = c.invoices
    text = F.concat(F.lit("TAX INVOICE Invoice No: "), F.col("invoice_number"), F.lit(" Date: "),
                    F.date_format("invoice_date", "dd/MM/yyyy"), F.lit(" Total: "),
                    F.format_number(F.col("total_amount").cast("double"), 2), F.lit(" Thank you"))
    return i.select(F.col("id").alias("invoice_id"), text.alias("text"))


@register("extract_invoice_fields")
def q_extract_invoice_fields(spark, sf_dir):
    r = invoice_ops.extract_invoice_fields(_invoice_texts(Whole(spark, sf_dir)))
    return rounded(r.drop("text"))


def _raw_product_names(c: Catalog):
    """Invoice-style spellings of part names: tokens reversed (key % 3 = 0),
    one letter dropped (key % 3 = 1), or both."""
    from pyspark.sql import functions as F
    p = c.raw("part").select("p_partkey", "p_name")
    toks = F.split("p_name", " ")
    rev = F.array_join(F.reverse(toks), " ")
    pos = (F.col("p_partkey") % F.greatest(F.length("p_name"), F.lit(1))).cast("int")

    def drop(s):  # remove the character at 0-based position ``pos``
        return F.concat(F.substr(s, F.lit(1), pos), F.substr(s, pos + 2, F.lit(10000)))
    k = F.col("p_partkey") % 3
    with_rev = p.withColumn("_rev", rev)
    raw = F.when(k == 0, F.col("_rev")).when(k == 1, drop(F.col("p_name"))).otherwise(drop(F.col("_rev")))
    return with_rev.select("p_partkey", raw.alias("raw_name"))


def _name_products(c: Catalog):
    from pyspark.sql import functions as F
    names = c.raw("part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("product_id"), F.col("p_name").alias("canonical_name"),
                        F.lit(None).cast("array<string>").alias("aliases"))


@register("match_products")
def q_match_products(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return rounded(invoice_ops.match_products(_raw_product_names(c), _name_products(c)))


@register("line_confidence")
def q_line_confidence(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    lines = c.invoice_lines.join(c.batches.select("batch_id", "batch_number", "expiry_date"), "batch_id", "left") \
        .withColumn("match_score", F.lit(100.0))
    return rounded(invoice_ops.line_confidence(lines).select("invoice_id", "line_no", "confidence",
                                                             "needs_correction"))


@register("invoice_confidence")
def q_invoice_confidence(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    lines = c.invoice_lines.join(c.batches.select("batch_id", "batch_number", "expiry_date"), "batch_id", "left") \
        .withColumn("match_score", F.lit(100.0))
    return rounded(invoice_ops.invoice_confidence(invoice_ops.line_confidence(lines), c.invoices))


@register("invoice_lines")
def q_invoice_lines(spark, sf_dir):
    c = Whole(spark, sf_dir)
    return rounded(ledger.invoice_lines(c.invoice_lines, c.invoices, c.products, c.batches))


def _receipts(c: Catalog):
    """Stock receipts from all order lines: odd lines
    top up the existing batch (same key), even lines carry a new expiry."""
    from pyspark.sql import functions as F
    i = c.invoices.select(F.col("id").alias("invoice_id"))
    l = c.invoice_lines.join(i, "invoice_id").join(
        c.batches.select("batch_id", "depot_id", "batch_number", "expiry_date"), "batch_id")
    exp = F.when(F.col("line_no") % 2 == 1, F.col("expiry_date")).otherwise(
        F.date_add(F.lit(c.as_of).cast("date"), 365))
    return l.select("depot_id", "product_id", "batch_number", exp.alias("expiry_date"), "quantity")


@register("apply_stock_in")
def q_apply_stock_in(spark, sf_dir):
    c = Whole(spark, sf_dir)
    merged, _ = ledger.apply_stock_in(c.batches, _receipts(c), c.as_of)
    return merged


@register("apply_stock_out")
def q_apply_stock_out(spark, sf_dir):
    from ..operators import stock_fold
    return rounded(stock_fold.apply_stock_out(Whole(spark, sf_dir).movements))


@register("enrich_aliases")
def q_enrich_aliases(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Catalog(spark, sf_dir)
    prods = _name_products(c).withColumn("aliases", F.array().cast("array<string>"))
    raw = _raw_product_names(c).join(c.raw("part").select("p_partkey", F.col("p_name").alias("product_id")),
                                     "p_partkey")
    out = ledger.enrich_aliases(prods, raw)
    return out.select("product_id", F.array_join(F.array_sort("aliases"), "|").alias("aliases"))


@register("compliance_snapshot")
def q_compliance_snapshot(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    from pyspark.sql import functions as F
    status = c.depots.select("depot_id", F.lit("SUCCESS").alias("status"))
    alerts = decisions.notify_queue(status, coldchain.excursion_alerts(_flagged(c)), c.as_of)
    return decisions.compliance_snapshot(c.depots, alerts)


@register("confirm_invoice")
def q_confirm_invoice(spark, sf_dir):
    from pyspark.sql import functions as F
    c = Whole(spark, sf_dir)
    i = c.invoices.select(F.col("id").alias("invoice_id"))
    l = c.invoice_lines.join(i, "invoice_id").join(
        c.batches.select("batch_id", "depot_id", "batch_number", "expiry_date"), "batch_id")
    receipts = l.select("invoice_id", "depot_id", "product_id", "batch_number", "expiry_date", "quantity")
    out = ledger.confirm_invoice(c.batches, c.invoices, c.invoice_lines, c.products, receipts, None, c.as_of)
    return out["invoices"].select("id", "status")


@register("category_codes")
def q_category_codes(spark, sf_dir):
    c = Whole(spark, sf_dir)
    return demand.category_codes(_history(c))


@register("scope_to_depot")
def q_scope_to_depot(spark, sf_dir):
    return rounded(quality.scope_to_depot(Whole(spark, sf_dir).movements, "ASIA"))
