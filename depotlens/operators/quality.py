"""Data-quality and training-sufficiency checks, filters (Q-*, FIL-*).

Checks are returned as a table ``(check, severity, message)`` computed by
one aggregate pass (plus one grouped count for history length), never by
pulling rows to the driver.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tpch import as_of_lit

SALES_REQUIRED = ["product_id", "depot_id", "date", "units_sold"]
BATCH_REQUIRED = ["batch_id", "product_id", "expiry_date"]


def _missing(df: DataFrame, required: list[str]) -> DataFrame | None:
    miss = [c for c in required if c not in df.columns]
    if not miss:
        return None
    spark = df.sparkSession
    return spark.createDataFrame([("missing_column", "error", f"Missing required column: {c}") for c in miss],
                                 "check string, severity string, message string")


def _checks(rows: list[tuple[str, Column, Column]]) -> Column:
    """array of structs (check, severity, message) for the rules whose
    severity is not null, compacted."""
    return F.filter(F.array(*[F.struct(F.lit(c).alias("check"), sev.alias("severity"), msg.alias("message"))
                              for c, sev, msg in rows]), lambda x: x["severity"].isNotNull())


def validate_sales(df: DataFrame, as_of: str) -> DataFrame:
    """Q-1: nulls per required column (> 5 % error, > 0 warning), negative
    units (error), dates after as_of + 1 day (warning), fewer than 30 rows
    for some (product, depot) (warning)."""
    m = _missing(df, SALES_REQUIRED)
    if m is not None:
        return m
    n = F.count(F.lit(1))
    aggs = [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in SALES_REQUIRED]
    aggs += [n.alias("n"), F.count_if(F.col("units_sold") < 0).alias("neg"),
             F.count_if(F.col("date") > F.date_add(as_of_lit(as_of), 1)).alias("future")]
    a = df.agg(*aggs)
    hist = df.groupBy("product_id", "depot_id").agg(F.count("date").alias("c")).agg(F.min("c").alias("min_days"))
    a = a.select("*", hist.scalar().alias("min_days"))
    rows = []
    for c in SALES_REQUIRED:
        pct = F.col(f"n_{c}") / F.col("n") * 100
        sev = F.when(pct > 5, "error").when(F.col(f"n_{c}") > 0, "warning")
        rows.append((f"nulls_{c}", sev, F.concat(F.lit(f"{c}: "), F.format_string("%.1f", F.round(pct, 1)),
                                                 F.lit("% nulls"))))
    rows.append(("negative_units", F.when(F.col("neg") > 0, "error"), F.lit("units_sold contains negative values")))
    rows.append(("future_dates", F.when(F.col("future") > 0, "warning"), F.lit("Some dates are in the future")))
    rows.append(("short_history", F.when(F.col("min_days") < 30, "warning"),
                 F.concat(F.lit("Some product-depot pairs have < 30 days history (min="),
                          F.col("min_days").cast("string"), F.lit("). Lag warmup rows will be dropped."))))
    return a.select(F.explode(_checks(rows)).alias("r")).select("r.*")


def validate_batches(df: DataFrame, as_of: str) -> DataFrame:
    """Q-2: missing columns → error; already expired batches → warning."""
    m = _missing(df, BATCH_REQUIRED)
    if m is not None:
        return m
    a = df.agg(F.count_if(F.col("expiry_date") < as_of_lit(as_of)).alias("past"))
    rows = [("expired_batches", F.when(F.col("past") > 0, "warning"),
             F.concat(F.col("past").cast("string"), F.lit(" batches are already expired")))]
    return a.select(F.explode(_checks(rows)).alias("r")).select("r.*")


def training_sufficiency(sales: DataFrame, batches: DataFrame, depots: DataFrame, as_of: str) -> DataFrame:
    """Q-3 per client: span = max(date) − min(date) days; expired = batches
    with expiry < as_of; BOTH when span ≥ 180 and expired ≥ 50, DEMAND when
    span ≥ 90, else GLOBAL; a client without sales → GLOBAL with a reason."""
    cl = depots.select("depot_id", "client_id")
    s = sales.join(cl, "depot_id").groupBy("client_id").agg(
        F.datediff(F.max("date"), F.min("date")).alias("span_days"))
    e = batches.join(cl, "depot_id").groupBy("client_id").agg(
        F.count_if(F.col("expiry_date") < as_of_lit(as_of)).alias("expired_batches"))
    j = cl.select("client_id").distinct().join(s, "client_id", "left").join(e, "client_id", "left")
    span = F.coalesce("span_days", F.lit(0))
    exp = F.coalesce("expired_batches", F.lit(0)).cast("long")
    mode = (F.when(F.col("span_days").isNull(), "GLOBAL")
            .when((span >= 180) & (exp >= 50), "BOTH").when(span >= 90, "DEMAND").otherwise("GLOBAL"))
    reason = F.when(F.col("span_days").isNull(), F.lit("no sales data"))
    return j.select("client_id", span.alias("span_days"), exp.alias("expired_batches"), mode.alias("training_mode"),
                    reason.alias("reason"))


def line_rules() -> dict:
    return {
        "quantity_not_positive": F.col("quantity") <= 0,
        "mrp_not_positive": F.col("mrp") <= 0,
        "ptr_not_positive": F.col("ptr") <= 0,
        "gst_out_of_range": (F.col("gst_percent") < 0) | (F.col("gst_percent") > 28),
    }


def row_constraints(lines: DataFrame) -> DataFrame:
    """Q-4: confirmed invoice lines with the list of violated rules
    (quantity > 0, mrp > 0, ptr > 0, 0 ≤ gst ≤ 28) and a valid flag;
    invoices without lines are reported by ``invoices_without_lines``."""
    v = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name))
                                  for name, cond in line_rules().items()]))
    return lines.select("*", v.alias("violations")).withColumn("is_valid", F.size("violations") == 0)


def invoices_without_lines(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    return invoices.join(lines.select(F.col("invoice_id").alias("id")).distinct(), "id", "left_anti")


def collapse_duplicates(sales: DataFrame, attrs: tuple = ("product_category", "is_cold_chain", "depot_region")
                        ) -> DataFrame:
    """Q-5: one row per (product, depot, date): units summed, attributes
    taken deterministically (smallest value) instead of "first"."""
    present = [a for a in attrs if a in sales.columns]
    return sales.groupBy("product_id", "depot_id", "date").agg(
        F.sum("units_sold").alias("units_sold"), *[F.min(a).alias(a) for a in present])


def positive_sales_filter(sales: DataFrame) -> DataFrame:
    """Q-6: keep units > 0 with non-null date, units and product."""
    return sales.where((F.col("units_sold") > 0) & F.col("date").isNotNull() & F.col("product_id").isNotNull())


def union_sources(sources: dict[str, DataFrame], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Q-7: UNION ALL of mapped sources tagged ``_source`` on a canonical
    column list, and per source row count and date range."""
    parts = [df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns])
             .withColumn("_source", F.lit(name)) for name, df in sources.items()]
    u = reduce(DataFrame.unionByName, parts)
    stats = u.groupBy("_source").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("min_date"),
                                     F.max("date").alias("max_date"))
    return u, stats


def drop_missing_required(df: DataFrame, required: list[str]) -> tuple[DataFrame, Column]:
    """FIL-1: drop rows with a null required column (run after coercion);
    also returns the dropped-row count as a scalar column."""
    present = [c for c in required if c in df.columns]
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in present]) if present else F.lit(False)
    return df.where(~bad), df.agg(F.count_if(bad)).scalar()


def scope_to_depot(df: DataFrame, depot_id: str, include_global: bool = False) -> DataFrame:
    """FIL-2: the tenant row filter as an ordinary predicate (pushed to the
    scan); the variant also keeps rows without a depot."""
    cond = F.col("depot_id") == F.lit(depot_id)
    return df.where(cond | F.col("depot_id").isNull() if include_global else cond)
