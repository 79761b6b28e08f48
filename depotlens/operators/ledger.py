"""Stock ledger (L-*).

Two stock definitions exist and both are kept (SURVEY rule 4):
* movement balance  = ΣIN + ΣRETURN − ΣOUT − ΣWRITE_OFF  (L-1, L-2, S-1)
* batch remaining   = quantity_received − ΣOUT            (L-3, E-1, F-1)
Every aggregate is a partial/final hash aggregate (map-side combine), so a
hot depot or product costs one pre-aggregated row per task in the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tpch import as_of_lit

INFLOW_TYPES = ("IN", "RETURN")
OUTFLOW_TYPES = ("OUT", "WRITE_OFF")


def _balance() -> Column:
    t, q = F.col("movement_type"), F.col("quantity")
    return (F.coalesce(F.sum(F.when(t.isin(*INFLOW_TYPES), q).otherwise(0.0)), F.lit(0.0))
            - F.coalesce(F.sum(F.when(t.isin(*OUTFLOW_TYPES), q).otherwise(0.0)), F.lit(0.0)))


def current_stock(movements: DataFrame) -> DataFrame:
    """L-1: movement balance per (depot, product); TRANSFER ignored;
    truncated to a whole number like the reference's int()."""
    return movements.groupBy("depot_id", "product_id").agg(
        _balance().cast("long").alias("current_stock"))


def batch_stock(movements: DataFrame) -> DataFrame:
    """L-2: movement balance per batch."""
    return movements.groupBy("batch_id").agg(_balance().cast("long").alias("batch_stock"))


def sold_per_batch(movements: DataFrame) -> DataFrame:
    """Σ OUT per batch (pre-aggregated before any join)."""
    return movements.where(F.col("movement_type") == "OUT").groupBy("batch_id").agg(
        F.sum("quantity").alias("sold_qty"))


def stock_ledger(batches: DataFrame, products: DataFrame, movements: DataFrame, as_of: str,
                 sort: bool = False) -> DataFrame:
    """L-3: batches ⋈ products ⟕ ΣOUT; remaining = received − ΣOUT > 0;
    status expired / expiring_soon (< as_of + 30) / active.  With
    ``sort`` the rows come range-sorted by (depot, name, expiry, batch)."""
    today = as_of_lit(as_of)
    j = (batches.join(products.select("product_id", "canonical_name", "product_category"), "product_id")
         .join(sold_per_batch(movements), "batch_id", "left"))
    rem = F.col("quantity_received") - F.coalesce(F.col("sold_qty"), F.lit(0.0))
    status = (F.when(F.col("expiry_date") < today, "expired")
              .when(F.col("expiry_date") < F.date_add(today, 30), "expiring_soon")
              .otherwise("active"))
    out = j.where(rem > 0).select(
        "depot_id", "batch_id", "batch_number", "product_id", "canonical_name", "product_category",
        "expiry_date", rem.alias("quantity_remaining"), status.alias("status"))
    if sort:
        out = out.orderBy("depot_id", "canonical_name", "expiry_date", "batch_id")
    return out


def stock_by_product(ledger: DataFrame) -> DataFrame:
    """L-4 (flat form): each ledger row with its product's total remaining
    and batch count.  The totals come from a grouped aggregate joined back,
    so no product's batches are gathered into a single row or task; a
    presentation layer nests the rows if it wants a list per product."""
    tot = ledger.groupBy("depot_id", "product_id").agg(
        F.sum("quantity_remaining").alias("product_total"),
        F.count(F.lit(1)).alias("product_batches"))
    return ledger.join(tot, ["depot_id", "product_id"])


def batch_timeline(batches: DataFrame, products: DataFrame, movements: DataFrame) -> DataFrame:
    """L-5 (flat): one row per movement with the batch header, quantity sold
    (ΣOUT of the batch), remaining = received − sold and status
    active/depleted.  Rows with no movement keep the header only."""
    sold = movements.groupBy("batch_id").agg(
        F.sum(F.when(F.col("movement_type") == "OUT", F.col("quantity")).otherwise(0.0)).alias("quantity_sold"))
    hdr = (batches.join(products.select("product_id", "canonical_name"), "product_id")
           .join(sold, "batch_id", "left")
           .withColumn("quantity_sold", F.coalesce("quantity_sold", F.lit(0.0))))
    hdr = hdr.withColumn("quantity_remaining", F.col("quantity_received") - F.col("quantity_sold")) \
             .withColumn("status", F.when(F.col("quantity_remaining") > 0, "active").otherwise("depleted"))
    mv = movements.select("batch_id", "movement_id", "movement_type", "quantity",
                          F.col("created_at").alias("moved_at"))
    return hdr.join(mv, "batch_id", "left").select(
        "batch_id", "batch_number", "product_id", "canonical_name", "expiry_date", "quantity_received",
        "quantity_sold", "quantity_remaining", "status", "movement_id", "movement_type", "quantity", "moved_at")


BATCH_KEY = ["depot_id", "product_id", "batch_number", "expiry_date"]


def batch_key_id(cols=BATCH_KEY) -> Column:
    """Deterministic batch id from the natural key (not a random UUID)."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256).substr(1, 32)


def apply_stock_in(batches: DataFrame, receipts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """L-6: receipts (depot, product, batch_number, expiry_date, quantity)
    are summed per natural key; an existing batch with that key gets
    quantity_received (and remaining) increased, otherwise a batch is
    created with remaining = received (H-17).  Returns (batches, IN
    movements).  A full merge by key: matched update ∪ untouched ∪ new."""
    r = receipts.groupBy(*BATCH_KEY).agg(F.sum("quantity").alias("_add"))
    b = batches.select("batch_id", *BATCH_KEY, "quantity_received", "quantity_remaining", "created_at")
    upd = b.join(r, BATCH_KEY, "left").select(
        "batch_id", *BATCH_KEY,
        (F.col("quantity_received") + F.coalesce(F.col("_add"), F.lit(0))).cast("long").alias("quantity_received"),
        (F.col("quantity_remaining") + F.coalesce(F.col("_add"), F.lit(0))).cast("long").alias("quantity_remaining"),
        "created_at")
    new = r.join(b.select(*BATCH_KEY), BATCH_KEY, "left_anti").select(
        batch_key_id().alias("batch_id"), *BATCH_KEY, F.col("_add").cast("long").alias("quantity_received"),
        F.col("_add").cast("long").alias("quantity_remaining"), as_of_lit(as_of).cast("timestamp").alias("created_at"))
    merged = upd.unionByName(new)
    ids = merged.select("batch_id", *BATCH_KEY)
    moves = receipts.join(ids, BATCH_KEY).select(
        "batch_id", "depot_id", "product_id", F.lit("IN").alias("movement_type"),
        F.col("quantity").cast("double").alias("quantity"), as_of_lit(as_of).cast("timestamp").alias("created_at"))
    return merged, moves


def enrich_aliases(products: DataFrame, raw_names: DataFrame) -> DataFrame:
    """L-9: lower(trim(raw name)) appended to the product's aliases when not
    present; a null alias array stays null (three-valued logic of the
    reference's SQL)."""
    new = raw_names.select("product_id", F.lower(F.trim("raw_name")).alias("a")).where(F.col("a") != "") \
                   .groupBy("product_id").agg(F.array_sort(F.collect_set("a")).alias("_new"))
    j = products.join(new, "product_id", "left")
    return j.select(*[F.when(F.col("aliases").isNotNull() & F.col("_new").isNotNull(),
                             F.array_union("aliases", "_new")).otherwise(F.col("aliases")).alias("aliases")
                      if c == "aliases" else F.col(c) for c in products.columns])


def invoice_lines(lines: DataFrame, invoices: DataFrame, products: DataFrame, batches: DataFrame) -> DataFrame:
    """L-10: lines ⋈ invoices ⋈ products ⟕ batches; null money → 0."""
    i = invoices.select(F.col("id").alias("invoice_id"), "depot_id", "invoice_number")
    p = products.select("product_id", "canonical_name")
    b = batches.select("batch_id", "batch_number", "expiry_date")
    j = lines.join(i, "invoice_id").join(p, "product_id").join(b, "batch_id", "left")
    return j.select("depot_id", "invoice_id", "invoice_number", "line_no", "product_id", "canonical_name",
                    "batch_id", "batch_number", "expiry_date", "quantity",
                    F.coalesce(F.col("mrp").cast("double"), F.lit(0.0)).alias("mrp"),
                    F.coalesce(F.col("ptr").cast("double"), F.lit(0.0)).alias("ptr"),
                    F.coalesce(F.col("gst_percent"), F.lit(0.0)).alias("gst_percent"))


def confirm_invoice(batches: DataFrame, invoices: DataFrame, lines: DataFrame, products: DataFrame,
                    receipts: DataFrame, raw_names: DataFrame | None, as_of: str) -> dict:
    """L-8: confirming invoices = stock-in of their lines (L-6), the lines
    kept as invoice lines, the invoices set SETTLED and the raw product
    texts added to the aliases (L-9).  ``receipts`` are the confirmed lines
    in stock-in form (depot, product, batch_number, expiry_date, quantity,
    invoice_id).  Returns the new tables."""
    merged, moves = apply_stock_in(batches, receipts.drop("invoice_id"), as_of)
    confirmed = receipts.select("invoice_id").distinct()
    inv = invoices.join(confirmed.withColumn("_c", F.lit(True)), F.col("id") == F.col("invoice_id"), "left") \
                  .withColumn("status", F.when(F.col("_c"), F.lit("SETTLED")).otherwise(F.col("status"))) \
                  .drop("_c", "invoice_id")
    prods = enrich_aliases(products, raw_names) if raw_names is not None else products
    kept_lines = lines.join(confirmed, "invoice_id", "left_semi")
    return {"batches": merged, "movements": moves, "invoices": inv, "products": prods, "lines": kept_lines}
