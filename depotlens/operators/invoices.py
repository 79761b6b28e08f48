"""Invoice text, duplicate detection, product-name matching (P-*)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import lag_within

# FIXED VALUES: field patterns of the invoice-text parser (first match wins).
INVOICE_NO_PATTERN = r"(?i)(?:invoice|inv|bill)\s*(?:no|number|#)[:\s]*([A-Z0-9/-]+)"
DATE_PATTERN = r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"
TOTAL_PATTERN = r"(?i)(?:total|amount)[:\s₹]*([0-9,]+\.?\d*)"
PRODUCT_MATCH_THRESHOLD = 75


def duplicate_invoices(invoices: DataFrame, window_days: int = 7) -> DataFrame:
    """P-5: an invoice is a duplicate when the same depot already has an
    invoice with the same number created within the previous 7 days; a null
    number is never a duplicate.  Reports the most recent conflicting id and
    similarity 100.  The previous invoice per (depot, number) comes from the
    skew-safe ``lag_within`` (one number may cover a large share of rows)."""
    inv = invoices.select("id", "depot_id", "invoice_number", "created_at")
    keyed = inv.where(F.col("invoice_number").isNotNull())
    lagged = lag_within(keyed, ["depot_id", "invoice_number"], ["created_at", "id"], ["id", "created_at"])
    dup = (F.col("prev_id").isNotNull()
           & (F.col("prev_created_at") >= F.col("created_at") - F.expr(f"INTERVAL {window_days} DAYS")))
    flagged = lagged.select("id", "depot_id", "invoice_number", "created_at", dup.alias("is_duplicate"),
                            F.when(dup, F.col("prev_id")).alias("matching_invoice_id"),
                            F.when(dup, F.lit(100.0)).alias("similarity_score"))
    nulls = inv.where(F.col("invoice_number").isNull()).select(
        "id", "depot_id", "invoice_number", "created_at", F.lit(False).alias("is_duplicate"),
        F.lit(None).cast("long").alias("matching_invoice_id"), F.lit(None).cast("double").alias("similarity_score"))
    return flagged.unionByName(nulls)


def extract_invoice_fields(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """P-1: invoice number, first d/m/y date and first total/amount (commas
    removed, as double) by regular expression; missing fields are null."""
    t = F.col(text_col)

    def grab(pat):
        return F.nullif(F.regexp_extract(t, pat, 1), F.lit(""))
    total = F.regexp_replace(grab(TOTAL_PATTERN), ",", "")
    return texts.select("*", grab(INVOICE_NO_PATTERN).alias("invoice_number"),
                        grab(DATE_PATTERN).alias("invoice_date_text"),
                        total.try_cast("double").alias("total_amount"))


def product_choices(products: DataFrame) -> DataFrame:
    """Names a raw product name can match: each canonical name, then its
    aliases, in canonical-name order.  A name listed twice keeps its first
    position and the product of its last listing (a later product wins)."""
    ordered = products.select("product_id", "canonical_name", F.coalesce("aliases", F.array()).alias("aliases"))
    names = ordered.select("product_id", "canonical_name",
                           F.posexplode(F.concat(F.array("canonical_name"), "aliases")).alias("k", "choice"))
    w = F.struct("canonical_name", "product_id", "k")
    return names.groupBy("choice").agg(F.min(w).alias("first"), F.max_by("product_id", w).alias("product_id"),
                                       ).select("choice", "product_id", F.col("first").alias("pos"))


def _norm_len(c):
    return F.length(F.array_join(F.array_sort(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")), " "))


def match_products(raw: DataFrame, products: DataFrame, raw_col: str = "raw_name",
                   threshold: float = PRODUCT_MATCH_THRESHOLD) -> DataFrame:
    """P-2: best choice with token-sort ratio ≥ 75 for each distinct raw
    name; ties go to the earlier choice; an alias maps to its product's
    canonical name.

    Exact blocking: a score of 75 needs 2·min(len)/(len a + len b) ≥ 0.75,
    i.e. the shorter token-sorted string is at least 0.6 of the longer.
    Each distinct raw name is joined only to choices whose length is in
    that range (equi-join on an exploded length list).  The ratio is an Arrow
    pandas UDF over those candidate pairs, which drops those whose letter
    counts rule out the threshold and scores the others a chunk at a time.  Work grows with distinct
    raw names × length-compatible choices, never with raw rows."""
    from ..functions.similarity import token_sort_ratio_udf
    ch = product_choices(products).withColumn("clen", _norm_len(F.col("choice")))
    names = raw.select(F.col(raw_col).alias("raw_name")).where(F.col("raw_name").isNotNull()).distinct()
    names = names.withColumn("rlen", _norm_len(F.col("raw_name")))
    lo = F.ceil(F.col("rlen") * 0.6).cast("int")
    hi = F.floor(F.col("rlen") / 0.6).cast("int")
    probe = names.select("raw_name", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.greatest(hi, F.lit(0))))
                         .alias("clen"))
    cand = probe.join(ch, "clen").withColumn("score", token_sort_ratio_udf(threshold)(F.col("raw_name"), F.col("choice")))
    cand = cand.where(F.col("score") >= threshold)
    best = cand.groupBy("raw_name").agg(
        F.min_by(F.struct("choice", "product_id", "score"), F.struct((-F.col("score")).alias("s"), "pos")).alias("b"))
    canon = products.select("product_id", "canonical_name")
    return best.select("raw_name", F.col("b.choice").alias("matched_name"), F.col("b.product_id").alias("product_id"),
                       F.col("b.score").alias("match_score")).join(canon, "product_id", "left")


def line_confidence(lines: DataFrame) -> DataFrame:
    """P-4: 0.4·match score + 20 batch + 20 expiry + 10 quantity + 5 mrp + 5
    ptr for present (truthy) fields, capped at 100, rounded to 1;
    ``needs_correction`` below 80."""
    from ..functions.numeric import py_round_cols

    def truthy(c):
        col = F.col(c)
        t = lines.schema[c].dataType.simpleString()
        if t == "string":
            return col.isNotNull() & (col != "")
        if t in ("boolean",):
            return F.coalesce(col, F.lit(False))
        if t in ("date", "timestamp", "timestamp_ntz"):
            return col.isNotNull()
        return col.isNotNull() & (col != 0)
    weights = {"batch_number": 20, "expiry_date": 20, "quantity": 10, "mrp": 5, "ptr": 5}
    raw = F.coalesce(F.col("match_score").cast("double"), F.lit(0.0)) / 100 * 40
    for c, wgt in weights.items():
        if c in lines.columns:
            raw = raw + F.when(truthy(c), F.lit(float(wgt))).otherwise(F.lit(0.0))
    out = py_round_cols(lines.withColumn("_conf", F.least(raw, F.lit(100.0))), {"confidence": ("_conf", 1)})
    return out.drop("_conf").withColumn("needs_correction", F.col("confidence") < 80)


def invoice_confidence(line_conf: DataFrame, invoices: DataFrame) -> DataFrame:
    """P-4 aggregate: invoice confidence = mean of its lines (0 without
    lines); ``needs_review`` below 80."""
    from ..functions.numeric import py_round_cols
    g = line_conf.groupBy("invoice_id").agg(F.avg("confidence").alias("_c"))
    j = invoices.select(F.col("id").alias("invoice_id")).join(g, "invoice_id", "left") \
                .withColumn("_c", F.coalesce("_c", F.lit(0.0)))
    return py_round_cols(j, {"invoice_confidence": ("_c", 1)}).drop("_c") \
        .withColumn("needs_review", F.col("invoice_confidence") < 80)
