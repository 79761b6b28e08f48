"""Canonical depot tables derived from the driver's TPC-H style parquet.

Mapping (kept identical in the DuckDB oracle, ``depotlens/oracle/cte.py``):

* depots          one per region; id = region = ``r_name``; inactive: key 4
* products        one per ``p_brand``; attributes from the brand number n
* stock_movements lineitem ⋈ part ⋈ supplier ⋈ nation ⋈ region
* batches         movements grouped by (region, part)
* invoices        orders ⋈ customer; payments derived from invoices
* readings        events as cold-chain sensor readings

With ``bounded`` facts created after ``as_of`` are not visible, for operators
that look at the state on a date; operators without a date take all facts.
Only the fixed-size dimensions (region: 5 rows, nation: 25 rows) are
broadcast explicitly; every other join is left to the planner and AQE,
which converts a join to broadcast only after measuring the built side.
"""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import AS_OF_DEFAULT

# FIXED VALUES: category by brand number n % 6.
CATEGORIES = ["antibiotic", "cold_chain", "vitamin", "pain_relief", "cardiac", "respiratory"]


def as_of_lit(as_of: str = AS_OF_DEFAULT) -> Column:
    return F.lit(as_of).cast("date")


def as_of_ts(as_of: str = AS_OF_DEFAULT) -> Column:
    return F.lit(as_of).cast("date").cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def depots(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region")
    return r.select(
        F.col("r_name").alias("depot_id"),
        F.concat(F.lit("CLIENT-"), (F.col("r_regionkey") % 2).cast("string")).alias("client_id"),
        F.col("r_name").alias("region"),
        (F.col("r_regionkey") != 4).alias("is_active"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "part").select("p_brand").distinct()
    n = F.substring("p_brand", 7, 100).cast("int")
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (n % 6 + 1).cast("int"))
    cold = (n % 6) == 1
    return brands.select(
        F.col("p_brand").alias("product_id"),
        F.col("p_brand").alias("canonical_name"),
        cat.alias("product_category"),
        cold.alias("is_cold_chain"),
        F.when(cold, F.lit(2.0)).cast("double").alias("storage_temp_min"),
        F.when(cold, F.lit(8.0)).cast("double").alias("storage_temp_max"),
        (F.lit(180) + F.lit(30) * (n % 12)).cast("int").alias("default_shelf_life_days"),
        (F.lit(3) + n % 10).cast("int").alias("lead_time_days"),
        (F.lit(10) + n * F.lit(2.5)).cast("decimal(10,2)").alias("ptr"),
    )


def _movement_type() -> Column:
    return (F.when(F.col("l_returnflag") == "N", "IN")
            .when(F.col("l_returnflag") == "A", "OUT")
            .when(F.col("l_linestatus") == "F", "RETURN")
            .when(F.col("l_linenumber") % 2 == 1, "WRITE_OFF")
            .otherwise("TRANSFER"))


def supplier_depot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> depot (region name).  nation/region are fixed 25/5 rows."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(F.broadcast(nr), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("r_name").alias("depot_id"))


def stock_movements(spark: SparkSession, sf_dir: str, as_of: str = AS_OF_DEFAULT,
                    bounded: bool = True) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_linestatus", "l_shipdate")
    if bounded:
        li = li.where(F.col("l_shipdate") <= F.lit(as_of).cast("timestamp_ntz"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sd = supplier_depot(spark, sf_dir)
    j = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
         .join(sd, F.col("l_suppkey") == F.col("s_suppkey")))
    return j.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("movement_id"),
        "depot_id",
        F.col("p_brand").alias("product_id"),
        F.concat(F.col("depot_id"), F.lit("-"), F.col("l_partkey").cast("string")).alias("batch_id"),
        F.col("l_partkey").alias("part_key"),
        _movement_type().alias("movement_type"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.col("l_orderkey").alias("order_key"),
    )


def batches(spark: SparkSession, sf_dir: str, as_of: str = AS_OF_DEFAULT,
            movements: DataFrame | None = None) -> DataFrame:
    m = movements if movements is not None else stock_movements(spark, sf_dir, as_of)
    g = m.groupBy("batch_id", "depot_id", "product_id").agg(
        F.min("created_at").alias("created_at"),
        F.sum(F.when(F.col("movement_type") == "IN", F.col("quantity")).otherwise(0.0)).alias("received"),
        F.sum(F.when(F.col("movement_type") == "OUT", F.col("quantity")).otherwise(0.0)).alias("sold"),
        F.min("part_key").alias("part_key"),
    )
    return g.select(
        "batch_id", "depot_id", "product_id",
        F.col("batch_id").alias("batch_number"),
        F.date_add(as_of_lit(as_of), (F.col("part_key") % 400 - 200).cast("int")).alias("expiry_date"),
        F.col("received").cast("int").alias("quantity_received"),
        F.greatest(F.col("received") - F.col("sold"), F.lit(0.0)).cast("int").alias("quantity_remaining"),
        "created_at",
    )


def invoices(spark: SparkSession, sf_dir: str, as_of: str = AS_OF_DEFAULT, bounded: bool = True) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    if bounded:
        o = o.where(F.col("o_orderdate") <= F.lit(as_of).cast("timestamp_ntz"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    cd = c.join(F.broadcast(nr), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("r_name").alias("depot_id"))
    j = o.join(cd, F.col("o_custkey") == F.col("c_custkey"))
    status = (F.when(F.col("o_orderstatus") == "F", "SETTLED")
              .when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("PENDING"))
    return j.select(
        F.col("o_orderkey").alias("id"),
        "depot_id",
        F.col("o_custkey").cast("string").alias("retailer_id"),
        F.concat(F.lit("INV-"), (F.col("o_custkey") % 40).cast("string")).alias("invoice_number"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
        status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def payments(spark: SparkSession, sf_dir: str, as_of: str = AS_OF_DEFAULT,
             inv: DataFrame | None = None, bounded: bool = True) -> DataFrame:
    """From invoices with id % 4 <> 3: amount = total x (1, 0.5, 0.05);
    invoice link kept when id % 8 < 4; collected 15 days after the invoice."""
    i = inv if inv is not None else invoices(spark, sf_dir, as_of)
    frac = (F.when(F.col("id") % 4 == 0, F.lit(1).cast("decimal(3,2)"))
            .when(F.col("id") % 4 == 1, F.lit(0.5).cast("decimal(3,2)"))
            .otherwise(F.lit(0.05).cast("decimal(3,2)")))
    p = i.where(F.col("id") % 4 != 3).select(
        F.concat(F.lit("PAY-"), F.col("id").cast("string")).alias("id"),
        "depot_id",
        F.when(F.col("id") % 8 < 4, F.col("id").cast("string")).alias("invoice_id"),
        "retailer_id",
        (F.col("total_amount") * frac).cast("decimal(12,2)").alias("amount_paid"),
        (F.col("created_at") + F.expr("INTERVAL 15 DAYS")).alias("collected_at"),
    )
    if bounded:
        p = p.where(F.col("collected_at") <= as_of_ts(as_of))
    return p


def payment_transactions(spark: SparkSession, sf_dir: str, as_of: str = AS_OF_DEFAULT) -> DataFrame:
    """INFLOW = payments; OUTFLOW = 10 % of the extended price of first lines."""
    pay = payments(spark, sf_dir, as_of).select(
        "depot_id", F.col("amount_paid").alias("amount"), F.lit("INFLOW").alias("transaction_type"),
        F.col("collected_at").cast("date").alias("transaction_date"))
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    li = li.where((F.col("l_linenumber") == 1) & (F.col("l_shipdate") <= F.lit(as_of).cast("timestamp_ntz")))
    out = li.join(supplier_depot(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).select(
        "depot_id", (F.col("l_extendedprice").cast("decimal(12,2)") * F.lit(0.1).cast("decimal(2,1)")).cast("decimal(12,2)").alias("amount"),
        F.lit("OUTFLOW").alias("transaction_type"), F.col("l_shipdate").cast("date").alias("transaction_date"))
    return pay.unionByName(out)


def retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nr = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(F.broadcast(nr), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("r_name").alias("depot_id"),
        F.col("c_name").alias("name"),
        F.lit(50000).cast("decimal(12,2)").alias("credit_limit"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("current_outstanding"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sensor readings: device per user, depot by user_id % 5."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = e.join(F.broadcast(r), (F.col("user_id") % 5) == F.col("r_regionkey"))
    return j.select(
        F.col("event_id").alias("reading_id"),
        F.concat(F.lit("DEV"), F.col("user_id").cast("string")).alias("device_id"),
        F.col("r_name").alias("depot_id"),
        (F.col("value").cast("decimal(10,2)") % 12).cast("double").alias("temperature"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def anomaly_movements(movements: DataFrame) -> DataFrame:
    """Movement variant used for anomaly checks: quantity × 6 on orders with
    key % 31 = 0 (plain quantities are uniform 1–50 and never reach z = 2)."""
    return movements.withColumn(
        "quantity", F.when(F.col("order_key") % 31 == 0, F.col("quantity") * 6).otherwise(F.col("quantity")))


def discount_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scheme per depot: percent value 5 + region key, except the last
    region whose scheme is a flat amount (ignored by R-7)."""
    r = read(spark, sf_dir, "region")
    kind = F.when(F.col("r_regionkey") == 4, F.lit("flat")).otherwise(F.lit("percent"))
    terms = F.to_json(F.struct(kind.alias("type"), (F.col("r_regionkey") + 5).alias("value")))
    return r.select(F.concat(F.lit("SCH-"), F.col("r_name")).alias("id"),
                    F.col("r_name").alias("depot_id"), terms.alias("terms"))


def invoice_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines: one per lineitem of the order; unit price = extended
    price ÷ quantity (PTR) with MRP 20 % above, GST = 4 × tax % (0–32, so
    some lines break the 28 % rule)."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                "l_quantity", "l_extendedprice", "l_tax")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        supplier_depot(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    # prices in whole cents with exact half-up integer rounding
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    q = F.col("l_quantity").cast("long")
    unit_c = F.floor((cents * 2 + q) / (q * 2)).cast("long")
    mrp_c = F.floor((unit_c * 24 + 10) / 20).cast("long")
    return j.select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("line_no"),
                    F.col("p_brand").alias("product_id"),
                    F.concat(F.col("depot_id"), F.lit("-"), F.col("l_partkey").cast("string")).alias("batch_id"),
                    F.col("l_quantity").cast("int").alias("quantity"),
                    (mrp_c.cast("decimal(12,0)") / 100).cast("decimal(10,2)").alias("mrp"),
                    (unit_c.cast("decimal(12,0)") / 100).cast("decimal(10,2)").alias("ptr"),
                    (F.col("l_tax") * 400).alias("gst_percent"))
