"""Cold-chain sensor stream (ST-*).

Messages are (topic, payload[, received_at]) rows from any streaming source
(file, Kafka).  The same column functions serve the batch form (checked
against SQL) and the stream.  Extensions beyond the reference (named so):
de-duplication of redelivered messages (QoS 1) by message id, a table of late
readings and a dead-letter output for malformed or temperature-less payloads
(H-11).
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.sinks import DatedTable, upsert_by_key
from ..sources.tpch import as_of_lit

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("temp", T.DoubleType()),
    T.StructField("ts", T.LongType()),
])
DEFAULT_MIN, DEFAULT_MAX = 2.0, 8.0
HEARTBEAT_SHARDS = 16


def readings_as_messages(readings: DataFrame, root: str = "depots") -> DataFrame:
    """Encode canonical readings as sensor messages (topic + JSON payload)."""
    payload = F.to_json(F.struct(F.col("device_id"), F.col("temperature").alias("temp"),
                                 F.unix_timestamp("ts").alias("ts")))
    return readings.select(F.col("reading_id").alias("message_id"),
                           F.concat(F.lit(f"{root}/"), F.col("depot_id"), F.lit("/temperature")).alias("topic"),
                           payload.alias("payload"), F.col("ts").alias("received_at"))


def parse_readings(messages: DataFrame) -> DataFrame:
    """ST-1: depot = 2nd topic segment (topic needs ≥ 3 segments); payload
    JSON; device default ``unknown``; ``ts`` epoch seconds, else the arrival
    time.  Adds ``dead_letter`` (malformed JSON, short topic, missing temp)."""
    parts = F.split("topic", "/")
    p = F.from_json("payload", PAYLOAD_SCHEMA, {"mode": "PERMISSIVE"})
    m = messages.select("*", p.alias("_p"), parts.alias("_parts"))
    ok_topic = F.size("_parts") >= 3
    ts = F.coalesce(F.timestamp_seconds(F.col("_p.ts")), F.col("received_at").cast("timestamp"))
    return m.select(
        *messages.columns,
        F.when(ok_topic, F.element_at("_parts", 2)).alias("depot_id"),
        F.coalesce(F.col("_p.device_id"), F.lit("unknown")).alias("device_id"),
        F.col("_p.temp").alias("temperature"),
        ts.alias("ts"),
        (F.col("_p").isNull() | ~ok_topic | F.col("_p.temp").isNull()).alias("dead_letter"))


def device_thresholds(devices: DataFrame, batches: DataFrame, products: DataFrame, as_of: str,
                      config_min: float | None = None, config_max: float | None = None) -> DataFrame:
    """ST-2: limits of the cold-chain, unexpired, in-stock products of the
    device's depot – the tightest range (max of mins, min of maxes) instead of
    the reference's arbitrary LIMIT 1 row – else config, else 2–8 °C."""
    cold = products.where(F.col("is_cold_chain") & F.col("storage_temp_min").isNotNull()
                          & F.col("storage_temp_max").isNotNull()) \
                   .select("product_id", "storage_temp_min", "storage_temp_max")
    stocked = batches.where((F.col("expiry_date") > as_of_lit(as_of)) & (F.col("quantity_remaining") > 0)) \
                     .select("depot_id", "product_id").distinct()
    lim = stocked.join(cold, "product_id").groupBy("depot_id").agg(
        F.max("storage_temp_min").alias("p_min"), F.min("storage_temp_max").alias("p_max"))
    d = devices.select("device_id", "depot_id").join(lim, "depot_id", "left")
    cmin = F.lit(config_min).cast("double") if config_min is not None else F.lit(None).cast("double")
    cmax = F.lit(config_max).cast("double") if config_max is not None else F.lit(None).cast("double")
    return d.select("device_id", "depot_id",
                    F.coalesce("p_min", cmin, F.lit(DEFAULT_MIN)).alias("threshold_min"),
                    F.coalesce("p_max", cmax, F.lit(DEFAULT_MAX)).alias("threshold_max"))


def flag_excursions(readings: DataFrame, thresholds: DataFrame) -> DataFrame:
    """ST-3: temp < min or temp > max (strict); unknown devices get 2–8 °C.  A
    device listed for several depots has the tightest of their ranges, so a
    reading stays one row.  Works on a stream (stream–static left join)."""
    t = thresholds.groupBy("device_id").agg(F.max("threshold_min").alias("threshold_min"),
                                            F.min("threshold_max").alias("threshold_max"))
    j = readings.join(t, "device_id", "left")
    lo = F.coalesce("threshold_min", F.lit(DEFAULT_MIN))
    hi = F.coalesce("threshold_max", F.lit(DEFAULT_MAX))
    return j.select(*readings.columns, lo.alias("threshold_min"), hi.alias("threshold_max"),
                    ((F.col("temperature") < lo) | (F.col("temperature") > hi)).alias("is_excursion"))


def device_heartbeat(readings: DataFrame) -> DataFrame:
    """ST-5: last event time per device (the reference records arrival)."""
    return readings.groupBy("device_id").agg(F.max("ts").alias("last_seen_at"))


def excursion_alerts(flagged: DataFrame) -> DataFrame:
    """ST-6: one queued alert per excursion reading with a JSON payload."""
    e = flagged.where("is_excursion")
    payload = F.to_json(F.struct("device_id", "depot_id", "temperature", "threshold_min", "threshold_max",
                                 F.col("ts").cast("string").alias("ts")))
    return e.select("device_id", "depot_id", "ts", F.lit("TEMPERATURE_EXCURSION").alias("alert_type"),
                    F.lit("QUEUED").alias("status"), payload.alias("payload"))


def first_deliveries(batch: DataFrame, log: DataFrame, batch_id: int) -> DataFrame:
    """The readings of ``batch`` that ``log`` lacks: of rows with one message id
    the first to arrive, and none whose id is in the log.  Rows without an id
    are all kept, once: not again when the log holds this batch already.  Two
    devices, or one device twice, in the same second are different readings."""
    named = batch.where(F.col("message_id").isNotNull())
    cols = [c for c in batch.columns if c != "message_id"]
    order = F.struct("received_at", "ts", "device_id", "temperature", "topic", "payload")
    named = named.groupBy("message_id").agg(F.min_by(F.struct(*cols), order).alias("_r")).select("message_id", "_r.*")
    rows = named.unionByName(batch.where(F.col("message_id").isNull())).withColumn("batch_id", F.lit(batch_id).cast("long"))

    def key():
        return F.coalesce(F.concat(F.lit("m"), F.col("message_id")), F.concat(F.lit("b"), F.col("batch_id")))
    return rows.withColumn("_k", key()).join(log.select(key().alias("_k")), "_k", "left_anti").drop("_k")


def mark_late(readings: DataFrame, heartbeat: DataFrame, lateness: str) -> DataFrame:
    """``late``: the reading is older than its device's last one, as known
    before the batch, by more than ``lateness``."""
    seen = heartbeat.select("device_id", F.col("last_seen_at").alias("_seen"))
    late = F.col("ts") < F.col("_seen") - F.expr(f"INTERVAL {lateness}")
    return readings.join(seen, "device_id", "left").withColumn("late", F.coalesce(late, F.lit(False))).drop("_seen")


def merged_heartbeat(readings: DataFrame, heartbeat: DataFrame) -> DataFrame:
    """ST-5 over time: the last event time of every device of ``readings``,
    never earlier than ``heartbeat`` has it; the table is kept in shards."""
    new = device_heartbeat(readings)
    old = heartbeat.select("device_id", F.col("last_seen_at").alias("_old"))
    return new.join(old, "device_id", "left").select(
        "device_id", F.greatest("last_seen_at", "_old").alias("last_seen_at"),
        F.pmod(F.hash("device_id"), F.lit(HEARTBEAT_SHARDS)).cast("string").alias("shard"))


def log_batch(batch: DataFrame, batch_id: int, thresholds: DataFrame, sink_dir: str, lateness: str) -> None:
    """ST-4 to ST-6 for one micro-batch.  The log is committed first; alerts,
    late rows and heartbeats are made from the log's rows of this batch, so a
    batch that is run again after a crash gives the same tables.  Only the
    log's days that the batch touches, and the days before, are read: a
    message without a time of its own is dated by its arrival, and may come
    again after midnight."""
    spark = batch.sparkSession
    log = DatedTable(spark, f"{sink_dir}/temperature_log", "reading_date")
    beats = DatedTable(spark, f"{sink_dir}/heartbeat", "shard")
    flagged = flag_excursions(batch, thresholds).withColumn("reading_date", F.to_date("ts"))
    schema = flagged.limit(0).withColumn("batch_id", F.lit(0).cast("long")).withColumn("late", F.lit(False)).schema
    beat_schema = "device_id string, last_seen_at timestamp, shard string"
    days = [r.d for r in flagged.select(F.col("reading_date").alias("d")).distinct().collect()]
    touched = [str(d) if d else "null" for d in days]
    look = sorted({*touched, *(str(d - dt.timedelta(days=1)) for d in days if d)})
    heartbeat = beats.read(beat_schema)

    def fresh(state):
        return mark_late(first_deliveries(flagged, log.read(schema, look, state), batch_id), heartbeat, lateness)
    log.commit(touched, fresh, add=True)

    mine = log.read(schema, touched).where(F.col("batch_id") == batch_id)
    excursion_alerts(mine).write.mode("overwrite").parquet(f"{sink_dir}/alerts/batch_id={batch_id}")
    mine.where("late").drop("batch_id").write.mode("overwrite").parquet(f"{sink_dir}/late/batch_id={batch_id}")
    upsert_by_key(merged_heartbeat(mine, heartbeat), f"{sink_dir}/heartbeat", ["device_id"], "shard")


def run_stream(spark, source_dir: str, thresholds: DataFrame, sink_dir: str, checkpoint_dir: str,
               lateness: str = "10 minutes", available_now: bool = True):
    """ST-4 … ST-6 as one streaming query: file source of messages → parse →
    ``foreachBatch`` → ``log_batch``.  No reading is dropped for its age: there
    is no watermark, redeliveries are told by message id against the log
    itself, and readings later than ``lateness`` are kept, marked and listed
    in the late table."""
    schema = "message_id long, topic string, payload string, received_at timestamp"
    parsed = parse_readings(spark.readStream.schema(schema).parquet(source_dir))

    def write_batch(batch: DataFrame, batch_id: int):
        log_batch(batch, batch_id, thresholds, sink_dir, lateness)

    good = parsed.where(~F.col("dead_letter")).drop("dead_letter")
    w = good.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    dead = parsed.where("dead_letter").writeStream.format("parquet") \
                 .option("checkpointLocation", checkpoint_dir + "_dead").option("path", f"{sink_dir}/dead_letter")
    dead = dead.trigger(availableNow=True) if available_now else dead.trigger(processingTime="30 seconds")
    return w.start(), dead.start()


def burst_stream(hits: DataFrame, gap: str = "60 seconds", watermark: str = "5 minutes") -> DataFrame:
    """ST-7 streaming form: hits per key in session windows with a 60 s gap."""
    return hits.withWatermark("ts", watermark).groupBy("kind", "key", F.session_window("ts", gap)) \
               .agg(F.count(F.lit(1)).alias("hits"))
