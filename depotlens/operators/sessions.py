"""Request bursts (ST-7, batch form).

The reference's counter renews its 60 s expiry on every hit, so it counts a
run of hits whose gaps are ≤ 60 s – a session, not a sliding window.  Batch
form: previous hit per key (skew-safe ``lag_within``), a session starts
where the gap exceeds 60 s, the session start is carried forward with a
skew-safe running max, and the hit number inside the session comes from the
skew-safe ``rank_within``.  Hits beyond the limit are marked.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..config import BURST_GAP_SECONDS, BURST_LIMITS
from .ranking import lag_within, rank_within


def running_max_within(df: DataFrame, keys: list[str], order: list[str], col: str, out: str,
                       partitions: int | None = None) -> DataFrame:
    """Running max of ``col`` per group in ``order`` without one task per
    group: max inside each (range partition, group) piece plus the max of
    the group's earlier pieces."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = s.withColumn("_loc", F.max(col).over(w))
    piece = s.groupBy("_pid", *keys).agg(F.max(col).alias("_pmax"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    prev = piece.select("_pid", *[F.col(k).alias(f"_k_{k}") for k in keys], F.max("_pmax").over(before).alias("_prev"))
    cond = reduce(lambda a, b: a & b, [local["_pid"] == prev["_pid"]]
                  + [local[k].eqNullSafe(prev[f"_k_{k}"]) for k in keys])
    j = local.join(prev, cond, "left")
    return j.select(*df.columns, F.greatest("_loc", "_prev").alias(out))


def request_bursts(hits: DataFrame, key_col: str = "key", kind_col: str = "kind", ts_col: str = "ts",
                   gap_seconds: int = BURST_GAP_SECONDS, limits: dict | None = None) -> DataFrame:
    """Per hit: session start, hit number within the session and whether it
    exceeds the limit of its key kind (user 500, ip 100 by default)."""
    limits = limits or BURST_LIMITS
    keys = [kind_col, key_col]
    h = hits.withColumn("_id", F.monotonically_increasing_id()) if "hit_id" not in hits.columns \
        else hits.withColumn("_id", F.col("hit_id"))
    lagged = lag_within(h, keys, [ts_col, "_id"], [ts_col])
    gap = F.unix_timestamp(F.col(ts_col)) - F.unix_timestamp(F.col(f"prev_{ts_col}"))
    starts = lagged.withColumn("_start", F.when(F.col(f"prev_{ts_col}").isNull() | (gap > gap_seconds),
                                                F.col(ts_col)))
    sess = running_max_within(starts, keys, [ts_col, "_id"], "_start", "session_start")
    ranked = rank_within(sess, [*keys, "session_start"], [ts_col, "_id"], name="hit_in_session")
    lim = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    return ranked.select(*hits.columns, "session_start", "hit_in_session",
                         (F.col("hit_in_session") > lim[F.col(kind_col)]).alias("over_limit"))
