"""Skew-safe ordinal rank within a group.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task: with a
few depots (or one retailer holding a third of all rows) that is one task for
a third of the data.  ``rank_within`` instead:

1. range-partitions on (group, order) – the sampler splits a hot group over
   many partitions – and records the partition id; the result is written to
   the shared checkpoint folder so the ids stay stable if an executor is lost;
2. numbers rows within each (partition, group) piece with a window whose
   groups are at most one range partition large;
3. counts rows per (partition, group) – a partial/final aggregate – and
   turns the counts into offsets with a window over that small table
   (a group spans at most ``n`` partitions);
4. rank = local number + offset of the pieces in earlier partitions.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank_within(df: DataFrame, keys: list[str], order: list, name: str = "rank",
                partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [_as_col(o) for o in order]
    s = df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols) \
          .withColumn("_pid", F.spark_partition_id())
    if checkpoint:
        s = s.checkpoint(eager=True)
    local = s.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order_cols)))
    counts = s.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *[F.col(k).alias(f"_k_{k}") for k in keys],
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    cond = reduce(lambda a, b: a & b,
                  [local["_pid"] == offsets["_pid"]]
                  + [local[k].eqNullSafe(offsets[f"_k_{k}"]) for k in keys])
    out = local.join(offsets, cond).withColumn(name, (F.col("_lr") + F.col("_off")).cast("int"))
    return out.drop("_pid", "_lr", "_off", *[f"_k_{k}" for k in keys])


def lag_within(df: DataFrame, keys: list[str], order: list, cols: list[str], prefix: str = "prev_",
               partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Skew-safe ``lag(col, 1)`` per group: the previous row's ``cols`` in
    (group, order) order, as ``prev_<col>``.

    Same layout as ``rank_within``: lag inside each (range partition, group)
    piece, then the first row of a piece takes the last row of the group's
    piece in the nearest earlier partition (a window over one row per
    (partition, group), i.e. at most ``n`` rows per group)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [_as_col(o) for o in order]
    s = df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols) \
          .withColumn("_pid", F.spark_partition_id())
    if checkpoint:
        s = s.checkpoint(eager=True)
    w = Window.partitionBy("_pid", *keys).orderBy(*order_cols)
    local = s.select("*", F.row_number().over(w).alias("_lr"),
                     *[F.lag(c, 1).over(w).alias(f"{prefix}{c}") for c in cols])
    ordkey = F.struct(*order_cols)
    last = s.groupBy("_pid", *keys).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), ordkey).alias("_last"))
    prev_piece = last.select(
        "_pid", *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.lag("_last", 1).over(Window.partitionBy(*keys).orderBy("_pid")).alias("_prev"))
    cond = reduce(lambda a, b: a & b,
                  [local["_pid"] == prev_piece["_pid"]]
                  + [local[k].eqNullSafe(prev_piece[f"_k_{k}"]) for k in keys])
    j = local.join(prev_piece, cond, "left")
    out = j.select(*[F.col(c) for c in df.columns],
                   *[F.when(F.col("_lr") == 1, F.col(f"_prev.{c}")).otherwise(F.col(f"{prefix}{c}"))
                     .alias(f"{prefix}{c}") for c in cols])
    return out


def histogram(df: DataFrame, keys: list[str], value: str, counts: dict, partitions: int | None = None) -> DataFrame:
    """(keys, value, counts, <count>_before, <count>_all): one row per distinct
    value of a group, with what lies before it in ascending order and in all.

    Equal values collapse in a partial aggregate, so however many rows share
    one value (ties, constants), a task sends one row of it; what is left, the
    distinct values of a group, is range-partitioned (the layout of
    ``rank_within``), and sums of whole pieces are carried over."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h = df.groupBy(*keys, value).agg(*[c.alias(k) for k, c in counts.items()])
    h = h.repartitionByRange(n, *keys, value).withColumn("_pid", F.spark_partition_id()).checkpoint()
    within = Window.partitionBy("_pid", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    piece = h.groupBy("_pid", *keys).agg(*[F.sum(k).alias(k) for k in counts])
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.select("_pid", *keys, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in counts],
                         *[F.sum(k).over(Window.partitionBy(*keys)).alias(f"{k}_all") for k in counts])
    local = h.withColumns({f"{k}_before": F.coalesce(F.sum(k).over(within), F.lit(0)) for k in counts})
    piece = piece.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [local["_pid"] == piece["_pid"]] + [local[k].eqNullSafe(piece[f"_k_{k}"]) for k in keys])
    return local.join(piece, same).drop(*[f"_k_{k}" for k in keys]).withColumns({f"{k}_before": F.col(f"{k}_before") + F.col(f"_{k}") for k in counts}) \
        .drop("_pid", *[f"_{k}" for k in counts])
