"""Smallest position within a value range, for many ranges at once.

``best_in_ranges`` answers, per query (keys, lo..hi, after): the smallest
``pos`` among the points of the same keys whose integer value lies in lo..hi
and whose ``rank`` is greater than ``after``.  Nothing pairs queries with the
points they cover:

* every point is filed under its 4-adic interval on each level, and a range is
  cut into the few maximal such intervals that lie inside it (a constant
  number per level, logarithmic in its width);
* points and query parts of one interval are laid out by descending rank, and a
  running minimum of pos gives the answer of a part: a sweep, linear in rows.

The sweep range-partitions by (keys, interval, rank), so one interval that
holds a third of all points is spread over tasks; minima of whole pieces are
carried over with a window of one row per (partition, interval).  The layout is
written to the shared folder with its partition ids, which stay as they are when
an executor is lost.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

LEVELS = 21  # 4**21 exceeds the width of any DECIMAL(12,2) range in cents


def intervals(lo: str, hi: str, levels: int = LEVELS) -> Column:
    """Maximal 4-adic intervals inside lo..hi: array of (level, cell); the cell
    of value v on level l is floor(v / 4**l)."""
    return F.expr(f"""
      flatten(transform(filter(transform(sequence(0, {levels - 1}), l -> struct(l AS l,
          shiftright({lo} + shiftleft(1L, 2 * l) - 1, 2 * l) AS a, shiftright({hi} + 1, 2 * l) - 1 AS b)), x -> x.a <= x.b),
        x -> transform(
          CASE WHEN shiftright(x.a + 3, 2) > shiftright(x.b + 1, 2) - 1 THEN sequence(x.a, x.b)
               ELSE concat(
                 CASE WHEN x.a < shiftleft(shiftright(x.a + 3, 2), 2) THEN sequence(x.a, shiftleft(shiftright(x.a + 3, 2), 2) - 1) ELSE array() END,
                 CASE WHEN shiftleft(shiftright(x.b + 1, 2), 2) <= x.b THEN sequence(shiftleft(shiftright(x.b + 1, 2), 2), x.b) ELSE array() END) END,
          c -> struct(x.l AS level, c AS cell))))""")


def cells(value: str, levels: int = LEVELS) -> Column:
    """(level, cell) of a value on every level."""
    return F.expr(f"transform(sequence(0, {levels - 1}), l -> struct(l AS level, shiftright({value}, 2 * l) AS cell))")


def levels_for(width: int) -> int:
    """Levels that ranges of at most ``width`` values can use."""
    return min(LEVELS, (max(width, 1).bit_length() + 1) // 2)


def first_in_ranges(points: DataFrame, queries: DataFrame, keys: list[str], query_id: list[str], levels: int = LEVELS) -> DataFrame:
    """``query_id`` columns and the smallest ``pos`` of a point (keys, value, pos)
    in a range (keys, query_id, lo, hi), for queries that have one.  One row
    per interval that holds points is all that meets the queries."""
    filed = points.select(*keys, "pos", F.explode(cells("value", levels)).alias("c")).groupBy(*keys, "c").agg(F.min("pos").alias("pos"))
    parts = queries.select(*keys, *[c for c in query_id if c not in keys], F.explode(intervals("lo", "hi", levels)).alias("c"))
    return parts.join(filed, [*keys, "c"]).groupBy(*query_id).agg(F.min("pos").alias("pos"))


def best_in_ranges(points: DataFrame, queries: DataFrame, keys: list[str], query_id: list[str], levels: int = LEVELS) -> DataFrame:
    """As ``first_in_ranges`` for points (keys, value, rank, pos) with rank
    greater than the query's ``after``; a query may have several rows (ranges).
    No range may be wider than ``levels`` allow (``levels_for``)."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = [c for c in query_id if c not in keys]
    none = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in ids]
    filed = points.select(*keys, F.explode(cells("value", levels)).alias("c"), F.col("rank").cast("long").alias("r"), F.lit(1).alias("kind"), "pos", *none)
    parts = queries.select(*keys, *ids, F.explode(intervals("lo", "hi", levels)).alias("c"), F.col("after").cast("long").alias("r")).select(
        *keys, "c", "r", F.lit(0).alias("kind"), F.lit(None).cast(points.schema["pos"].dataType).alias("pos"), *ids)
    group, order = [*keys, "level", "cell"], [F.col("r").desc(), F.col("kind")]  # a query comes before points of its own rank
    rows = filed.unionByName(parts).select(*keys, "c.level", "c.cell", "r", "kind", "pos", *ids)
    rows = rows.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()).transform(written)
    local = F.min("pos").over(Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    piece = rows.groupBy("_pid", *group).agg(F.min("pos").alias("_least"))
    carried = F.min("_least").over(Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    piece = piece.select("_pid", *group, carried.alias("_carried")).where("_carried IS NOT NULL")
    found = rows.withColumn("_best", local).where("kind = 0").join(piece, ["_pid", *group], "left")
    return found.groupBy(*query_id).agg(F.min(F.least("_best", "_carried")).alias("pos")).where("pos IS NOT NULL")
