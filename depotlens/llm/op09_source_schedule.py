"""Op 9, mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of equal blocks of ``block`` words.  Slot i takes its
source from the van der Corput point of i (its bits reversed behind the binary
point) mapped through the cumulative target shares, so every prefix of the
mix is near the targets.  The k-th slot of a source takes the k-th block of
that source's shuffled document stream (order of an md5 of the id), read at
most ``most`` times.  Slots and stream meet in one join on (source, block).

A source needs ceil(target / block) slots, the last of them cut to what is
left of the target.  Slots that the points deal to it beyond that are dropped,
and the few it lacks come at the end of the mix, so that every source, however
small against a block, takes its target to the word.

Targets: sources in code point order (null last) weigh 3, 1, 2 in turn and
share ``share`` of all words; a target stops at ``most`` times its source and
the excess is shared again by weight (solved at once over the sorted caps).

Ranks and offsets inside a source are prefix sums over buckets of the slot
number or hash, so a source with a third of all rows spreads over tasks; only
per-bucket sums meet in a window.  One row per source is assumed to fit a
task.  Two scalars (total words, number of slots) reach the driver.

Defined cases: null text has size 0; null source is a source of its own; a
document of size 0 takes 0; sources without words have target 0; null ids
stay null; repeated rows are separate documents; no rows give no rows;
further columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut, table

WORD = r"[^\x20\x09-\x0D]+"
BITS = 40
CELLS = 1024
SLOT_BUCKET = 8192


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, src, source_size, target, lo, hi): one row per source; lo and
    hi bound its part of the unit interval."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", (F.row_number().over(every) - 1).cast("int"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("src") % len(weights) + 1)).withColumn("cap", F.col("source_size") * float(most))
    all_ = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("goal", F.sum("source_size").over(all_) * share).withColumn("w_all", F.sum("w").over(all_))
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("full", (F.col("goal") - F.col("cap_before")) * F.col("w") >= F.col("cap") * (F.col("w_all") - F.col("w_before")))
    s = s.withColumn("cap_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0.0)))
    s = s.withColumn("w_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(all_), F.lit(0.0)))
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("w * (goal - cap_full) / nullif(w_all - w_full, 0)")))
    s = s.withColumn("hi", F.expr("sum(target) over (order by src rows between unbounded preceding and current row) / nullif(goal, 0)"))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("src")), F.lit(0.0)))
    s = s.withColumn("hi", F.when(F.col("src") == F.max("src").over(all_), F.lit(2.0)).otherwise(F.col("hi")))
    return s.select("source", "src", "source_size", "target", "lo", "hi")


def source_schedule(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, block: int = 256, seed: str = "mix",
                    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    taken, text_key (xxhash64 of the text)."""
    spark = docs.sparkSession
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("h")), "sizes")
    src = cut(targets(rows, weights, share, most), "targets")
    goal = src.agg(F.sum("target")).first()[0]
    slots = int(-(-(goal or 0) // block))
    need = src.select("src", F.floor("target").alias("goal")).filter("goal > 0").withColumn("slots", F.expr(f"(goal + {block - 1}) div {block}"))

    # the k-th slot of every source
    x = F.conv(F.reverse(F.lpad(F.bin("i"), BITS, "0")), 2, 10).cast("double") / float(2 ** BITS)
    slot = spark.range(slots).withColumnRenamed("id", "i").withColumn("x", x).withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    cell = src.select("src", "lo", "hi", F.explode(F.expr(f"sequence(cast(floor(lo * {CELLS}) as int), cast(least({CELLS - 1}, floor(hi * {CELLS})) as int))")).alias("cell")) \
        .filter("hi > lo")
    slot = cut(slot.join(cell, "cell").filter("x >= lo AND x < hi").select("src", "i", F.floor(F.col("i") / SLOT_BUCKET).alias("b")), "slots")
    ahead = slot.groupBy("src", "b").agg(F.count("*").alias("n")).withColumn(
        "ahead", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("src", "b").orderBy("i")) - 1
    dealt = slot.groupBy("src").agg(F.count("*").alias("dealt"))
    slot = slot.withColumn("r", rank).join(ahead.drop("n"), ["src", "b"]).select("src", (F.col("ahead") + F.col("r")).alias("k"))
    lacking = need.join(dealt, "src", "left").withColumn("dealt", F.coalesce("dealt", F.lit(0))).filter("dealt < slots")
    slot = slot.union(lacking.select("src", F.explode(F.sequence("dealt", F.col("slots") - 1)).alias("k"))).join(need, "src").filter("k < slots").drop("slots")

    # the shuffled stream of every source
    ids = src.select("source", "src", "source_size", "target")
    rows = rows.join(ids, rows["source"].eqNullSafe(ids["source"])).drop(ids["source"]).withColumn("b", F.substring("h", 1, 3))
    sums = rows.groupBy("src", "b").agg(F.sum("size").alias("n")).withColumn(
        "ahead", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("src", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cut(rows.withColumn("inside", inside).join(sums.drop("n"), ["src", "b"]).withColumn("start", F.col("ahead") + F.col("inside")).drop("inside", "ahead", "b", "h"), "stream")

    piece = rows.filter("size > 0").select("src", "start", "size", F.explode(F.expr(f"transform(sequence(0, {most - 1}), e -> start + e * source_size)")).alias("at"))
    piece = piece.withColumn("k", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    part = F.expr(f"greatest(0, least(at + size, (k + 1) * {block}, goal) - greatest(at, k * {block}))")
    taken = piece.join(slot, ["src", "k"]).groupBy("src", "start").agg(F.sum(part).alias("taken"))
    return rows.join(taken, ["src", "start"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), "text_key")


def op9_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_schedule(table(spark, sf_dir, "documents")).drop("text_key")


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sizes GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][(src % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS goal FROM s0),
s2 AS (SELECT *, sum(w) OVER () AS w_all, coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before FROM s1
       WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (goal - cap_before) * w >= cap * (w_all - w_before) AS is_full FROM s2),
s4 AS (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS cap_full, coalesce(sum(w) FILTER (is_full) OVER (), 0) AS w_full FROM s3),
s5 AS (SELECT source, src, source_size, goal, CASE WHEN is_full THEN cap ELSE w * (goal - cap_full) / nullif(w_all - w_full, 0) END AS target FROM s4),
stream AS (SELECT d.*, src, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM sizes d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)

-- the slots of a source cover the words before its target, on the first and the second reading
SELECT doc_id, source, size, source_size, target,
       (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - source_size - start)))::BIGINT AS taken
FROM stream
"""
