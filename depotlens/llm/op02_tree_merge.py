"""Op 2, exact dedup by a tree merge of sorted digest runs (DataFrame only).

Rows are dealt to ``slots`` by a hash of their id.  Every slot holds one run:
its distinct digests with the surviving id and a count, sorted within its
partition.  In each round the runs of ``fan`` neighbouring slots meet and are
merged, keeping the extreme id and the sum of counts, until one logical run
is left (itself spread over the partitions by digest).  The survivors of
groups of two or more then go back down the same tree, so that no key ever
has more than ``fan`` rows above the leaves, and at the leaves no more than
one slot's rows, however many copies a text has.

A digest entry is verified by SHA-256, byte length and a second, independent
64-bit hash; all three travel with the run and must agree to merge.

Defined cases: a null text counts as empty; a null id never survives against
a real one (a group of null ids only has keep_id null and keeps them); rows
repeated with the same id and text share one decision and both count in
group_size; no rows give no rows; further columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, table

ENTRY = ["sha", "len", "xx"]


def tree_merge_dedup(docs: DataFrame, keep: str = "largest", slots: int = 4096, fan: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("len"), F.xxhash64(text).alias("xx"),
        F.pmod(F.xxhash64(id_col), F.lit(slots)).cast("int").alias("slot")), "digests")

    def merged(runs: DataFrame, slot, first: bool = False) -> DataFrame:
        ids, n = (F.col("doc_id"), F.count("*")) if first else (F.col("keep_id"), F.sum("n"))
        return runs.groupBy(slot.alias("slot"), *ENTRY).agg(best(ids).alias("keep_id"), n.alias("n")).sortWithinPartitions("slot", "sha")

    levels = [cut(merged(rows, F.col("slot"), first=True), "runs")]
    width = slots
    while width > 1:
        width = -(-width // fan)
        levels.append(cut(merged(levels[-1], F.floor(F.col("slot") / fan).cast("int")), "runs"))

    down = levels[-1].filter("n > 1")
    for runs in reversed(levels[:-1]):
        below = runs.select("slot", *ENTRY, F.floor(F.col("slot") / fan).cast("int").alias("above"))
        down = cut(below.join(down.withColumnRenamed("slot", "above"), ["above", *ENTRY]).drop("above"), "down")
    return rows.join(down, ["slot", *ENTRY], "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op2_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_merge_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
