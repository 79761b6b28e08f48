"""Corpus pipeline: documents to training-ready piece ids in five stages.

Each stage takes (spark, docs, sf_dir), applies one operator of
``depotlens.llm`` to all rows its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next stage's docs:

1. toxicity (op 4): rows predicted toxic go;
2. exact dedup (op 2): of equal texts the row with the largest doc_id stays;
3. n-gram Jaccard join (op 10): of each group of near duplicates the row with
   the smallest doc_id stays;
4. mixing (op 9): a document appears as often as the mix starts to read it
   (0, 1 or 2 times);
5. SentencePiece encoding (op 6): the piece ids of every text.

All stages but the last return the columns of ``documents``.  Rows with null
ids or texts pass through like any other; rows that are equal in id and text
leave stage 2 once.  The toxicity model and the library's tokenizer cannot be
written in SQL, so there is no ORACLE_SQL; ``tests/llm/test_pipeline.py`` holds
the stages against brute-force versions.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm import op02_tree_merge, op04_toxicity, op06_sentencepiece, op09_source_schedule, op10_parity_sketch
from depotlens.llm.scratch import drop_scratch, row_id, table
from depotlens.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op04_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return op04_toxicity.with_scores(docs, model).filter(F.col("toxic_score") < 0.7).drop("toxic_score")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the join keys of a row: its id and a hash of its text."""
    return docs.withColumn("_id", row_id()).withColumn("_text", F.xxhash64(F.coalesce("text", F.lit(""))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = op02_tree_merge.tree_merge_dedup(docs).filter("kept").select(row_id().alias("_id"), F.unhex("text_sha256").alias("_sha"))
    rows = docs.withColumn("_id", row_id()).withColumn("_sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return rows.join(kept, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = op10_parity_sketch.similar_components(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(row_id().alias("_id"), F.col("text_key").alias("_text"))
    return _keyed(docs).join(kept, ["_id", "_text"], "left_semi").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix = op09_source_schedule.source_schedule(docs).filter("taken > 0")
    times = mix.select(row_id().alias("_id"), F.col("text_key").alias("_text"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    rows = _keyed(docs).join(times, ["_id", "_text"])
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_sentencepiece.encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing", mixing),
    ("SentencePiece encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result is written below the
    shared folder, and the scratch tables of a finished stage go."""
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{i}")
        drop_scratch(spark)
        docs = spark.read.parquet(f"{home}/{i}")
    return docs
