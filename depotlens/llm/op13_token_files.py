"""Op 13, token-id output in seekable zstandard files, and its reader.

Documents are range-partitioned and sorted by id; every task encodes its range
with the tokenizers library (``bytebpe``: whole texts, distinct pieces once a
worker), puts the end id behind each document and writes one file of
independent frames (``tokenfile``, which also tells how a lost executor or a
crash is survived).  Reading opens the files the manifest names and checks
every frame; a request for some documents unpacks only their frames.

Defined cases: a null text counts as empty (its end id alone is written);
documents with a null id come first, rows that share an id are ordered by
XXH64 of their text (equal rows are interchangeable, and a row number spreads
them over tasks); no rows give a data set without files; further columns are
ignored.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.session import ensure_checkpoint_dir

from .scratch import keep, small_batches, table
from .tokenfile import TokenFileSource


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, files: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Write the ids of ``docs`` in ascending id order as ``files`` files
    (default: the session's shuffle partitions) below ``path``."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFileSource)
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    rows = rows.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows.select("doc_id", "text").write.format("token_file").mode("append").options(
        tokenizer=tokenizer or default_tokenizer(), end_id=end_id, **options).save(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>), or ids_crc32 with ``digest``."""
    spark.dataSource.register(TokenFileSource)
    reader = spark.read.format("token_file").option("digest", str(digest).lower())
    return (reader if doc_ids is None else reader.option("doc_ids", ",".join(map(str, doc_ids)))).load(path)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = keep(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}/tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, digest=True)
