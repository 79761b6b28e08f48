"""Op 3, suffix-array dedup by prefix-free parsing.

``prefix_free_dedup`` removes every byte covered by a 400-byte string that
also starts anywhere else in the corpus (same document included).

Method.  Rolling-hash triggers cut every text into overlapping phrases.  The
distinct phrases with their counts are the dictionary, the phrases of a text
in order its parse.  Two corpus suffixes share a 400-byte prefix exactly when
they stand at the same offset from their trigger and agree on the phrase part
that follows.  Full suffix order is not needed beyond that depth, so suffixes
are brought together by class (dictionary phrase, then window fingerprint)
instead of by a total sort; see ``repeats`` for the three counting steps.

Defined cases: a null or short text loses nothing; a null doc_id is treated
as the smallest id and returned as null; repeated rows (same id and text) are
two places, so their long strings go in both; no rows give no rows; further
columns of ``docs`` are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import Rule, remove_repeats, text_id
from .scratch import public_id, row_id, table

WIDTH = 400
GRAM = 200  # trigger length: a text holds about 2 triggers per WIDTH - GRAM + 1 bytes


def prefix_free_dedup(docs: DataFrame, width: int = WIDTH, gram: int | None = None, piece: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and ``kept`` (the remaining bytes, null where none went)."""
    gram = gram or max(1, width // 2)
    done = remove_repeats(docs, Rule("byte", width, gram, piece if width - gram > 2 * piece else 0, earlier=False), id_col, text_col).dropDuplicates(["rid", "tx"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(row_id(id_col).alias("rid"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"), text_id(text_col).alias("tx"))
    zero = F.lit(0).cast("long")
    return base.join(done, ["rid", "tx"], "left").select(
        public_id("rid").alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept")


def op3_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free_dedup(table(spark, sf_dir, "documents")).drop("kept")
