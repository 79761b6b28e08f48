"""Op 8, substring dedup by relative Lempel-Ziv factors.

``relative_lz_dedup`` removes every word covered by a window of 13 words that
also starts in a document with a smaller id.

Method.  The reference of a document is everything with a smaller id.  Its
index is spread over the shuffle partitions in blocks: trigger -> phrases ->
windows, each entry with the smallest id that holds it.  A document is cut
greedily at its triggers; a whole phrase found in the index under a smaller
id is a long factor and goes as one span.  Where phrases only agree in part,
the factor ends inside the phrase, so the windows around that boundary are
looked up one by one (``repeats``).  Every window belongs to one phrase, so
no window is missed at a factor's end.

Defined cases: null, empty and short texts lose nothing; a null doc_id is
the smallest id and returned as null; rows with the same id are not "smaller"
than each other, so they do not remove from each other; no rows give no rows;
further columns of ``docs`` are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import Rule, remove_repeats, text_id
from .scratch import public_id, row_id, table

WIDTH = 13
GRAM = 6


def relative_lz_dedup(docs: DataFrame, width: int = WIDTH, gram: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256,
    n_spans and ``kept`` (the remaining words, null where none went)."""
    gram = gram or max(1, width // 2)
    done = remove_repeats(docs, Rule("word", width, gram, piece=0, earlier=True), id_col, text_col).dropDuplicates(["rid", "tx"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    base = docs.select(row_id(id_col).alias("rid"), text_id(text_col).alias("tx"), words.alias("words")).select(
        "rid", "tx", F.size("words").cast("long").alias("n_words"), F.sha2(F.concat_ws(" ", "words"), 256).alias("all_sha256"))
    zero = F.lit(0).cast("long")
    return base.join(done, ["rid", "tx"], "left").select(
        public_id("rid").alias("doc_id"), "n_words", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"), F.coalesce("n_spans", zero).alias("n_spans"), "kept")


def op8_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz_dedup(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
low AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE first < doc_id),
hit AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
res AS (SELECT doc_id, ws, coalesce(ps, []) AS ps FROM d LEFT JOIN hit USING (doc_id)),
spans AS (SELECT doc_id, count(*) AS n FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.p = g.p - 1) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(coalesce(array_to_string(list_filter(ws, lambda w, i: NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
FROM res LEFT JOIN spans USING (doc_id)
"""
