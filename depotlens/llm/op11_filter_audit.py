"""Op 11, filter interaction audit by contractions of contingency tensors.

Every document passes or fails each of the five filters A to E.  Per part the
documents are counted into a 2x2x2x2x2 tensor (0 = pass, 1 = fail along each
axis), once for all rows, once for rows of quality 1, once for toxic rows.
What a step of an order keeps or removes is a contraction of that tensor: an
axis is selected by *pass* (1, 0) for filters applied before, *fail* (0, 1) for
the filter of a removing step, and *all* (1, 1) for filters that come later.
One ``einsum`` per batch of parts evaluates all 120 orders and 5 steps.

Only the tensors (32 counts a part) reach Python.  Filter E (equal to the text
of any smaller id) gathers no group of copies: the smallest id per text digest
is a partial aggregate, and a document passes E when its own (digest, id) is
that pair, a join key that copies do not share.

Defined cases: a null text counts as empty, a null source as the empty string;
a null id is not comparable, so it passes E and fails nobody; rows repeated
with the same id and text are separate documents that share their outcome;
``labels`` may repeat an id (any row with 1 marks it) and null label values
count as 0; no documents give no rows; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, table

WORD = r"[^\x20\x09-\x0D]+"
NAMES = "ABCDE"
PARTS_AT_ONCE = 64
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def own_bits() -> Column:
    """Bits of the filters A to D of the columns text and words."""
    n = F.size("words")
    fails = [n < 50, 100 * F.size(F.array_distinct("words")) < 65 * n,
             100 * F.regexp_count("text", F.lit("[A-Z]")) > 5 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    bits = [F.when(f, 2 ** i).otherwise(0) for i, f in enumerate(fails)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, fails, good, toxic): one row per row of ``docs``; bit i of
    ``fails`` is set when filter i of A to E fails."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = cut(rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), own_bits().alias("own")), "facts")
    first = rows.filter("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["sha", "id"], "left").join(marks, "id", "left").select(
        "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("fails"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def _selectors(n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """(orders, kept, removed): the selections, indexed (order, step, axis, 0 = pass / 1 = fail)."""
    passes, fails, both = (1, 0), (0, 1), (1, 1)
    orders = list(permutations(range(n)))
    kept = np.empty((len(orders), n, n, 2), np.int64)
    removed = kept.copy()
    for o, order in enumerate(orders):
        for step in range(n):
            for at, axis in enumerate(order):
                kept[o, step, axis] = passes if at <= step else both
                removed[o, step, axis] = passes if at < step else fails if at == step else both
    return orders, kept, removed


def contract(tensors: np.ndarray, selection: np.ndarray) -> np.ndarray:
    """Sums of ``tensors`` (part, mark, 2, .., 2) under each row of
    ``selection`` (case, axis, 2): (part, case, mark)."""
    axes = "abcdefgh"[:selection.shape[1]]
    terms = ",".join(f"k{a}" for a in axes)
    return np.einsum(f"pm{axes},{terms}->pkm", tensors, *[selection[:, i] for i in range(len(axes))], optimize="greedy")


def _audit(names: str):
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, kept, removed = _selectors(n)
        step_filter = np.array(orders)                                    # (order, step) -> axis
        labels = pa.array(["".join(names[i] for i in o) for o in orders])
        fails = np.ones((n, n, 2), np.int64)                              # fails one filter, the others as they are
        only = np.tile(np.array([1, 0], np.int64), (n, n, 1))             # fails one filter, passes the others
        fails[range(n), range(n)] = only[range(n), range(n)] = (0, 1)
        cases = len(orders) * n
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS_AT_ONCE):
                part = batch.column(0).slice(lo, PARTS_AT_ONCE)
                p = len(part)
                cells = np.zeros((p, 3, 2 ** n), np.int64)
                for i, rows in enumerate(batch.column(1).slice(lo, PARTS_AT_ONCE).to_pylist()):
                    for r in rows:
                        cells[i, :, r["fails"]] = r["n"], r["good"], r["toxic"]
                # bit i of the cell number is axis i, so the axes come in reverse
                t = cells.reshape((p, 3) + (2,) * n).transpose(0, 1, *range(n + 1, 1, -1))
                k = contract(t, kept.reshape(cases, n, 2))[..., 0].reshape(p, len(orders), n)
                r = contract(t, removed.reshape(cases, n, 2)).reshape(p, len(orders), n, 3)
                own, alone = contract(t, fails)[..., 0], contract(t, only)[..., 0]
                shapley = np.zeros((p, n), np.int64)
                np.add.at(shapley, (np.arange(p)[:, None], step_filter.ravel()[None, :]), r[..., 0].reshape(p, -1))
                cols = [k, r[..., 0], own[:, step_filter] - r[..., 0], alone[:, step_filter], r[..., 1], r[..., 2], shapley[:, step_filter]]
                yield pa.RecordBatch.from_arrays(
                    [part.take(pa.array(np.repeat(np.arange(p), cases))), labels.take(pa.array(np.tile(np.repeat(np.arange(len(orders)), n), p))),
                     pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), p * len(orders))), *[pa.array(c.reshape(-1)) for c in cols]],
                    ["part", "filter_order", "step", *COUNTS])
    return run


def interaction_audit(flags: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, from rows of (part
    string, fails int, good 0/1, toxic 0/1); letter i of ``names`` is bit i."""
    cells = flags.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))
    tensors = cells.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    return tensors.mapInArrow(_audit(names), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first_id FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 5 * length(d.text),
                regexp_matches(d.text, '[#$%&*|]'), coalesce(first_id < d.doc_id, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words d LEFT JOIN firsts USING (text) LEFT JOIN marks m ON m.doc_id = d.doc_id),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, f),
letter AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
per AS (
  SELECT part, filter_order, step, o[step] AS flt,
    n * (NOT list_bool_or(list_transform(o[1:step], lambda i: f[i])))::INT AS kept,
    (f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: f[i])), false))::INT AS gone,
    (f[o[step]] AND coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: f[i])), false))::INT * n AS redundant,
    (f[o[step]] AND list_sum(list_transform(f, lambda x: x::INT)) = 1)::INT * n AS unique_fails, n, good, toxic
  FROM cells, steps),
summed AS (SELECT part, filter_order, step, flt, sum(kept)::BIGINT AS kept, sum(n * gone)::BIGINT AS removed, sum(redundant)::BIGINT AS redundant,
             sum(unique_fails)::BIGINT AS unique_fails, sum(good * gone)::BIGINT AS good_lost, sum(toxic * gone)::BIGINT AS toxic_lost
           FROM per GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, flt)::BIGINT AS shapley FROM summed
"""
