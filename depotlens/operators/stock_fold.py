"""L-7, the order-dependent acceptance of stock movements, spread over tasks.

A batch's stock is a fold: a movement that takes more than is there is refused
and takes nothing, so a later smaller one can pass.  Movements are laid out by
(batch, time, id) over range partitions; a batch of any size is a chain of
*pieces*, and only the first batch of a partition can have begun in an earlier
one.  So one number per partition, the stock its first batch comes in with, is
all that partitions must learn from each other.

A piece is summed up by its total effect and its lowest running balance.  When
what comes in covers that lowest point, nothing is refused and the piece's
exit is entry + total.  Otherwise the piece is folded for its entry.  Entries
and exits depend on each other along a chain, so they are found in rounds:
every piece whose expected entry differs from the one it was folded with is
folded again, all at once, until nothing differs.  The first open piece of a
chain is right after each round, so the rounds end; where stock runs low, a
piece's exit hardly depends on its entry and few rounds suffice.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

INFLOW, TAKE, OTHER = 1, -1, 0
SHORT = 64  # batches up to this many movements are folded side by side
PIECES = "pid int, batch_id string, only boolean, total double, lowest double, exit double"
RESULT = "batch_id string, movement_id string, accepted boolean, stock_after double"


def _starts(ids: pa.Array) -> np.ndarray:
    """Where runs of equal batch ids begin; null is an id of its own."""
    code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])


def fold(kind: np.ndarray, quantity: np.ndarray, stock: float) -> tuple[np.ndarray, np.ndarray]:
    """(accepted, stock after) of one batch's movements in order.  Stretches in
    which the running balance covers every take are accepted as a whole."""
    n = len(kind)
    accepted, after = np.ones(n, bool), np.empty(n)
    effect = kind * quantity
    at, width = 0, 64
    while at < n:
        end = min(n, at + width)
        running = stock + np.cumsum(effect[at:end])
        short = np.flatnonzero((kind[at:end] == TAKE) & (running < 0))
        upto = at + int(short[0]) if len(short) else end
        after[at:upto] = running[:upto - at]
        if upto > at:
            stock = float(after[upto - 1])
        width = 64 if len(short) else 2 * width
        if upto < end:
            # a stretch of refusals: takes above the stock, which they leave as it is
            passes = np.flatnonzero((kind[upto:end] != TAKE) | (quantity[upto:end] <= stock))
            stop = upto + int(passes[0]) if len(passes) else end
            accepted[upto:stop], after[upto:stop] = False, stock
            upto = stop
        at = upto
    return accepted, after


def fold_many(kind: np.ndarray, quantity: np.ndarray, starts: np.ndarray, stock: float) -> tuple[np.ndarray, np.ndarray]:
    """(accepted, stock after) of the batches that begin at ``starts``, the first
    with ``stock``, the others with none.  The k-th movements of all short
    batches are taken together; long ones are folded one by one."""
    n = len(kind)
    accepted, after = np.ones(n, bool), np.empty(n)
    size = np.diff(np.append(starts, n))
    odd = np.zeros(len(starts), bool)
    odd[np.searchsorted(starts, np.flatnonzero(~np.isfinite(quantity)), "right") - 1] = True
    alone = odd | (size > SHORT)
    for k in np.flatnonzero(alone):
        lo, hi = starts[k], starts[k] + size[k]
        accepted[lo:hi], after[lo:hi] = fold(kind[lo:hi], quantity[lo:hi], stock if k == 0 else 0.0)
    have = np.zeros(len(starts))
    have[0] = stock
    rest = np.flatnonzero(~alone)
    rest = rest[np.argsort(-size[rest], kind="stable")]
    first, have, size = starts[rest], have[rest], size[rest]
    # a stretch without refusals is summed by itself, as in ``fold``
    effect, base, part = kind * quantity, have.copy(), np.zeros(len(rest))
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, "left"))  # batches with more than k movements
        at = first[:m] + k
        take = kind[at] == TAKE
        short = take & (base[:m] + (part[:m] + effect[at]) < 0)
        base[:m], part[:m] = np.where(short, have[:m], base[:m]), np.where(short, 0.0, part[:m])
        new = base[:m] + (part[:m] + effect[at])
        passes = ~take | (new >= 0)
        part[:m] += np.where(passes, effect[at], 0.0)
        have[:m] = np.where(passes, new, have[:m])
        accepted[at], after[at] = passes, have[:m]
    return accepted, after


def _columns(batch: pa.RecordBatch):
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    return get("pid"), get("batch_id"), get("kind").to_numpy(zero_copy_only=False), get("quantity").to_numpy(zero_copy_only=False)


def _pieces(entries: dict[int, float], folded: set[int] | None):
    """One row per partition for its first and its last batch (``only``: they are
    the same): total effect, lowest running balance, exit for the entry given.
    ``folded``: partitions to look at (None: all).  The batches between begin
    and end here, so nothing is asked of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for b in batches:
            if not b.num_rows:
                continue
            pid, ids, kind, quantity = _columns(b)
            if not begun:
                p, begun = pid[0].as_py(), True
                if folded is not None and p not in folded:
                    return
                first, name, stock, total, lowest, saved = ids[0].as_py(), ids[0].as_py(), entries.get(p, 0.0), 0.0, 0.0, None
            starts = _starts(ids)
            for lo, hi in {(0, int([*starts, len(ids)][1])): 0, (int(starts[-1]), len(ids)): 0}:
                if (at := ids[lo].as_py()) != name or lo:
                    if name == first and saved is None:
                        saved = (total, lowest, stock)
                    name, stock, total, lowest = at, 0.0, 0.0, 0.0
                running = total + np.cumsum(kind[lo:hi] * quantity[lo:hi])
                takes = kind[lo:hi] == TAKE
                lowest = min(lowest, float(running[takes].min()) if takes.any() else 0.0)
                total = float(running[-1])
                stock = float(fold(kind[lo:hi], quantity[lo:hi], stock)[1][-1])
        if begun:
            rows = [(p, first, name == first, *(saved or (total, lowest, stock)))]
            if name != first:
                rows.append((p, name, False, total, lowest, stock))
            types = [pa.int32(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["pid", "batch_id", "only", "total", "lowest", "exit"])
    return run


def _accept(entries: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stock, start = None, 0.0, True
        for b in batches:
            if not b.num_rows:
                continue
            pid, ids, kind, quantity = _columns(b)
            if start:
                name, stock, start = ids[0].as_py(), entries.get(pid[0].as_py(), 0.0), False
            accepted, after = fold_many(kind, quantity, _starts(ids), stock if ids[0].as_py() == name else 0.0)
            name, stock = ids[-1].as_py(), float(after[-1])
            move = b.column(b.schema.get_field_index("movement_id"))
            yield pa.RecordBatch.from_arrays([ids, move, pa.array(accepted), pa.array(after)],
                                             ["batch_id", "movement_id", "accepted", "stock_after"])
    return run


def _entries(firsts: dict[int, tuple], lasts: dict[int, tuple], entries: dict[int, float]) -> tuple[dict[int, float], set[int]]:
    """Entries expected along the chains, and the partitions whose exit for
    their expected entry is not known yet."""
    want, unknown, before = {}, set(), None
    for p in sorted(firsts):
        batch, only, total, lowest, out = firsts[p]
        if before is not None and before[0] == batch:
            want[p] = before[1]
        entry = want.get(p, 0.0)
        if entry + lowest >= 0:
            out = entry + total
        elif entry != entries.get(p, 0.0):
            unknown.add(p)
        before = (batch, out) if only else (lasts[p][0], lasts[p][4])
    return want, unknown


def apply_stock_out(movements: DataFrame, partitions: int | None = None, log: list | None = None) -> DataFrame:
    """L-7: per batch, movements in (time, id) order; IN and RETURN add stock, an
    OUT or WRITE_OFF is accepted only if the stock covers it, other types change
    nothing.  A row per movement: batch_id, movement_id, accepted, stock_after.
    Null quantities count as 0.  ``log`` gathers the pieces folded per round."""
    n = partitions or int(movements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = F.col("movement_type")
    kind = F.when(t.isin("IN", "RETURN"), INFLOW).when(t.isin("OUT", "WRITE_OFF"), TAKE).otherwise(OTHER)
    rows = movements.select("batch_id", "movement_id", "created_at", kind.cast("int").alias("kind"), F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)).alias("quantity"))
    order = ["batch_id", "created_at", "movement_id"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()).checkpoint()
    entries: dict[int, float] = {}
    firsts: dict[int, tuple] = {}
    lasts: dict[int, tuple] = {}
    unknown: set[int] | None = None
    while unknown is None or unknown:
        # at most two rows a partition; where nothing is unknown, nothing is read
        asked = rows.select("pid", "batch_id", "kind", "quantity")
        if unknown is not None:
            asked = asked.where(F.col("pid").isin(sorted(unknown)))
        for r in asked.mapInArrow(_pieces(dict(entries), unknown), PIECES).collect():
            known = firsts if r.pid not in firsts or r.batch_id == firsts[r.pid][0] else lasts
            known[r.pid] = (r.batch_id, r.only, r.total, r.lowest, r.exit)
        want, unknown = _entries(firsts, lasts, entries)
        # exits of the pieces that were not folded for their entry yet are guesses so far
        entries = {**entries, **want}
        if log is not None:
            log.append(len(unknown))
    return rows.drop("created_at").mapInArrow(_accept({**entries, **want}), RESULT)
