"""Op 12, conversation prefix trie over range-partitioned paths with a splitter skeleton.

A conversation's *path* is the concatenation of 16-byte digests of its turns
(SHA-256 of role and text, cut), so a trie node is a path prefix and sorted
paths list the trie depth-first.  Paths are range-partitioned by (path,
conv_id) into sorted shards; equal conversations differ in conv_id, so however
many there are, they spread over shards.

Only a prefix that two neighbouring shards share can lie in several shards.
These nodes are the skeleton: the trie of the splitter paths.  In sorted order
it is given by one number per border, the depth to which the last path of a
shard and the first path of the next agree; these numbers (16 bytes a shard,
whatever the paths' length) are broadcast.  One depth-first pass over each
shard then finishes every other node on the spot and emits partial aggregates
of its skeleton nodes, which one ``groupBy`` adds up.  All aggregates are sums
or minima, as each shared thing has one shard that counts it: a node counts as
a child, and takes its text off the savings, in its first shard, and is known
to be a leaf in its last.  Saved tokens are the members' text lengths below
the node (a sum over members) minus each node's length once.

The digest of ends is a hash of one string, which is sequential by nature;
for a skeleton node it is streamed over one string piece per shard, in order,
holding one piece at a time.

One conversation (16 bytes a turn) is taken to fit a task, as one text does.
A shard's nodes are held while the shard is read; the number of shards is
``shards`` (default: the session's shuffle partitions).

Defined cases: rows without a conv_id belong to no conversation and are left
out; null roles and texts count as empty; turns are ordered null first, rows
that share a turn number by digest; repeated rows are turns of their own; no
rows give no nodes; further columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut, table

WIDTH = 16
HEAD = 5
EMPTY = hashlib.sha256(b"").hexdigest()
NODE, PARTIAL, ENDS = 0, 1, 2
SCHEMA = ("kind int, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends_sha256 string, shard int, piece string")
FIELDS = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
                    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("shard", pa.int32()), ("piece", pa.string())])


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest hex, n>>) in turn order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).alias("n"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "n"))).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n"))).alias("turns"))


def shared_heads(lists: DataFrame, every: int = 100, kinds: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % every,
    h = crc32(c) % kinds; at most 2 * every - 1 conversations share a base."""
    heads = lists.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, kinds - 1).alias("head"))
    own = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<digest:string,n:int>>"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), "")).alias("path"), F.transform("turns", lambda x: x["n"]).alias("sizes"))


def agreed(a: bytes, b: bytes) -> int:
    """Number of first turns that two paths share."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    return next(d for d in range(n) if a[d * WIDTH:(d + 1) * WIDTH] != b[d * WIDTH:(d + 1) * WIDTH])


def _agreed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        depth = [-1 if x is None else agreed(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(depth, pa.int64())], ["shard", "depth"])


def skeleton_depths(sorted_paths: DataFrame) -> dict[int, tuple[int, int]]:
    """shard -> depth of agreement with the path before and after the shard
    (-1: none), for shards with rows."""
    ends = sorted_paths.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    border = ends.select("shard", F.lag("last").over(Window.orderBy("shard")).alias("before"), "first")
    left = sorted((r.shard, r.depth) for r in border.mapInArrow(_agreed_batches, "shard int, depth long").collect())
    return {s: (d, left[i + 1][1] if i + 1 < len(left) else -1) for i, (s, d) in enumerate(left)}


def prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """Keys of the path's prefixes of 0..depth turns, each made from the one before."""
    keys = [b"root"]
    for d in range(depth):
        keys.append(hashlib.blake2b(keys[-1] + path[d * WIDTH:(d + 1) * WIDTH], digest_size=20).digest())
    return keys


class _Open:
    """A node on the current path: what the rows of this shard say of it so far."""

    __slots__ = ("row", "size", "first", "low", "children", "inner", "leaves", "saved", "ends", "below")

    def __init__(self, row: int, size: int, first: bool):
        self.row, self.size, self.first = row, size, first
        self.low, self.children, self.inner, self.leaves, self.saved = None, 0, False, 0, 0
        self.ends: list[int] = []
        self.below: list[tuple] = []  # finished children, which wait for this node's conv_id


class Shard:
    """Depth-first pass over one sorted shard; ``out`` gathers result rows."""

    def __init__(self, shard: int, left: int, right: int):
        self.shard, self.left, self.right = shard, left, right
        self.stack: list[_Open] = []
        self.path, self.rows, self.out = b"", 0, []

    def add(self, path: bytes, conv_id: int, sizes: list[int]) -> None:
        if not self.stack:
            self.stack.append(_Open(0, 0, True))
            self.first_keys = prefix_keys(path, max(0, self.left))
            same = 0
        else:
            same = agreed(self.path, path)
            while len(self.stack) > same + 1:
                self.close(False)
        opening = self.rows == 0
        for d in range(same, len(path) // WIDTH):
            self.stack.append(_Open(self.rows, sizes[d], opening))
        top = self.stack[-1]
        top.low = conv_id if top.low is None else min(top.low, conv_id)
        top.ends.append(conv_id)
        self.path, self.rows = path, self.rows + 1

    def close(self, at_end: bool) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        before, after = node.first and depth <= self.left, at_end and depth <= self.right
        n = self.rows - node.row
        leaves = node.leaves + (not node.inner and not after)
        saved = node.saved + node.size * (n - (not before))
        if self.stack:
            up = self.stack[-1]
            up.low = node.low if up.low is None else min(up.low, node.low)
            up.inner, up.children, up.leaves, up.saved = True, up.children + (not before), up.leaves + leaves, up.saved + saved
        ends = ",".join(map(str, node.ends))
        numbers = (depth, node.low), (n, node.children, leaves, saved)
        if before or after:
            keys = self.first_keys if before else self.last_keys
            above = keys[depth - 1] if depth else None
            self.out.append((PARTIAL, keys[depth], above, *numbers[0], None, *numbers[1], None, self.shard, None))
            if node.ends:
                self.out.append((ENDS, keys[depth], *[None] * 9, self.shard, ends))
            self.out += [(NODE, None, keys[depth], *x[:2], None, *x[2:], None, None) for x in node.below]
        else:
            self.out += [(NODE, None, None, *x[:2], node.low, *x[2:], None, None) for x in node.below]
            done = (*numbers[0], *numbers[1], hashlib.sha256(ends.encode()).hexdigest())
            if self.stack:
                self.stack[-1].below.append(done)
            else:
                self.out.append((NODE, None, None, *done[:2], None, *done[2:], None, None))

    def finish(self) -> None:
        self.last_keys = prefix_keys(self.path, max(0, self.right))
        while self.stack:
            self.close(True)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo:lo + 4096]), FIELDS)], schema=FIELDS)


def _walk(depths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, path, sizes, shard = (b.column(b.schema.get_field_index(c)) for c in ("conv_id", "path", "sizes", "shard"))
            if walk is None:
                number = shard[0].as_py()
                walk = Shard(number, *depths.value[number])
            for p, c, s in zip(path.to_pylist(), ids.to_pylist(), sizes.to_pylist()):
                walk.add(p, c, s)
            if len(walk.out) >= 4096:
                yield from _rows(walk.out)
                walk.out = []
        if walk is not None:
            walk.finish()
            yield from _rows(walk.out)
    return run


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each key's pieces joined by commas; rows sorted by (key, shard)."""
    key, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])
    for b in batches:
        for k, piece in zip(b.column(0).to_pylist(), b.column(1)):
            if k != key:
                if key is not None:
                    yield done()
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_py().encode())
    if key is not None:
        yield done()


def trie(rebuilt: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per trie node of (conv_id, path, sizes) rows."""
    spark = rebuilt.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rebuilt, "paths")
    rows = rows.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("shard", F.spark_partition_id()).checkpoint()
    depths = spark.sparkContext.broadcast(skeleton_depths(rows))
    found = cut(rows.mapInArrow(_walk(depths), SCHEMA), "nodes")

    total = found.filter(F.col("kind") == PARTIAL).groupBy("key", "parent_key", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    pieces = found.filter(F.col("kind") == ENDS).select("key", "shard", "piece").repartition("key").sortWithinPartitions("key", "shard").select("key", "piece")
    skeleton = cut(total.join(pieces.mapInArrow(_stream_hash, "key binary, ends_sha256 string"), "key", "left").fillna(EMPTY, ["ends_sha256"]), "skeleton")

    numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    hung = found.filter((F.col("kind") == NODE) & F.col("parent_key").isNotNull()).drop("parent_conv_id").join(above, "parent_key")
    inside = found.filter((F.col("kind") == NODE) & F.col("parent_key").isNull())
    return inside.select(numbers).unionByName(hung.select(numbers)).unionByName(skeleton.join(above, "parent_key", "left").select(numbers))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(paths(shared_heads(turn_lists(table(spark, sf_dir, "conversations")))))


SQL = """
WITH t AS (SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS n, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS d
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': d, 'n': n} ORDER BY turn NULLS FIRST, d) AS x FROM t GROUP BY conv_id),
h AS (SELECT conv_id, x, conv_id - conv_id % 100 AS base,
        xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, b:
          list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, b)), 4294967295), 4294967295) % 6 AS h FROM own),
rebuilt AS (SELECT h.conv_id, list_concat(coalesce(b.x, [])[1:h.h], h.x[h.h + 1:]) AS x FROM h LEFT JOIN own b ON b.conv_id = h.base),
prefix AS (SELECT conv_id, len(x) AS total, d, list_transform(x[1:d], lambda e: e.d) AS p, CASE WHEN d > 0 THEN x[d].n ELSE 0 END AS n
           FROM (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS d FROM rebuilt)),
node AS (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = d), '')) AS ends_sha256 FROM prefix GROUP BY p, d),
child AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (p)),
sub AS (SELECT p[1:d] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_node) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_node f JOIN sub USING (p) LEFT JOIN node u ON f.depth > 0 AND u.p = f.p[1:f.depth - 1]
"""
