"""Connected components over an edge table, in rounds of joins and counts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of the edges
    (columns a, b).  Each round passes the smallest known label over the edges
    and then follows labels one step (label of the label), so that the number
    of rounds follows the logarithm of a chain's length.  Labels and counts
    are pre-aggregated, joins can be split, and only a count of changes
    reaches the driver."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b")
    both = cut(both.distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m")).withColumnRenamed("a", "node")
        new = cut(labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "passed")
        jump = new.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = cut(new.join(jump, "comp").select("node", "old", F.least("comp", "further").alias("comp")), "labels", frees=(new, labels))
        if new.filter("old != comp").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
