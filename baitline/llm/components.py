"""Connected components of an edge table, in rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Per node of ``edges`` (a, b) with at least one partner: node, root (its least reachable node).

    Each round hangs every node's larger neighbours on its least neighbour, then
    every node and its smaller neighbours likewise.  The rounds grow with the
    logarithm of the longest path.  A node's least neighbour is found within
    tasks first, and joined back as a unique side, so a hub is not gathered.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(hung.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
