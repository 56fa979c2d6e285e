"""Connected components by alternating star contraction over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node reachable.

    Each round joins every node's larger neighbours to its smallest neighbour
    (large star), then its smaller neighbours to the smallest of them (small
    star). Rounds are logarithmic in the number of edges; each writes its edges
    to the shared folder, until all are stars. A node with very many
    neighbours is one row of an aggregate, never a list.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(MAX_ROUNDS):
        pairs = written(pairs, "edges")
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
            pairs.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        # stars: whoever has a smaller neighbour has one, and is nobody's smaller neighbour
        unlike = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if unlike.where("below > 1 or (below = 1 and above = 1)").isEmpty():
            break
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        pairs = small.where("a <> b").distinct()
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
