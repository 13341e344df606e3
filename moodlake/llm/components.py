"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import materialized


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. The number of edges never grows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a table of its own: the join then shuffles both sides, and the edges of a node with very many can be split
    least = materialized(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a <> b").distinct()
    # every edge now points to a smaller node
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                        F.col("m").alias("b"))
    return small.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round is written to the shared folder; rounds go on until the edges, which become stars
    around the smallest nodes, stay the same. Groups are combined map-side or joined, never collected."""
    current = materialized(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        current = materialized(_stars(current), "edges")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
