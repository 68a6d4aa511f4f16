"""Connected components of an edge table, by alternating star contraction, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm._common import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("root"))
    return both.filter("b > a").join(least, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least.withColumnRenamed("a", "at"), F.col("a") == F.col("at")).filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges(a, b), root the least node of its component.

    Each round is two joins on nodes; hubs are pre-aggregated (min) before they meet, and joins split under AQE. A round's
    result is staged in the shared folder, so lineage stays short. Ends when a round changes nothing.
    """
    now, before = stage(edges.filter("a <> b").select("a", "b").distinct(), "links"), None
    for _ in range(most_rounds):
        now = stage(_small_star(_large_star(now)), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum((F.col("b") == F.col("a")).cast("long"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = seen
    raise RuntimeError("components did not converge")
