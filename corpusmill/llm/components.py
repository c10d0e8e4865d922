"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import discard, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (a, b:
    comparable, not null); loops and repeated edges are allowed.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is
    aggregates and joins over edges, written to the shared folder, and the number of
    rounds grows with the logarithm of the longest chain. Only a count and a checksum
    reach the driver. A node with very many edges is a partial minimum in every task.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        last, now = now, stored(_small_star(_large_star(now)), "edges")
        discard(edges.sparkSession, last)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components aren't stable after {max_rounds} rounds")
    children = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return children.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return r.n, int(r.s)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its
    neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.where(F.col("u") != F.col("v")).distinct()
