"""Connected components of an edge table, as a plan of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rounds after which the iteration must have ended; it takes about the logarithm of the longest path.
MOST_ROUNDS = 60


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free hash of them."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """node, root for every end of the edges (columns u and v of one orderable type); root is the least node.

    Large-star and small-star steps in turn until the edges no longer change. Least neighbours come from
    aggregations that combine before the shuffle and are written: joined back to the edges they are broadcast while
    Spark sees that they are small, and beyond that both sides of the join are plain shuffles, whose skewed partitions are
    split, so a node with very many edges is in no single task. Every round is written to the shared folder; only two numbers a round reach the
    driver. An empty table has no components.
    """
    edges = stored(_oriented(edges), "edges")
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS if mark[0] else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m")), "least")
        large = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(_oriented(large), "edges")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "least")
        joined = large.join(least, F.col("u") == F.col("w"))
        small = joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(_oriented(small), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
