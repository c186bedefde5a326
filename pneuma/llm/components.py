"""Connected components of an edge table by alternating star contractions.

Every round joins each node to the smallest node around it, first over larger
neighbours, then over smaller ones; the number of edges never grows. Each round is
checkpointed in the shared folder, and only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    return (both.where("b > a").join(low, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    return (down.join(low, F.col("a") == F.col("n"))
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                    F.col("m").alias("b")).where("a <> b").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Nodes are longs and never null; nodes without an edge are not listed.
    """
    now = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(max_rounds):
        new = checkpoint(_small_star(_large_star(now)))
        # Stars are final when no node points to two others and no target points on.
        again = (new.select(F.col("b").alias("x")).distinct().join(new.select(F.col("a").alias("x")), "x", "left_semi")
                 .limit(1).count())
        twice = 0 if again else new.groupBy("a").count().where("count > 1").limit(1).count()
        now = new
        if not again and not twice:
            break
    else:
        raise RuntimeError("components did not settle")
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(now.select(F.col("b"), F.col("b")).distinct()))
