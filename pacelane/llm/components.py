"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelane.llm.frames import settle


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.withColumnRenamed("m", "b")).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    """Rows and an order-free digest of the links, to see that a pass changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of the links ``a``, ``b``.

    Nodes of no link are absent.  Every pass is written to the shared folder, so lineage does not
    grow, and joins on a hot node can be split.  Links between equal nodes count for nothing.
    """
    edges = settle(edges.select("a", "b").where("a <> b").distinct())
    state = _state(edges)
    while True:
        edges = settle(_small(_large(edges)))
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
