"""Connected components of a graph of any size, as joins and minima.

Large-star and small-star steps alternate until no edge changes: the first hangs every larger neighbour of a node on its
smallest neighbour, the second every smaller one. Edges become stars around the smallest node of each component in a
logarithmic number of rounds. A hub's neighbours are never gathered: the minimum is an aggregate that combines before the
shuffle, and the join that hands it out is a plain equi-join, which Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfare.session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low")).select("low", "high"))
    least = both.groupBy("low").agg(F.min("high").alias("near")).select("low", F.least("low", "near").alias("root"))
    moved = both.where("high > low").join(least, "low").select(F.col("root").alias("low"), "high")
    return moved.where("low < high").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("high").agg(F.min("low").alias("root"))
    moved = edges.join(least, "high")
    hung = moved.select(F.col("root").alias("low"), F.col("low").alias("high")).union(moved.select(F.col("root").alias("low"), "high"))
    return hung.where("low < high").distinct()


def _mark(edges: DataFrame) -> tuple:
    sums = F.sum(F.xxhash64("low", "high").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), sums).first())


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node."""
    own = edges.select(F.least(first, second).alias("low"), F.greatest(first, second).alias("high"))
    own = checkpointed(own.where("low < high").distinct())
    mark = _mark(own)
    while True:
        own = checkpointed(_small_star(_large_star(own)))
        after = _mark(own)
        if after == mark:
            break
        mark = after
    return own.select(F.col("high").alias("node"), F.col("low").alias("component")).union(own.select("low", "low").distinct())
