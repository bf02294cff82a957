"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of edges (a, b); comp is the least node of its component.

    Large-star and small-star steps alternate until nothing changes. A step finds each
    node's least neighbour by a partially aggregated minimum and joins it back, so a node
    with very many edges is split like any skewed join key. Edges only ever shrink.
    """
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("m"))
        small = small.union(least.select("u", "m")).where("x <> m").toDF("u", "v").distinct()
        small = scratch.save(small)
        now = _mark(small)
        edges, done, mark = small, now == mark, now
        if done:
            break
    # Now every edge leads from a node to its component's least.
    return edges.select("u", "v").union(edges.select("v", "v").distinct()).toDF("node", "comp")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
