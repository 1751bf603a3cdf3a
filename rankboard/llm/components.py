"""Distributed union-find: connected components by alternating large-star and small-star steps.

Each step replaces edges so that every node points at the smallest node it has
seen; the edge set becomes stars around the smallest node of each component, in a
number of rounds that is logarithmic in practice.  Edges never leave Spark.  The
per-node minima are cut to the shared folder before they are joined, so both sides
of the join are plain shuffles and adaptive execution can split the edges of a
node that many others are linked to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored


def _minima(edges: DataFrame) -> DataFrame:
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")), "cc_minima")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


@stored
def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge; the component is its smallest node.

    Nulls are no nodes; loops and repeated edges change nothing; without edges the result is empty.
    """
    e = cut(edges.where(F.col(src) != F.col(dst))
                 .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "cc_edges")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_minima(both), "u").where(F.col("v") > F.col("u"))
                     .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        low = _minima(large)
        small = (large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(low.withColumnRenamed("m", "v")).distinct())
        e = cut(small, "cc_edges")
        before, state = state, _state(e)
        if state == before:
            break
    return (e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
             .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
