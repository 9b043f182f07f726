"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm.joins import join_groups
from tracklore.llm.scratch import dispose
from tracklore.session import stage

_ROUNDS = 60


def _least_neighbour(sides: DataFrame) -> DataFrame:
    """(u, v, m): every side of an edge with the least of u and its neighbours."""
    groups = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_groups(sides, groups, "u", "n", sides.count()).withColumn("m", F.least("u", "m")).drop("n")


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: 64-bit numbers); a component is
    named by its smallest node.

    Large stars tie each larger neighbour to the least one, small stars each smaller; edges
    shrink to stars around the smallest nodes in a number of rounds about logarithmic in
    the diameter. Nodes with very many neighbours are spread (join_groups).
    """
    edges = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(_ROUNDS):
        if before[0] == 0:
            break
        both = stage(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "sides")
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u <> v").distinct(), "large")  # u > v
        dispose(both, edges)
        near = _least_neighbour(large)
        small = near.select("v", "m").union(near.select(F.col("u").alias("v"), "m"))
        edges = stage(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "small")
        dispose(large)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
