"""Connected components of link tables by alternating large-star and small-star steps.

Each step is a minimum per node (partial sums, so a hub costs one row per task) and an equi-join that adaptive
execution may split; every step is written to the shared folder, so lineage stays short and nothing is redone
when an executor is lost. Rounds grow with the logarithm of the longest chain. No link reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    out = scratch.keep(edges.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m")), name)
    scratch.forget(name, 1)
    return out


def stars(edges: DataFrame) -> bool:
    """Has every node at most one edge up, and those that have one none that ends in them?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in links (columns a, b): the component is its smallest node."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not stars(edges):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        # large star: a node's larger neighbours go to the least of its neighbourhood
        large = both.where("y > x").join(_least(both, scratch, "large"), "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = scratch.keep(large, "stars")
        # small star: a node and its smaller neighbours go to the least of them
        small = large.join(_least(large, scratch, "small"), "x")
        pairs = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("y").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        edges = scratch.keep(pairs.distinct(), "edges")
        scratch.forget("edges", 1)
        for name in ("stars", "large", "small"):
            scratch.forget(name)
    # each node above stands once, and each root as often as it has nodes
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
