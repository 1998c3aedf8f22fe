"""Connected components of links between classes, by alternating large and small stars; no task holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramsieve.llm.common import cut, salted_lookup


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    met = salted_lookup(both.filter("v > u"), low, ["u"], F.col("v"), large=True)
    return met.select(F.col("v").alias("u"), F.least("low", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest neighbour."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    met = salted_lookup(edges, low, ["u"], F.col("v"), large=True).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return met.filter("u <> v").unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """From links (u, v) in any order: (node, component), the smallest node reachable, for every node of a link."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    while True:
        now = cut(_small_star(_large_star(now)))
        # it is done when all links lead to nodes that lead nowhere: no node is both ends' start and another's end
        deep = now.select(F.col("v").alias("n")).distinct().join(now.select(F.col("u").alias("n")).distinct().hint("merge"), "n", "left_semi")
        twice = now.groupBy("u").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("u").alias("n"))
        if deep.unionByName(twice).isEmpty():
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
