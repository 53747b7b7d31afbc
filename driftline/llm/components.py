"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from driftline.llm.tables import written


def smallest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``u``; a map-side minimum, so a hub is no hot group."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node next to it (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = smallest(both).select("node", F.least("node", "low").alias("low"))
    return both.filter("v > u").join(near, F.col("u") == F.col("node")).select(
        F.col("v").alias("u"), F.col("low").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    near = smallest(edges)
    others = edges.join(near, F.col("u") == F.col("node")).filter("v <> low").select(
        F.col("v").alias("u"), F.col("low").alias("v"))
    return others.unionByName(near.select(F.col("node").alias("u"), F.col("low").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    Alternates large and small stars until nothing changes, which takes about
    log(n) rounds. Every round is one written table, so lineage stays short; the
    end is seen from a count and a checksum that the write observes, no link
    reaches the driver.
    """
    state, mark = observed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v"))
    while mark["n"]:
        state, now = observed(small_star(large_star(state).distinct()))
        if now == mark:
            break
        mark = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def observed(links: DataFrame) -> tuple[DataFrame, dict]:
    """The distinct links as a written table, with a count and a checksum of them."""
    seen = Observation()
    text = F.concat_ws(",", "u", "v")
    table = written(links.distinct().observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("hash"),
        F.sum(F.crc32(text.cast("binary"))).alias("crc")), "links")
    return table, seen.get
