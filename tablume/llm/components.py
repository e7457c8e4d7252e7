"""Connected components of a graph given by its links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablume.llm.common import durable


def _smallest(edges: DataFrame) -> DataFrame:
    """For each ``u`` the smallest of its neighbours; combined in each task before the exchange."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_smallest(both), "u").withColumn("m", F.least("u", "m"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_smallest(edges), "u")
    moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = joined.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``, of one type); component is the
    smallest node that links reach. Repeated links and links of a node with itself are allowed.

    Each round hangs nodes on smaller neighbours and is written to the shared folder; the number
    of rounds grows with the logarithm of the longest path, and no round has more rows than the
    links. A node with very many links is one key of joins that adaptive execution may split.
    """
    edges = durable(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    mark = None
    while True:
        edges = durable(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (
        edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.select("node", F.col("node").alias("component")))
    )
