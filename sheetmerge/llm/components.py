"""Connected components of a link table, with no group held in one task.

Large-star / small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every round rewires each node to the smallest
node of its neighbourhood. Each round is two aggregations and two joins;
its result is written to the shared checkpoint folder, so a lost executor
costs at most the round it worked on. Nothing is collected but one row with
counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmerge.sources.land import land


def _oriented(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    smallest = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = links.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(smallest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component = smallest node.

    Links may repeat, point either way or join a node to itself; a node
    whose only link is to itself isn't returned. An empty table gives none.
    """
    spark = links.sparkSession
    links = land(spark, _oriented(links, a, b).distinct(), "links")
    while True:
        links = land(spark, _small_star(_large_star(links)), "stars")
        parents = links.select(F.col("u").alias("n"))
        inner = links.select(F.col("v").alias("n")).distinct().join(parents, "n", "left_semi").count()
        if inner:
            continue
        counts = links.groupBy("u").count().filter("count > 1").limit(1).count()
        if not counts:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
