"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.sources.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node of ``edges`` (a, b).

    Rounds of large-star and small-star: every edge is moved to the smallest neighbour of one
    of its ends until each component is a star around its smallest node. The rounds grow with
    the logarithm of the graph; each is stored, so a lost executor costs no more than one. Edges
    that are stars already need none. So are the smallest neighbours: a join of two tables that are
    read, unlike one with an aggregate, is dealt so that Spark can split a node with many edges.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.where("a != b").distinct(), "links")
    while not stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = stored(large.where("a != b").distinct(), "links")
        smallest = stored(large.groupBy("a").agg(F.min("b").alias("root")), "smallest")
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        small = small.unionByName(smallest.select("a", F.col("root").alias("b")))
        links = stored(small.where("a != b").distinct(), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def stars(links: DataFrame) -> bool:
    """Whether each node of the distinct edges (a, b) either has one edge, as a, or only such as b."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where("out > 0 and out + into > 1").isEmpty()
