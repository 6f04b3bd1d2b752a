"""Connected components of a graph of links, by alternating large and small stars, every star written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcurate.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) for every node that has a link; links are undirected."""
    found = stars(links, a, b)
    return found.union(found.select("component", "component").distinct())


def stars(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Like `components`, without the rows of the smallest nodes themselves.

    Either star reads a table of one pair of columns once or twice, so the plans that the driver holds stay small; links that are
    stars of smallest nodes already, as an earlier result is, take no round.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = stored(pairs, "links")
    while not _settled(pairs):
        least = _each(pairs, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "v")
        pairs = stored(pairs.join(least, "v").select("u", F.col("m").alias("v")).distinct(), "links")
        near = pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = _each(near, F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        pairs = stored(pairs.where("u <> v").distinct(), "links")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _each(rows: DataFrame, *pairs: Column) -> DataFrame:
    return rows.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def _settled(pairs: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or none smaller: then the smaller ones are the components."""
    ends = _each(pairs, F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("k")).where("ups > 1 OR ups = 1 AND k > 1").isEmpty()
