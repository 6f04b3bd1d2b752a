"""Counts and reports. Every aggregate combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_counts(records: DataFrame) -> DataFrame:
    """Records per category, most frequent first, names on ties."""
    return records.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def registry_report(registry: DataFrame) -> DataFrame:
    """One pass over the registry: `category, total, jobs`; the row without category is the total."""
    return registry.rollup("category").agg(
        F.count("*").alias("total"), F.count_if(F.col("item_type") == "job").alias("jobs")
    )


def session_outcomes(todo: DataFrame, links: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """`processed, skipped, failed` of a session over link hits.

    `links` has one row per link with its `hits`; `todo` are those the session
    works on, `failed` (`url`) those of them that raised. A link that is worked
    on is skipped at its later hits; one that raised is tried, and raises, at each.
    """
    marked = links.join(todo.select("url", F.lit(1).alias("_todo")), "url", "left")
    if failed is None:
        marked = marked.withColumn("_failed", F.lit(None).cast("int"))
    else:
        marked = marked.join(failed.select("url", F.lit(1).alias("_failed")), "url", "left")
    worked = F.when(F.col("_failed").isNull(), F.col("_todo"))
    total, lost = F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_failed") == 1, F.col("hits"))), F.lit(0))
    return marked.agg(
        F.count(worked).alias("processed"), (total - F.count(worked) - lost).alias("skipped"), lost.cast("bigint").alias("failed"),
    )


def document_stats(texts: DataFrame, text: str = "text") -> DataFrame:
    """Characters, lines and kilobytes (UTF-8) of a set of texts."""
    return texts.agg(
        F.count(text).alias("documents"),
        F.sum(F.length(text)).cast("bigint").alias("chars"),
        F.sum(F.regexp_count(text, F.lit("\n")) + 1).cast("bigint").alias("lines"),
        F.round(F.sum(F.octet_length(text)) / 1024, 1).alias("kilobytes"),
    )
