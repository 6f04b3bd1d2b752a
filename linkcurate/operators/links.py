"""From messages to one row per link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcurate.functions.urls import extract_urls


def message_links(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per distinct link of each message: `message_id, date, pos, url` and the columns to keep."""
    return messages.select(
        "message_id", "date", *keep, F.posexplode(extract_urls(F.col("text"))).alias("pos", "url")
    )


def one_per_url(links: DataFrame, keep: str = "oldest") -> DataFrame:
    """One row per link with the message that decides its fate, and its `hits`.

    A batch run works through the feed newest first and redoes every hit, so the
    oldest message has the last word; a session skips known links, so the newest
    one does. Partial aggregation folds the copies of a popular link before the
    shuffle.
    """
    if keep not in ("oldest", "newest"):
        raise ValueError(f"keep must be 'oldest' or 'newest', not {keep!r}")
    pick = F.min if keep == "oldest" else F.max
    order = F.struct(F.col("date").isNull().alias("undated"), "date", "message_id", "pos")
    return (
        links.groupBy("url")
        .agg(pick(order).alias("m"), F.count("*").alias("hits"))
        .select("url", "m.message_id", "m.date", "m.pos", "hits")
    )


def distinct_urls(links: DataFrame) -> DataFrame:
    return links.select("url").distinct()
