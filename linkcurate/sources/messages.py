"""Message tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkcurate.schemas import MESSAGES


def message_scan(messages: DataFrame, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Messages with text, not older than `since`, from the `limit` newest.

    `limit` counts messages before the text filter. The cutoff is applied first:
    the newest n rows cut at a date are the newest n of the rows after that
    date, so the filter reaches the file scan. A message without a date counts
    as new.
    """
    kept = messages
    if since is not None:
        kept = kept.filter(F.col("date").isNull() | (F.col("date") >= since))
    if limit is not None:
        kept = kept.orderBy(F.desc_nulls_first("date"), F.desc("message_id")).limit(limit)
    return kept.filter(F.col("text") != "")


def cutoff(day: str) -> Column:
    """`YYYY-MM-DD` as midnight UTC (with the session time zone set to UTC)."""
    return F.to_timestamp(F.lit(day), "yyyy-MM-dd")


def message_stream(
    spark: SparkSession,
    path: str,
    *,
    schema: StructType = MESSAGES,
    file_glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A stream of message files (Parquet) that arrive under `path`."""
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
