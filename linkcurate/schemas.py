"""Schemas of the tables that the library reads and writes."""

from pyspark.sql import types as T

TILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("index", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])

MESSAGES = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("text", T.StringType()),
])

SCRAPED = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("failed_scrape", T.BooleanType()),
    T.StructField("failure_reason", T.StringType()),
    T.StructField("code_snippets", T.ArrayType(T.StringType())),
    T.StructField("visual_tiles", T.ArrayType(TILE)),
])

TRIAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("insights", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("code_snippets", T.ArrayType(T.StringType())),
    T.StructField("original_text", T.StringType()),
    T.StructField("visual_tiles", T.ArrayType(TILE)),
    T.StructField("date_str", T.StringType()),
])

# What a triage model is asked to return; every field may be missing.
MODEL_ANSWER = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("insights", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("code_snippets", T.ArrayType(T.StringType())),
])

REGISTRY = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("item_type", T.StringType(), False),
    T.StructField("telegram_message_id", T.LongType()),
    T.StructField("processed_at", T.TimestampType(), False),
    T.StructField("content_hash", T.StringType()),
])

CHECKPOINTS = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
])

NOTE_FILES = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("content", T.StringType()),
])
