"""The registry of processed links and the checkpoints, keyed tables without a primary key.

Both sides of every join here have one row per key unless noted, so a popular
link or path cannot load one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcurate.functions.classify import item_type
from linkcurate.functions.notes import file_name
from linkcurate.functions.quality import needs_reprocessing
from linkcurate.operators.joins import join_unique
from linkcurate.schemas import REGISTRY

COLUMNS = REGISTRY.fieldNames()
_REPLACED = [c for c in COLUMNS if c not in ("url", "telegram_message_id")]


def registry_scan(registry: DataFrame) -> DataFrame:
    """All records, newest first."""
    return registry.select(*COLUMNS).orderBy(F.desc("processed_at"), "url")


def last_updates(updates: DataFrame, order: str = "processed_at") -> DataFrame:
    """Reduce updates to one per link.

    The last row by `order` wins, but the message id is the last one that is
    not NULL.
    """
    row = F.struct(order, *[c for c in _REPLACED if c != order])
    known = F.when(F.col("telegram_message_id").isNotNull(), F.struct(order, "telegram_message_id"))
    last = updates.groupBy("url").agg(F.max(row).alias("r"), F.max(known).alias("k"))
    return last.select(
        "url", *[F.col(f"r.{c}").alias(c) for c in _REPLACED],
        F.col("k.telegram_message_id").alias("telegram_message_id"),
    ).select(*COLUMNS)


def upsert(
    registry: DataFrame, updates: DataFrame, order: str = "processed_at"
) -> DataFrame:
    """Registry after the updates.

    A link that is already there takes all columns from its update, except that
    a missing message id leaves the old one in place. Updates are reduced once
    and meet the registry in one full outer join, which shuffles only the
    updates when the registry is bucketed by `url`.
    """
    new = last_updates(updates, order)
    old, upd = registry.alias("o"), new.withColumn("_new", F.lit(True)).alias("u")
    is_new = F.col("u._new")
    return old.join(upd, F.col("o.url") == F.col("u.url"), "full_outer").select(
        F.coalesce("u.url", "o.url").alias("url"),
        *[F.when(is_new, F.col(f"u.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in _REPLACED],
        F.coalesce("u.telegram_message_id", "o.telegram_message_id").alias("telegram_message_id"),
    ).select(*COLUMNS)


def upsert_checkpoints(checkpoints: DataFrame, updates: DataFrame, batch: str | None = None) -> DataFrame:
    """Latest value per key; an update beats a stored value whatever their times, and a later `batch` beats an earlier one."""
    number = F.lit(0) if batch is None else F.col(batch)
    both = checkpoints.select("key", "value", "updated_at", F.lit(-1).cast("bigint").alias("_new")).unionByName(
        updates.select("key", "value", "updated_at", number.cast("bigint").alias("_new"))
    )
    last = both.groupBy("key").agg(F.max(F.struct("_new", "updated_at", "value")).alias("r"))
    return last.select("key", "r.value", "r.updated_at")


def read_checkpoint(checkpoints: DataFrame, key: str) -> DataFrame:
    """The latest value of one key from an append log or a keyed table; no row if unknown."""
    found = checkpoints.filter(F.col("key") == key)
    return found.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"))


def lookup(links: DataFrame, registry: DataFrame) -> DataFrame:
    """Each distinct link with its registry record (NULLs when unknown) and its `hits`."""
    asked = links.groupBy("url").agg(F.count("*").alias("hits"))
    return asked.join(registry.select(*COLUMNS), "url", "left")


def registered(links: DataFrame, registry: DataFrame) -> DataFrame:
    """The distinct links that have a record."""
    return links.select("url").distinct().join(registry.select("url"), "url", "left_semi")


def present_records(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Records whose note still lies at the stored path. Many records may share one path."""
    return join_unique(registry, files.select("file_path").distinct(), "file_path", "url", "left_semi")


def skip_processed(links: DataFrame, registry: DataFrame, files: DataFrame) -> DataFrame:
    """Links still to process: no record, or a record whose note is gone."""
    return links.join(present_records(registry, files).select("url"), "url", "left_anti")


def missing_files(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Stored paths without a file, with the number of records that point there."""
    paths = registry.groupBy("file_path").agg(F.count("*").alias("records"))
    return paths.join(files.select("file_path"), "file_path", "left_anti")


def unregistered_files(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Files that no record points to."""
    return files.select("file_path").distinct().join(
        registry.select("file_path").distinct(), "file_path", "left_anti"
    )


def reprocess_candidates(registry: DataFrame, limit: int | None = None) -> DataFrame:
    """Records to try again, newest first."""
    wanted = needs_reprocessing(F.col("category"), F.col("title"), F.col("url"))
    ordered = registry.filter(wanted).orderBy(F.desc("processed_at"), "url")
    return ordered if limit is None else ordered.limit(limit)


def _relocated(registry: DataFrame, path: Column, category: Column) -> DataFrame:
    """Registry with path, category and type replaced where `path` is not NULL."""
    new = {"file_path": path, "category": category, "item_type": item_type(category)}
    return registry.select(*[
        F.when(path.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in COLUMNS
    ])


def sync_with_notes(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Point records at the note that carries their base name now.

    Category and type follow the note's folder. Of several notes with one name
    the last path counts, as with updates applied in path order. Names compare
    exactly.
    """
    last = files.groupBy(F.col("file_name").alias("_name")).agg(
        F.max(F.struct("file_path", "category")).alias("f")
    ).select("_name", F.col("f.file_path").alias("_path"), F.col("f.category").alias("_category"))
    named = registry.withColumn("_name", file_name(F.col("file_path")))
    joined = join_unique(named, last, "_name", "url")
    return _relocated(joined, F.col("_path"), F.col("_category"))


def apply_moves(registry: DataFrame, moves: DataFrame) -> DataFrame:
    """Registry after notes were moved (`source_path, target_path, category, url`).

    A record follows the move of the note with its base name, else the move of
    the note with its link.
    """
    named = moves.withColumn("_name", file_name(F.col("source_path")))
    target = F.max(F.struct("source_path", "target_path", "category"))
    by_name = named.groupBy("_name").agg(target.alias("by_name"))
    by_url = moves.filter(F.col("url").isNotNull()).groupBy("url").agg(target.alias("by_url"))
    joined = join_unique(
        registry.withColumn("_name", file_name(F.col("file_path"))), by_name, "_name", "url"
    ).join(by_url, "url", "left")
    move = F.coalesce("by_name", "by_url")
    return _relocated(joined, move["target_path"], move["category"])
