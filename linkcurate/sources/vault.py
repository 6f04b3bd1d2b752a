"""The vault: the note table, its files, and the tables that go with it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkcurate.functions.notes import file_name, folder_name
from linkcurate.functions.render import note_markdown
from linkcurate.operators.registry import last_updates
from linkcurate.schemas import CHECKPOINTS, NOTE_FILES, REGISTRY
from linkcurate.sources.tables import KeyedTable, locator


def work_order(items: DataFrame) -> Column:
    """Grows in the order in which items are worked on: newest message first, links of one message as they stand in it.

    Messages without a date count as new. Without messages the address decides.
    """
    if "date" not in items.columns:
        return F.struct("url")
    newest = F.coalesce(-F.unix_micros(F.col("date").cast("timestamp")), F.lit(-(2**62)))
    return F.struct(newest.alias("a"), (-F.col("message_id")).alias("b"), F.col("pos").alias("c"), F.col("url").alias("d"))


def note_files(resolved: DataFrame, prefix: str = "../attachments") -> DataFrame:
    """Note rows (`schemas.NOTE_FILES`) of resolved triage rows, one per path.

    Two links of one title and category share a path; the one worked on last
    keeps it, as when notes are written in turn (see `work_order`).
    """
    last = resolved.groupBy("target_path").agg(F.max(F.struct(work_order(resolved).alias("o"), "url")).alias("w"))
    winners = last.select("target_path", F.col("w.url").alias("url"))
    path = F.col("target_path")
    return resolved.join(winners, ["target_path", "url"], "left_semi").select(
        path.alias("file_path"), file_name(path).alias("file_name"),
        folder_name(path).alias("category"), note_markdown(prefix).alias("content"),
    )


def export_notes(notes: DataFrame) -> DataFrame:
    """Write each note to its `file_path` from the executors; returns the paths written.

    Paths are on storage that all executors see. Each file is written whole
    under a name of the task attempt and then renamed, so attempts that run at
    the same time never write to one file, and a retried one leaves no torn
    file. Nothing happens until the result is used.
    """
    located = locator()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        for batch in batches:
            for path, content in zip(batch["file_path"], batch["content"], strict=True):
                store, place = located(path)
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                draft = f"{place}.{attempt}.writing"
                with store.open_output_stream(draft) as out:
                    out.write(content.encode("utf-8"))
                store.move(draft, place)
            yield batch[["file_path"]]

    schema = T.StructType([T.StructField("file_path", T.StringType())])
    return notes.select("file_path", "content").mapInPandas(write, schema)


@dataclass(frozen=True)
class Vault:
    """The tables of one vault below a shared folder."""

    notes: KeyedTable
    registry: KeyedTable
    checkpoints: KeyedTable

    @classmethod
    def at(cls, spark: SparkSession, root: str, buckets: int = 64) -> Vault:
        root = root.rstrip("/")
        return cls(
            KeyedTable(spark, f"{root}/notes", NOTE_FILES, "file_path", buckets).create(),
            KeyedTable(spark, f"{root}/registry", REGISTRY, "url", buckets, keep=("telegram_message_id",)).create(),
            KeyedTable(spark, f"{root}/checkpoints", CHECKPOINTS, "key", 1).create(),
        )

    def record(self, notes: DataFrame, updates: DataFrame, checkpoints: DataFrame, batch: int) -> None:
        """Merge what one batch made: notes, registry rows and checkpoints, each reduced to one row per key."""
        self.notes.merge(notes, batch)
        self.registry.merge(last_updates(updates), batch)
        self.checkpoints.merge(checkpoints, batch)
