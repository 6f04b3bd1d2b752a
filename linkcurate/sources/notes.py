"""Scanning a folder tree of markdown notes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcurate.functions.notes import file_name, folder_name
from linkcurate.sources.tables import locator, materialize

# --- Fixed values: compiled documents start with this and are never notes themselves.
COMPENDIUM_PREFIX = "NOTEBOOKLM"
# So many files are left to Spark's reader at most, which keeps about 1 KB of each on the driver.
FEW_FILES = 20_000
# Bytes that one task reads, that opening a file counts for, and that a worker holds of files before it hands them on.
TASK_BYTES, OPEN_BYTES, HELD_BYTES = 32 << 20, 16 << 10, 8 << 20


def read_notes(spark: SparkSession, vault: str, few: int = FEW_FILES) -> DataFrame:
    """Every `*.md` below `vault`, one row per file; hidden and empty files are no notes, as in Spark's file sources.

    Files are read as bytes: the text source sets up a job configuration and its codecs for every single file.
    Spark's reader keeps the status of every file on the driver, so it gets vaults of `few` files at most. Of a larger one the
    executors list the folders, level by level, into a stored table, and read the files it names: nothing on the driver grows
    with the vault. Only a store that pyarrow does not open is left to Spark's reader at any size.
    """
    root = _large_vault(spark, vault, few)
    files = _read_by_spark(spark, vault) if root is None else _read_by_list(spark, root)
    return files.select(
        "file_path", file_name(F.col("file_path")).alias("file_name"),
        folder_name(F.col("file_path")).alias("category"), "content",
    )


def _read_by_spark(spark: SparkSession, vault: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(vault, recursiveFileLookup=True, pathGlobFilter="*.md")
    raw = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    path = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return files.select(path.alias("file_path"), F.col("content").cast("string").alias("content"))


def _read_by_list(spark: SparkSession, root: str) -> DataFrame:
    """Contents are read only of the files that a filter on paths leaves, and not at all where they are not asked for."""
    located = locator()

    @F.pandas_udf("binary")
    def contents(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            held, size = [], 0
            for path in batch:
                store, place = located(path)
                with store.open_input_file(place) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= HELD_BYTES:
                    yield pd.Series(held, dtype=object)
                    held, size = [], 0
            if held:
                yield pd.Series(held, dtype=object)

    files = note_list(spark, root)
    cost = files.agg(F.sum(F.col("size") + OPEN_BYTES)).first()[0] or 0
    spread = files.repartition(max(spark.sparkContext.defaultParallelism, cost // TASK_BYTES))
    return spread.select(F.col("path").alias("file_path"), contents("path").cast("string").alias("content"))


def note_list(spark: SparkSession, root: str) -> DataFrame:
    """Path and size of every note below the folder `root`, stored; executors list the folders of one level after the other."""
    entries = _lister()

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                rest = entries(folder)
                while part := list(islice(rest, 10_000)):
                    yield pd.DataFrame(part, columns=["path", "size"])

    levels, folders = [], spark.createDataFrame([(root,)], "path string")
    while not levels or not folders.isEmpty():
        spread = folders.repartition(4 * spark.sparkContext.defaultParallelism)
        level = materialize(spread.mapInPandas(listed, "path string, size long"), "note-list")
        levels.append(level.filter("size >= 0"))
        folders = level.filter("size < 0").select("path")
    return reduce(DataFrame.unionByName, levels)


def _lister(every: bool = False) -> Callable[[str], Iterator[tuple[str, int]]]:
    """A function that yields the notes (or every file) and the folders in a folder, with the size of a file and -1 for a folder.

    It leaves out what Spark's file sources do. Executors get it by value, as `locator`.
    """
    located = locator()

    def there(folder: str) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        if "://" in folder:
            store, place = located(folder)
            for info in store.get_file_info(fs.FileSelector(place)):
                yield info.base_name, -1 if info.type == fs.FileType.Directory else info.size
            return
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    size = -1 if entry.is_dir() else entry.stat().st_size
                except OSError:  # a link to nowhere, or gone meanwhile
                    continue
                yield entry.name, size

    def entries(folder: str) -> Iterator[tuple[str, int]]:
        for name, size in there(folder):
            hidden = name.startswith(".") or name.startswith("_") and "=" not in name
            if size < 0:
                wanted = not hidden and not name.endswith("._COPYING_") or name.startswith(("_metadata", "_common_metadata"))
            else:
                wanted = not hidden and (every or size > 0 and name.endswith(".md"))
            if wanted:
                yield f"{folder.rstrip('/')}/{name}", size

    return entries


def _large_vault(spark: SparkSession, vault: str, few: int) -> str | None:
    """The address of a folder with more than `few` files; None for whatever Spark's reader is to read or to refuse."""
    if any(c in vault for c in "{}[]*?\\"):  # a pattern of folders
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(vault)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    uri = store.makeQualified(path).toUri()
    if uri.getScheme() == "file":
        return uri.getPath() if _holds_more(uri.getPath(), few) else None
    if not store.exists(path) or store.getContentSummary(path).getFileCount() <= few:
        return None
    address = f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"
    try:
        locator()(address)
    except (ValueError, OSError):
        return None
    return address


def _holds_more(root: str, few: int) -> bool:
    """Whether a local folder has more than `few` files, notes or not, as Spark's reader keeps them all; looks at no more than that."""
    entries, folders, n = _lister(every=True), [root] if os.path.isdir(root) else [], 0
    while folders and n <= few:
        for path, size in entries(folders.pop()):
            if size < 0:
                folders.append(path)
            elif (n := n + 1) > few:
                break
    return n > few


def note_scan(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Notes of one folder or of all, compiled documents left out."""
    kept = files.filter(~F.col("file_name").startswith(COMPENDIUM_PREFIX))
    return kept if folder is None else kept.filter(F.col("category") == folder)
