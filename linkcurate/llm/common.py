"""Shared helpers: tables, intermediate results in the folder all machines share, cached work of a Python worker."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ONCE: dict[Any, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where it is unset, a local session (as in tests) gets a folder of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = once("folder", lambda: f"file://{tempfile.mkdtemp(prefix='linkcurate-')}")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: later steps do not repeat the work, and a lost executor loses nothing.

    The caller owns the folder and clears it when the results that read it are no longer needed.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """`df` with columns c0, c1, ..., so that an operator can add columns beside them; the new name of each; the columns that undo it."""
    names = {x: f"c{i}" for i, x in enumerate(df.columns)}
    return df.toDF(*names.values()), names, [F.col(new).alias(old) for old, new in names.items()]


def once(key: Any, make: Callable[[], Any]) -> Any:
    """A value made once per Python process."""
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def small(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that a worker holds the texts of few rows as Python strings."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)
