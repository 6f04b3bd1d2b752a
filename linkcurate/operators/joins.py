"""Joins that keep their balance when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcurate.sources.tables import input_bytes

HOT_SHARE = 200      # a key with 1/200 of all rows is hot, so there are at most 200 of them
HOT_ROWS = 100_000   # keys below this many rows are never worth splitting
SALTS = 64
SMALL_ROWS = 100_000
SMALL_BYTES = 64 << 20  # no key of a side made from less is worth splitting


def hot_keys(rows: DataFrame, key: str, share: int = HOT_SHARE, min_rows: int = HOT_ROWS) -> DataFrame:
    """The keys that hold at least 1/`share` of all rows: never more than `share` rows.

    Counts are combined before the shuffle, and only the key column is read.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    return counts.filter(
        F.col(key).isNotNull() & (F.col("_n") >= min_rows) & (F.col("_n") * share >= total)
    ).select(key)


def join_unique(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: str,
    how: str = "left",
    *,
    counted: DataFrame | None = None,
    small_bytes: int = SMALL_BYTES,
    share: int = HOT_SHARE,
    min_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join with a right side that has one row per key.

    Rows of a hot left key are spread over `salts` partitions by a hash of the
    column `spread`; the few right rows they meet are repeated that often. Rows
    without a key are spread too. The broadcast list of hot keys is bounded by
    `share`, whatever the size of the data. Keys are counted on `counted`, a
    cheaper frame with the same keys, where one exists; by default on `left`. A
    left side made from less than `small_bytes` is joined as it is.
    """
    if input_bytes(left) <= small_bytes:
        return left.join(right, key, how)
    keys = hot_keys(left if counted is None else counted, key, share, min_rows)
    hot = F.broadcast(keys.withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    salted = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(0)
    ).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def is_small(rows: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """Whether a side is small enough to broadcast; counting stops at `max_rows + 1`."""
    return rows.limit(max_rows + 1).count() <= max_rows


def small_side(rows: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a side for broadcast after counting that it is small; a larger one joins by shuffle."""
    return F.broadcast(rows) if is_small(rows, max_rows) else rows
