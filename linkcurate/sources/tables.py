"""Stored steps, small reading helpers, and keyed tables that batches are merged into."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType


@cache
def _test_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="linkcurate-")


def shared_folder(spark: SparkSession) -> str:
    """The folder for stored steps, named by the session as `spark.checkpoint.dir`.

    A local session without one gets a temporary folder, the same for as long as
    it lives; a cluster must name a shared one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _test_folder(spark.sparkContext.applicationId)


def materialize(frame: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame once as a table in the checkpoint folder and read that.

    The lineage ends there, so lost executors cost nothing that was done; later
    steps read only the columns they need, and the optimizer knows the size.
    """
    spark = frame.sparkSession
    place = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(place)
    return spark.read.schema(frame.schema).parquet(place)


def locator() -> Callable[[str], tuple]:
    """A function that finds the store of a path, as pyarrow opens it, and the place there; each store is opened once.

    Executors get it by value, so it needs nothing of this library there.
    """
    stores = {}

    def located(path: str) -> tuple:
        from pyarrow import fs

        scheme, mark, rest = path.partition("://")
        if not mark:
            return fs.LocalFileSystem(), path
        host, _, tail = rest.partition("/")
        root = f"{scheme}://{host}/"
        if root not in stores:
            stores[root] = fs.FileSystem.from_uri(root)
        store, base = stores[root]
        return store, f"{base.rstrip('/')}/{tail}"

    return located


def input_bytes(rows: DataFrame) -> int:
    """Bytes of the tables a frame reads, by the optimizer's statistics; huge when unknown."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def balanced(frame: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """Spread a table of which one split holds far more than a core's share of the rows.

    Splits are cut by bytes, but one task reads a whole row group: a file of one group fills one split, however many there are.
    So rows are counted per split, which reads no column. A table whose rows are spread already is not shuffled by this.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    filled = frame.groupBy(F.spark_partition_id().alias("_split")).agg(F.count("*").alias("_n"))
    most, total = filled.agg(F.max("_n"), F.sum("_n")).first()
    if not total or 2 * most * cores <= 3 * total:
        return frame
    return frame.repartition(max(cores, input_bytes(frame) // split_bytes))


@dataclass(frozen=True)
class KeyedTable:
    """A table with one row per `key`, stored as Parquet in folders by a hash of the key.

    A batch reads and rewrites only the buckets its keys fall into, by dynamic partition overwrite, so its cost does not grow with
    the number of batches before it. A row that a batch replaces stays beside the new one, marked with the batch, until a later
    batch rewrites its bucket: so the table can be read as of the earlier batches, and a batch that runs twice leaves the same table.
    """

    spark: SparkSession
    root: str
    schema: StructType
    key: str
    buckets: int = 64
    keep: Sequence[str] = ()  # columns of which an old value stays where the new one is NULL

    @property
    def _stored(self) -> StructType:
        return StructType(list(self.schema.fields)).add("_batch", LongType()).add("_until", LongType()).add("bucket", IntegerType())

    def create(self) -> KeyedTable:
        """Make the folder, if it is not there yet."""
        self.spark.createDataFrame([], self._stored).write.mode("ignore").partitionBy("bucket").parquet(self.root)
        return self

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys in column `key`: at most `buckets` numbers."""
        return [r.b for r in keys.select(self.bucket_of(F.col(self.key)).alias("b")).distinct().collect()]

    def _rows(self, before: int | None, buckets: Sequence[int] | None) -> DataFrame:
        rows = self.spark.read.schema(self._stored).parquet(self.root)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(*buckets)) if buckets else rows.limit(0)
        if before is None:
            return rows.filter("_until IS NULL")
        return rows.filter((F.col("_batch") < before) & (F.col("_until").isNull() | (F.col("_until") >= before)))

    def read(self, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table as of the batches below `before`, or all of them; of some buckets, or all."""
        return self._rows(before, buckets).select(*self.schema.fieldNames())

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Put in `rows` (one per key) as batch number `batch`."""
        names, key = self.schema.fieldNames(), self.key
        new = materialize(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]), "batch")
        old = self._rows(batch, self.touched(new)).drop("_until")
        both = old.alias("o").join(new.alias("n").withColumn("_new", F.lit(True)), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
        replaced = F.col("_new") & F.col(f"o.{key}").isNotNull()
        kept = F.struct(*[F.col(f"o.{c}").alias(c) for c in names], F.col("o._batch").alias("_batch"), F.when(replaced, F.lit(batch)).cast("bigint").alias("_until"))
        fresh = [F.coalesce(f"n.{c}", f"o.{c}") if c in self.keep else F.col(f"n.{c}") for c in names]
        made = F.struct(*[x.alias(c) for x, c in zip(fresh, names)], F.lit(batch).cast("bigint").alias("_batch"), F.lit(None).cast("bigint").alias("_until"))
        versions = F.array(F.when(F.col(f"o.{key}").isNotNull(), kept), F.when(F.col("_new"), made))
        out = both.select(F.explode(F.filter(versions, lambda v: v.isNotNull())).alias("v")).select("v.*")
        out = materialize(out.withColumn("bucket", self.bucket_of(F.col(key))), "buckets")
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)
