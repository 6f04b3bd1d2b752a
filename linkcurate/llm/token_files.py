"""Files of token ids: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart from the data.

Ids are replaced by their rank in the corpus (0: most frequent), so common ones take one byte. Four ranks share a control
byte with two bits each for the number of bytes (1 to 4); control bytes of a file stand together before its data bytes. A
reader expands control bytes by a table of 256 entries and gathers the data bytes with numpy.

File: 8 bytes magic, then as little-endian unsigned 64-bit integers the number of documents, of ids and of data bytes, then
per document its key, a flag for a null key and its number of ids (unsigned 64-bit), then control bytes, then data bytes.
Files are named by their place in ascending key order. `ranks.bin` (unsigned 32-bit) lists the ids by rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkcurate.llm.chunks import Encoder, by_size
from linkcurate.llm.common import stored

MAGIC = b"RANKVB01"
_WIDTHS = np.array([[(control >> 2 * i & 3) + 1 for i in range(4)] for control in range(256)], np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4)[None, :] <= codes[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The `n` integers of `encode`."""
    widths = _WIDTHS[control].reshape(-1)[:n]
    first = np.cumsum(widths, dtype=np.int64) - widths
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    out = data[first].astype(np.uint32)
    for i in (1, 2, 3):
        more = np.flatnonzero(widths > i)
        if not len(more):
            break
        out[more] |= data[first[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def token_ids(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """key and ids (little-endian unsigned 16-bit integers, 32-bit for larger vocabularies), the end id last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        width = _width(len(encoder.four))
        end = np.array([end_id], width).tobytes()
        for batch in by_size(batches, "text"):
            found, edges = encoder.batch(batch.column("text"))
            found = found.astype(width)
            ids = [found[a:b].tobytes() + end for a, b in zip(edges, edges[1:])]
            yield pa.record_batch([batch.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, ids binary")


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_files(docs: DataFrame, tokenizer: str, folder: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, file_ids: int = 2 << 20) -> DataFrame:
    """Write all documents in ascending key order (null keys first) and return the stored manifest: file, part, n_docs, n_ids.

    Texts are tokenized once and the ids stored; counts by id (as many as the vocabulary has) give the ranks. `file_ids` is the
    intended size of a file; a document is never split, so a longer one makes a larger file. Files are written under a name of
    their own and then renamed, so a task that runs twice leaves one whole file.
    """
    spark = docs.sparkSession
    ids = stored(token_ids(docs, tokenizer, key=key, text=text, end_id=end_id), "ids")
    width = _width(len(Encoder.of(tokenizer).four))
    size = np.dtype(width).itemsize

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), width), minlength=len(total))
            seen[: len(total)] += total
            total = seen
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["id", "n"])

    seen = ids.select("ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    by_rank = np.array([r.id for r in sorted(seen.collect(), key=lambda r: (-r.n, r.id))], "<u4")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(by_rank.tobytes())
    n_ids = ids.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = max(1, -(-n_ids // (size * file_ids)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, nulls, lengths, held = [], [], [], []
        for batch in batches:
            for k, x in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                keys.append(k or 0)
                nulls.append(k is None)
                lengths.append(len(x) // size)
                held.append(x)
        if not keys:
            return
        part = TaskContext.get().partitionId()
        name = f"part-{part:08d}.rvb"
        store, root = fs.FileSystem.from_uri(folder)
        control, body = encode(rank_of[np.frombuffer(b"".join(held), width)])
        index = np.stack([np.array(keys, "<i8").view("<u8"), np.array(nulls, "<u8"), np.array(lengths, "<u8")], axis=1)
        head = np.array([len(keys), sum(lengths), len(body)], "<u8")
        own = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(own) as out:
            for x in (MAGIC, head.tobytes(), index.tobytes(), control, body):
                out.write(x)
        store.move(own, f"{root}/{name}")
        yield pa.record_batch([[name], [part], [len(keys)], [sum(lengths)]], ["file", "part", "n_docs", "n_ids"])

    ordered = ids.repartitionByRange(parts, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    return stored(ordered.mapInArrow(write, "file string, part long, n_docs long, n_ids long"), "manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files themselves: key, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    `ids` are little-endian unsigned 32-bit integers. Starts are summed over the manifest in two levels, by groups of 4,096 files.
    """
    spark = manifest.sparkSession
    grouped = manifest.withColumn("block", F.expr("part div 4096"))
    blocks = grouped.groupBy("block").agg(F.sum("n_ids").alias("_n"))
    blocks = blocks.select("block", (F.sum("_n").over(Window.orderBy("block")) - F.col("_n")).alias("_from"))
    inner = F.sum("n_ids").over(Window.partitionBy("block").orderBy("part")) - F.col("n_ids")
    starts = grouped.withColumn("_in", inner).join(F.broadcast(blocks), "block").select("file", (F.col("_from") + F.col("_in")).alias("start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rvb").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(F.broadcast(starts), "file")
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/ranks.bin") as held:
        by_rank = np.frombuffer(held.read(), "<u4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column("start").to_pylist(), batch.column("content")):
                yield from _documents(content.as_buffer(), start, by_rank)

    return files.select("start", "content").mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long, ids binary")


def _documents(content, start: int, by_rank: np.ndarray, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    raw = np.frombuffer(content, np.uint8)
    if raw[:8].tobytes() != MAGIC:
        raise ValueError("not a file of token ids")
    n_docs, n_ids, n_data = (int(x) for x in raw[8:32].view("<u8"))
    index = raw[32 : 32 + 24 * n_docs].view("<u8").reshape(-1, 3)
    ids = by_rank[decode(raw[32 + 24 * n_docs : len(raw) - n_data], raw[len(raw) - n_data :], n_ids)]
    edges = np.concatenate([[0], np.cumsum(index[:, 2].astype(np.int64))])
    for i in range(0, n_docs, rows):
        part = edges[i : i + rows + 1]
        each = [ids[a:b].tobytes() for a, b in zip(part, part[1:])]
        keys = pa.array(index[i : i + rows, 0].view("<i8"), mask=index[i : i + rows, 1].astype(bool))
        crcs = pa.array(map(zlib.crc32, each), pa.int64())
        yield pa.record_batch(
            [keys, pa.array(start + part[:-1]), pa.array(np.diff(part)), crcs, pa.array(each, pa.binary())], ["key", "start", "n_tokens", "ids_crc32", "ids"]
        )
