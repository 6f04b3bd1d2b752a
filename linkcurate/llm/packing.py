"""Best-fit packing of documents into sequences of bounded length.

Bulk-synchronous best-fit decreasing. Pieces and gaps are range-sorted into classes of equal size. A superstep takes the next
smaller class of pieces; the successor sweep walks the runs of equal gaps from the smallest that fits, and gives each run to
as many pieces as it has; which piece gets which gap is settled by the piece's rank within its class; the used gaps move to
their new class, and the next superstep follows. Gaps of a class are kept as runs of consecutive sequence numbers, so the
state is bounded by the capacity alone, whatever the number of documents; the ranks, the only thing that grows with the
data, are computed in a distributed manner, and every piece looks its place up in the runs.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkcurate.llm.chunks import Encoder, by_size
from linkcurate.llm.common import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids).

    A document is its ids and the end id; a null or empty text is the end id alone. Only documents longer than `capacity` are
    cut, into full pieces after a first one that takes the rest. Null and repeated keys are documents like others.
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        lambda batches: _cut(batches, tokenizer, capacity, end_id), PIECES
    )


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, end = Encoder.of(path), end_id.to_bytes(4, "little")
    for batch in by_size(batches, "text"):
        rows: list[tuple] = []
        found, ends = encoder.batch(batch.column("text"))
        for key, first, last in zip(batch.column("doc_id").to_pylist(), ends.tolist(), ends[1:].tolist()):
            ids = found[first:last].tobytes() + end
            n = len(ids) // 4
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
            rows += [(key, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(pieces: DataFrame, *, capacity: int = 1024, length: str = "length") -> DataFrame:
    """`pieces` with sequence_id and offset, their place; sequences are gapless from 0. Lengths must lie in 1..capacity.

    `pieces` is written once, with a number of its own for each row, so repeated rows are rows like others. A class of equal
    lengths may hold any share of the pieces: it is dealt over lots of about an eighth of a task's fair share. The driver gets
    one count per lot (at most capacity + 8 for each shuffle partition) and the runs of gaps.
    """
    spark, names = pieces.sparkSession, pieces.columns
    pieces = stored(pieces.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    classes = {n: k for n, k in pieces.groupBy(length).count().collect()}
    if any(not isinstance(n, int) or not 0 < n <= capacity for n in classes):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    share = max(1000, sum(classes.values()) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    lots = spark.createDataFrame([(n, -(-k // share)) for n, k in classes.items()], f"{length} long, _lots long")
    dealt = pieces.join(F.broadcast(lots), length).withColumn("_lot", F.expr("pmod(xxhash64(_at), _lots)")).drop("_lots")
    before, reached = [], dict.fromkeys(classes, 0)
    for n, lot, k in dealt.groupBy(length, "_lot").count().orderBy(length, "_lot").collect():
        before.append((n, lot, reached[n]))
        reached[n] += k
    firsts = spark.createDataFrame(before, f"{length} long, _lot long, _before long")
    order = Window.partitionBy(length, "_lot").orderBy("_at")
    ranked = dealt.withColumn("_row", F.row_number().over(order) - 1).join(F.broadcast(firsts), [length, "_lot"])
    ranked = ranked.select(*names, (F.col("_row") + F.col("_before")).alias("_rank"))
    moves = np.array(sorted(_supersteps(classes, capacity)), np.int64).reshape(-1, 5)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_at")
    return ranked.mapInArrow(lambda batches: _places(batches, moves, length), f"{kept}, sequence_id long, offset long")


def _places(batches: Iterator[pa.RecordBatch], moves: np.ndarray, length: str) -> Iterator[pa.RecordBatch]:
    key = moves[:, 0] << 48 | moves[:, 1]
    for batch in batches:
        rank = batch.column("_rank").to_numpy()
        move = moves[np.searchsorted(key, batch.column(length).to_numpy().astype(np.int64) << 48 | rank, "right") - 1]
        kept = [x for x in batch.schema.names if x != "_rank"]
        yield pa.record_batch(
            [*(batch.column(x) for x in kept), pa.array(move[:, 3] + rank - move[:, 1]), pa.array(move[:, 4])], [*kept, "sequence_id", "offset"]
        )


def _supersteps(classes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, number of pieces, first sequence number, offset) of best-fit decreasing, class by class."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    moves: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def add(gap: int, first: int, n: int) -> None:
        if not gap:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(sizes, gap)
        heapq.heappush(gaps[gap], (first, n))

    for length in sorted(classes, reverse=True):
        left, rank = classes[length], 0
        while left:
            i = bisect_left(sizes, length)
            if i == len(sizes):  # no gap fits: open as many sequences as the rest needs
                fit = capacity // length
                add(capacity, opened, -(-left // fit))
                opened += -(-left // fit)
                continue
            gap = sizes[i]
            first, n = heapq.heappop(gaps[gap])
            used = min(n, left)
            moves.append((length, rank, used, first, capacity - gap))
            if n > used:
                heapq.heappush(gaps[gap], (first + used, n - used))
            if not gaps[gap]:
                del gaps[gap], sizes[i]
            add(gap - length, first, used)
            left, rank = left - used, rank + used
    return moves


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit(tokenized_pieces(docs, tokenizer, key=key, text=text, capacity=capacity, end_id=end_id), capacity=capacity)
