"""Token counts without token ids: pieces are counted once per distinct pre-token and summed over per-document frequencies.

Documents are read in blocks. A block turns into one row per distinct pre-token with the documents that hold it and how often
(a posting). Postings meet the piece counts in a join on the pre-token; a pre-token has at most one row per block, so even
one that stands in every document is no hot key. Sums per document then leave every task as one row per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcurate.llm.chunks import CHUNK, Encoder, windows
from linkcurate.llm.common import once, task_number

_MAX_DOCS = 60_000


def count_tokens(
    docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", limit: int = 1024, block_chars: int = 32 << 20
) -> DataFrame:
    """Per row of `docs`: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `tokenizer` is the path of a tokenizers file on every machine; counts equal the library's without added special tokens.
    Null and empty texts have 0; null or repeated keys keep a row each; other columns of `docs` play no part. `block_chars`
    bounds the text that a task holds at a time.
    """
    blocks = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        lambda batches: _postings(batches, tokenizer, block_chars), "word string, block long, docs binary, times binary"
    )
    # Postings of a word meet in one place, ordered, so its pieces are counted once; nothing but sums leaves the task.
    sums = blocks.repartition("word").sortWithinPartitions("word").mapInArrow(
        lambda batches: _partial_sums(_counted(batches, tokenizer)), "block long, docs binary, sums binary"
    )
    counted = sums.groupBy("block").applyInArrow(_totals, "key long, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _splitter(path: str):
    """The worker's encoder, and a pattern of its special tokens, which stand for themselves."""

    def make():
        encoder = Encoder(path)
        return encoder, re.compile("|".join(map(re.escape, sorted(encoder.specials, key=len, reverse=True))) or "(?!)")

    return once(("splitter", path), make)


def _postings(batches: Iterator[pa.RecordBatch], path: str, block_chars: int) -> Iterator[pa.RecordBatch]:
    encoder, special = _splitter(path)
    number = task_number() << 24
    block = _Block(encoder, special)
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            block.add(key, text)
            if block.chars >= block_chars or len(block.keys) >= _MAX_DOCS:
                yield from block.rows(number)
                number, block = number + 1, _Block(encoder, special)
    if block.keys:
        yield from block.rows(number)


class _Block:
    def __init__(self, encoder: Encoder, special) -> None:
        self.encoder, self.special = encoder, special
        self.keys, self.sizes, self.chars = [], [], 0
        self.chunks: dict[str, int] = {}
        self.found: list[np.ndarray] = []

    def add(self, key: int | None, text: str | None) -> None:
        self.keys.append(key)
        text = text or ""
        self.chars += len(text)
        self.sizes.append(len(text.encode("utf-8", "surrogatepass")))
        known, numbers = self.chunks, []
        parts = [text]
        if self.encoder.has_special(text):
            parts, end = [], 0
            for m in self.special.finditer(text):
                parts += [text[end : m.start()], m[0]]
                end = m.end()
            parts.append(text[end:])
        for i, part in enumerate(parts):
            for window in [part] if i % 2 else windows(part):
                for chunk in [(part,)] if i % 2 else CHUNK.findall(window):
                    numbers.append(known.setdefault(chunk, len(known)))
        self.found.append(np.array(numbers, np.uint32))

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        of_chunk, starts = [], [0]
        for chunk in self.chunks:
            of_chunk += [words.setdefault(x, len(words)) for x in (chunk if isinstance(chunk, tuple) else self.encoder.pre_tokens(chunk))]
            starts.append(len(of_chunk))
        of_chunk, starts = np.array(of_chunk, np.int64), np.array(starts, np.int64)
        per_doc = np.array([len(x) for x in self.found])
        chunks = np.concatenate(self.found).astype(np.int64)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        lengths = starts[chunks + 1] - starts[chunks]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[chunks], lengths)
        pairs, times = np.unique(of_chunk[at] << 16 | np.repeat(doc, lengths), return_counts=True)
        word, doc = pairs >> 16, (pairs & 0xFFFF).astype("<u2")
        edges = np.searchsorted(word, np.arange(len(words) + 1))
        names = list(words)
        for i in range(0, len(names), 50_000):
            j = min(i + 50_000, len(names))
            part, lo, hi = edges[i : j + 1], edges[i], edges[j]
            yield _batch(names[i:j], number, _binary(doc[lo:hi], part - lo, 2), _binary(times[lo:hi].astype("<u4"), part - lo, 4))
        keys = pa.array(self.keys, pa.int64())
        meta = pa.record_batch([keys, pa.array(self.sizes, pa.int64())], ["key", "n_bytes"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, meta.schema) as out:
            out.write_batch(meta)
        yield _batch([None], number, pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([b""], pa.binary()))


def _binary(values: np.ndarray, edges: np.ndarray, width: int) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype(np.int32).tobytes()), data])


def _batch(words: list, number: int, docs: pa.Array, times: pa.Array) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(words, pa.string()), pa.array(np.full(len(words), number, np.int64)), docs, times], ["word", "block", "docs", "times"]
    )


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Postings with the number of pieces of their pre-token; rows are ordered by pre-token, and each is counted once."""
    encoder, _ = _splitter(path)
    count, specials = encoder.model.tokenize, set(encoder.specials)
    last: tuple[str | None, int] = (None, 0)
    for batch in batches:
        words = batch.column("word").dictionary_encode()
        known = words.dictionary.to_pylist()
        pieces = [last[1] if x == last[0] else 1 if x in specials else len(count(x)) for x in known]
        if known:
            last = known[-1], pieces[-1]
        found = pa.array(pieces, pa.int32()).take(words.indices)
        yield pa.record_batch([batch.column("block"), batch.column("docs"), batch.column("times"), found], ["block", "docs", "times", "pieces"])


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the rows of a task, one sparse row per block; the rows with keys and sizes pass as they are."""
    held: dict[int, list[np.ndarray]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        blocks, docs, sums = [], [], []
        for block, parts in held.items():
            total = np.bincount(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
            some = np.flatnonzero(total)
            blocks.append(block)
            docs.append(some.astype("<u2").tobytes())
            sums.append(total[some].astype("<i8").tobytes())
        yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(docs, pa.binary()), pa.array(sums, pa.binary())], ["block", "docs", "sums"])

    for batch in batches:
        pieces = batch.column("pieces")
        if pieces.null_count:
            meta = batch.filter(pieces.is_null())
            yield pa.record_batch([meta.column("block"), meta.column("docs"), pa.nulls(len(meta), pa.binary())], ["block", "docs", "sums"])
            batch = batch.filter(pieces.is_valid())
        if not len(batch):
            continue
        block = batch.column("block").to_numpy()
        pieces = batch.column("pieces").to_numpy()
        docs = [np.frombuffer(x, "<u2") for x in batch.column("docs").to_pylist()]
        times = [np.frombuffer(x, "<u4") for x in batch.column("times").to_pylist()]
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for rows in np.split(order, cuts):
            of_doc = np.concatenate([docs[i] for i in rows])
            weight = np.concatenate([times[i] for i in rows]) * np.repeat(pieces[rows].astype(np.int64), [len(docs[i]) for i in rows])
            total = np.bincount(of_doc, weight)
            some = np.flatnonzero(total)
            held.setdefault(int(block[rows[0]]), []).append((some, total[some]))
            size += len(some)
        if size > 4_000_000:
            yield from out()
            held, size = {}, 0
    if held:
        yield from out()


def _totals(parts: pa.Table) -> pa.Table:
    total, meta = np.zeros(1 << 16, np.int64), None
    for docs, sums in zip(parts.column("docs").to_pylist(), parts.column("sums").to_pylist()):
        if sums is None:
            meta = pa.ipc.open_stream(docs).read_all()
        else:
            total[np.frombuffer(docs, "<u2")] += np.frombuffer(sums, "<i8")
    return meta.append_column("n_tokens", pa.array(total[: len(meta)]))
