"""Passages that repeat across documents, found by MinHash banding of paragraphs and by windows of words.

A paragraph is a line, or a sentence of one. Equal paragraphs (same words, A-Z as a-z) form a class. Longer classes are banded,
those that collide are compared by exact Jaccard similarity of their word shingles, and links make components. A paragraph is
repeated if its component stands in a document with a smaller key; of a line of several sentences, from the first to the last
that holds a repeated word.

Copies that start and end anywhere are found by windows of words: of as many windows in a row as a window has words, the one with
the least hash is kept, so two texts that share a run of twice that length keep a window in common. Shared windows next to
each other leave no word out; where such a row ends it is extended word by word, as long as a document with a smaller key goes
on equally. Rows of windows that first stand in one document are joined over the words between them if at most one word in
five of the whole was edited. A run of words that lie in repeated paragraphs, windows or joins is removed if it has at least
`min_words` words.

Texts are stored once, in chunks of a few MB, and never move again. A chunk sends each of its distinct hashes once, with the
smallest key that holds it, sorted and packed, to the lot of that hash; lots answer the chunks that hold what others hold too.
So words and hashes are computed anew from the texts in each of four passes, and a hash that stands in every document is one entry
per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcurate.llm.common import fresh_path, once, small, stored
from linkcurate.llm.components import components
from linkcurate.llm.hashing import LOWER, NOT_BLANK, window_hashes, word_edges
from linkcurate.llm.minhash import bands_of, links_of, low_bytes, signatures

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_CHUNK = 1 << 22
_SENT = "lot int, chunk long, kind string, body binary"
_MARKS = f"{_SENT}, class long, key long, n long, bands array<long>, low binary, text string"
_RUNS = "key long, spans array<struct<start:int,end:int>>, n_words long"


def repeated_passages(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = 50, shingle: int = 5, percent: int = 80, near_words: int = 16,
    bands: int = 12, rows: int = 3,
) -> DataFrame:
    """Per row of `docs`: key, spans (array of start, end in code points, ascending) to remove, and n_words in them.

    The document with the smallest key keeps a passage; repeats inside one document are left alone. Every word of a run of at
    least `min_words` words that a document with a smaller key holds word for word is removed. Paragraphs of fewer than
    `near_words` words count as repeated only if equal; 12 bands of 3 rows find longer ones at 80 % with probability 0.9998. An
    edited passage that is no paragraph is joined only where its windows first stand in the same row.
    Null, empty and blank texts have no spans; rows with a null key are compared with nothing; rows with equal keys are one
    document to each other. Other columns play no part.

    Texts and marks are kept as tables bucketed by chunk, in the shared folder, so that later steps meet them where they lie.
    """
    size = max(1, min(14, (min_words + 1) // 2))
    lots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.monotonically_increasing_id().alias("at"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    held = _bucketed(named.mapInArrow(_chunked, "chunk long, at long, key long, text string"), "texts", lots)
    chunks = held.groupBy("chunk")
    # Sizes and bands of paragraphs, and the least key of each paragraph and window.
    sent = chunks.applyInArrow(lambda table: _sent(_Chunk(table), lots, size, shingle, near_words, bands, rows), _SENT)
    met = sent.groupBy("lot").applyInArrow(lambda table: _met(table, percent), "chunk long, kind string, body binary")
    marks = chunks.cogroup(met.groupBy("chunk")).applyInArrow(lambda table, said: _marked(_Chunk(table), said, lots, size, shingle, near_words, bands, rows), _MARKS)
    marks = _bucketed(marks, "marks", lots)
    # Only paragraphs in a component of several classes need another least key; they are few.
    longer = marks.where("n IS NOT NULL").select(F.col("class").alias("at"), "n", "bands", "low", "text")
    group = components(links_of(longer.select("at", "n", "bands", "low"), longer.select("at", "text"), shingle, percent, rounds=0, settled=3)).withColumnRenamed("node", "class")
    members = marks.where("kind = 'class'").select("chunk", "class", "key").join(group, "class")
    least = members.groupBy("component").agg(F.min("key").alias("least")).where("least IS NOT NULL")
    near = members.join(least, "component").groupBy("chunk").agg(F.collect_list(F.struct("class", "least")).alias("near"))
    # Windows at which a row of shared windows ends, for all chunks that hold them, and how far others go on equally there.
    asked = stored(marks.where("kind = 'ends'").select("lot", "chunk", "body").groupBy("lot").applyInArrow(_asked, "chunk long, body binary"), "asked")
    sides = chunks.cogroup(asked.groupBy("chunk")).applyInArrow(lambda table, said: _sides_sent(_Chunk(table), said, lots, size), "lot int, chunk long, body binary")
    reach = sides.groupBy("lot").applyInArrow(lambda table: _reached(table, size), "chunk long, body binary")
    known = marks.where("kind IN ('units', 'prints')").groupBy("chunk").agg(F.collect_list(F.struct("kind", "body")).alias("known"))
    for other in (near, *(x.groupBy("chunk").agg(F.collect_list("body").alias(name)) for x, name in ((asked, "asked"), (reach, "reach")))):
        known = known.join(other, "chunk", "left")
    found = chunks.cogroup(known.groupBy("chunk")).applyInArrow(lambda table, said: _runs(_Chunk(table), said, size, min_words, percent), _RUNS)
    return found.select(F.col("key").alias(key), "spans", "n_words")


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Like `stored`, as a table of the session whose rows with equal chunks meet without a shuffle."""
    path = fresh_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, "chunk").option("path", path).option("compression", "zstd").saveAsTable(table)
    return df.sparkSession.table(table)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk is named after its first row."""
    chunk, held = None, 0
    for batch in small(batches):
        names = []
        for at, n in zip(batch.column("at").to_pylist(), pc.binary_length(batch.column("text")).to_pylist()):
            if chunk is None or held > _CHUNK:
                chunk, held = at, 0
            held += n or 0
            names.append(chunk)
        yield pa.record_batch([pa.array(names, pa.int64()), *batch.columns], ["chunk", *batch.schema.names])


class _Chunk:
    """The words of the texts of a chunk, one after the other: hashes of any words in a row from sums over all."""

    def __init__(self, table: pa.Table) -> None:
        # Texts ascend by key and row, so that the first place of a hash is its least one.
        table = table.sort_by([("key", "ascending"), ("at", "ascending")])
        self.chunk = table["chunk"][0].as_py() if len(table) else 0
        self.at = table["at"].to_numpy()
        self.named = table["key"].is_valid().to_numpy()
        self.key = table["key"].fill_null(0).to_numpy()
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in table["text"].to_pylist()]
        self.base = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        self.starts, self.ends = word_edges(self.data, NOT_BLANK)
        self.first = np.searchsorted(self.starts, self.base)
        self.words = _word_hashes(self.data, self.starts, self.ends)
        self.n = len(self.starts)
        #: The text of each word.
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._back = _powers(_BACK, self.n)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * _powers(_STEP, self.n), dtype=np.uint64)])

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words from `first` up to before `last`, which must hold one at least."""
        sums = (self._sums[last] - self._sums[first]) * self._back[first] + (last - first).astype(np.uint64)
        return (sums ^ (sums >> np.uint64(31))) * np.uint64(_STEP)

    @cached_property
    def units(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Paragraphs: how many are sentences (these stand first), the first word of each and the one after its last.

        A sentence ends with a line or with a word that ends in . ! or ?, unless that word is this one character and the sentence's first.
        Lines of one sentence are left out.
        """
        if not self.n:
            return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        feeds = np.flatnonzero(self.data == 10)
        line = np.concatenate([np.searchsorted(feeds, self.ends[:-1]) < np.searchsorted(feeds, self.starts[1:]), [True]])
        mark = np.isin(self.data[self.ends - 1], np.frombuffer(b".!?", np.uint8))
        stop = line | mark
        for i in np.flatnonzero(mark & ~line & (self.ends - self.starts == 1)):
            stop[i] = i > 0 and not stop[i - 1]
        last = np.flatnonzero(stop) + 1
        line_last = np.flatnonzero(line) + 1
        first, line_first = np.concatenate([[0], last[:-1]]), np.concatenate([[0], line_last[:-1]])
        several = np.searchsorted(last, line_last) > np.searchsorted(last, line_first, "right")
        return len(last), np.concatenate([first, line_first[several]]), np.concatenate([last, line_last[several]])

    def classes(self, near_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of longer paragraphs, ascending, with first word and the one after the last."""
        _, first, last = self.units
        longer = last - first >= near_words
        first, last = first[longer], last[longer]
        hashes, some = np.unique(self.hashes(first, last), return_index=True)
        return hashes, first[some], last[some]

    def signed(self, first: np.ndarray, last: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of paragraphs, and how many distinct shingles of `n` words each has; fewer words are one shingle."""
        windows = window_hashes(self.words, n)
        whole = self.hashes(first, last)
        sets = [windows[a : b - n + 1] if b - a >= n else whole[i : i + 1] for i, (a, b) in enumerate(zip(first.tolist(), last.tolist()))]
        signed, counts = [np.zeros((0, size), np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(sets), 512):
            some = sets[i : i + 512]
            signed.append(signatures(some, size))
            # The low 9 bits of a shingle give way to its paragraph, so that one sort tells what is distinct within each.
            owner = np.repeat(np.arange(len(some), dtype=np.uint64), [len(x) for x in some])
            shingles = np.sort(np.concatenate(some) >> np.uint64(9) << np.uint64(9) | owner)
            counts.append(np.bincount((shingles[_new(shingles)] & np.uint64(511)).astype(np.int64), minlength=len(some)))
        return np.concatenate(signed), np.concatenate(counts)

    def prints(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first words of the windows that are least among `size` in a row of a text with a key."""
        n = self.n - size + 1
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.arange(n)
        hashes = self.hashes(at, at + size)
        values, none = hashes.view(np.int64), np.iinfo(np.int64).min
        least = _sliding(values, size, np.minimum)
        whole = self.text[: len(least)] == self.text[2 * size - 2 :]
        least = np.where(whole & self.named[self.text[: len(least)]], least, none)
        # A window is the least of some row exactly if the largest of the least values of the rows around it is its own.
        edge = np.full(size - 1, none)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), size, np.maximum) == values)
        return hashes[chosen], chosen

    def least_units(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of the paragraphs of texts with a key, ascending, and the least key of each."""
        _, first, last = self.units
        first, last = (x[self.named[self.text[first]]] for x in (first, last))
        order = np.argsort(first, kind="stable")
        hashes, some = np.unique(self.hashes(first[order], last[order]), return_index=True)
        return hashes, self.key[self.text[first[order[some]]]]

    def least_prints(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, ascending, and the least key, row and place of each."""
        hashes, some = np.unique(hashes, return_index=True)
        at = at[some]
        text = self.text[at]
        return hashes, self.key[text], self.at[text], at - self.first[text]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """As `hashing.word_hashes`, from sums over the bytes of many words."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), block):
        a, b = int(starts[i]), int(ends[min(i + block, len(starts)) - 1])
        first, last = starts[i : i + block] - a, ends[i : i + block] - a
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * _powers(_BACK, b - a), out=sums[1:])
        out[i : i + block] = (sums[last] - sums[first]) * _powers(_STEP, b - a)[last - 1]
    return (out ^ (out >> np.uint64(29))) * np.uint64(_STEP)


def _powers(of: int, n: int) -> np.ndarray:
    """The first `n` powers modulo 2**64; they are kept for later texts."""
    held = once(("powers", of), lambda: [np.ones(1, np.uint64)])
    if len(held[0]) < n:
        factors = np.full(max(n, 1 << 15), np.uint64(of), np.uint64)
        factors[0] = 1
        held[0] = np.cumprod(factors, dtype=np.uint64)
    return held[0][:n]


def _sliding(values: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """`of` (minimum or maximum) over every `n` values in a row."""
    held, width = values, 1
    while width < n:
        step = min(width, n - width)
        held = of(held[:-step], held[step:])
        width += step
    return held


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the first ascending, as differences and byte by byte."""
    first = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T for x in (first, *(x.astype(np.int64) for x in columns[1:]))]
    body = np.ascontiguousarray(np.concatenate(planes))
    return len(body).to_bytes(2, "little") + body.shape[1].to_bytes(4, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(body: bytes) -> list[np.ndarray]:
    width, n = int.from_bytes(body[:2], "little"), int.from_bytes(body[2:6], "little")
    planes = np.frombuffer(pa.decompress(body[6:], width * n, codec="zstd"), np.uint8).reshape(width // 8, 8, n)
    first, *others = (np.ascontiguousarray(x.T).view(np.int64).reshape(n) for x in planes)
    return [np.cumsum(first.view(np.uint64), dtype=np.uint64), *others]


def _all(bodies: list[bytes], width: int) -> list[np.ndarray]:
    """Columns of several packs, one after the other."""
    parts = [_unpack(x) for x in bodies] or [[np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * (width - 1)]
    return [np.concatenate(x) for x in zip(*parts)]


def _dealt(lots: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packs for each lot of an ascending first column of hashes."""
    lot = ((columns[0] >> np.uint64(32)) * np.uint64(lots)) >> np.uint64(32)
    edges = np.searchsorted(lot, np.arange(lots + 1, dtype=np.uint64))
    for i in np.flatnonzero(np.diff(edges)):
        yield int(i), _pack(*(x[edges[i] : edges[i + 1]] for x in columns))


def _answers(chunk: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packs for each chunk, with the first column ascending."""
    order = np.lexsort((columns[0], chunk))
    chunk, columns = chunk[order], [x[order] for x in columns]
    edges = [*np.flatnonzero(_new(chunk)), len(chunk)]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(chunk[a]), _pack(*(x[a:b] for x in columns))


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.table({name: pa.array(list(x), kind) for (name, kind), x in zip(kinds.items(), columns)})


_LOT = {"lot": pa.int32(), "chunk": pa.int64(), "kind": pa.string(), "body": pa.binary()}
_ANSWER = {"chunk": pa.int64(), "kind": pa.string(), "body": pa.binary()}


def _sent(chunk: _Chunk, lots: int, size: int, shingle: int, near_words: int, bands: int, rows: int) -> pa.Table:
    out = [(lot, chunk.chunk, "units", body) for lot, body in _dealt(lots, *chunk.least_units())]
    hashes, keys, ats, places = chunk.least_prints(*chunk.prints(size))
    out += [(lot, chunk.chunk, "prints", body) for lot, body in _dealt(lots, hashes, keys, ats - chunk.chunk, places)]
    names, first, last = chunk.classes(near_words)
    if len(names):
        signed, sizes = chunk.signed(first, last, shingle, bands * rows)
        keys = bands_of(signed, bands).view(np.uint64).reshape(-1)
        order = np.argsort(keys)
        place, keys = order // bands, keys[order]
        # One byte tells classes apart that share a band: of links that share one band only, one in 256 is lost.
        check = ((names[place] + keys) * np.uint64(_STEP)) >> np.uint64(56)
        n = sizes[place]
        out += [(lot, chunk.chunk, "bands", body) for lot, body in _dealt(lots, keys >> np.uint64(24) << np.uint64(24), place, n, check)]
    return _table(out, **_LOT)


def _entries(table: pa.Table, kind: str | None, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the packs of a kind, the chunk of each entry and the columns."""
    if kind:
        table = table.filter(pc.equal(table["kind"], kind))
    parts = [_unpack(x) for x in table["body"].to_pylist()]
    if not parts:
        return np.zeros(0, np.int64), _all([], width)
    return np.repeat(table["chunk"].to_numpy(), [len(x[0]) for x in parts]), [np.concatenate(x) for x in zip(*parts)]


def _several(chunk: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The entries whose hash stands more than once."""
    order = np.argsort(columns[0])
    hashes = columns[0][order]
    same = hashes[1:] == hashes[:-1]
    some = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    return chunk[some], [x[some] for x in columns]


def _met(table: pa.Table, percent: int) -> pa.Table:
    """What a chunk's paragraphs, windows and bands share with other chunks."""
    chunk, (hashes, keys) = _several(*_entries(table, "units", 2))
    order = np.lexsort((keys, hashes))
    new = _new(hashes[order])
    least = keys[order][new][np.cumsum(new) - 1]
    some = keys[order] > least
    out = [(at, "units", body) for at, body in _answers(chunk[order][some], hashes[order][some], least[some])]

    chunk, (hashes, keys, ats, places) = _several(*_entries(table, "prints", 4))
    ats = ats + chunk
    order = np.lexsort((places, ats, keys, hashes))
    new = _new(hashes[order])
    least = order[new][np.cumsum(new) - 1]
    out += [(at, "prints", body) for at, body in _answers(chunk[order], hashes[order], keys[least], ats[least], places[least])]

    chunk, (band, place, n, check) = _several(*_entries(table, "bands", 4))
    order = np.lexsort((chunk, check, n, band))
    chunk, band, place, n, check = (x[order] for x in (chunk, band, place, n, check))
    new = _new(band, n, check)
    group = np.cumsum(new) - 1
    band_of, n_of = band[new], n[new]
    # Classes of a band ascend by size: if any other has a size that allows a link, a neighbour has.
    close = (band_of[1:] == band_of[:-1]) & (100 * n_of[:-1] >= percent * n_of[1:])
    open_ = np.concatenate([[False], close]) | np.concatenate([close, [False]]) if len(n_of) else np.zeros(0, bool)
    some = open_[group]
    # The first chunk that holds a class brings its text.
    out += [(at, "bands", body) for at, body in _answers(chunk[some], place[some], band[some].view(np.int64), new[some])]
    return _table(out, **_ANSWER)


def _bodies(said: pa.Table, kind: str) -> list[bytes]:
    return said.filter(pc.equal(said["kind"], kind))["body"].to_pylist()


def _lookup(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `hashes` in an ascending table, and whether they are there."""
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.argsort(columns[0], kind="stable")
    return [x[order] for x in columns]


def _shared(chunk: _Chunk, bodies: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Hashes and first words of the windows that a document with a smaller key holds, ascending by place, and row and place there."""
    hashes, at = chunk.prints(size)
    known, keys, rows, places = chunk.least_prints(hashes, at)
    others, *better = _sorted(_all(bodies, 4))
    to, there = _lookup(known, others)
    for mine, other in zip((keys, rows, places), better):
        mine[to[there]] = other[there]
    to, _ = _lookup(known, hashes)
    some = chunk.key[chunk.text[at]] > keys[to] if len(at) else np.zeros(0, bool)
    return hashes[some], at[some], rows[to[some]], places[to[some]]


def _marked(chunk: _Chunk, said: pa.Table, lots: int, size: int, shingle: int, near_words: int, bands: int, rows: int) -> pa.Table:
    """The answers for later, the ends of rows of shared windows, and the longer paragraphs that may be linked."""
    none = (None,) * 6
    out = [(0, chunk.chunk, "units", None, *none)]
    out += [(0, chunk.chunk, kind, x, *none) for kind in ("units", "prints") for x in _bodies(said, kind)]
    hashes, at, _, _ = _shared(chunk, _bodies(said, "prints"), size)
    apart = np.concatenate([[True], (np.diff(at) > size) | (np.diff(chunk.text[at]) != 0), [True]])
    ends = np.unique(hashes[apart[:-1] | apart[1:]] if len(at) else hashes)
    held = np.union1d(ends, _all(_bodies(said, "prints"), 4)[0])
    out += [(lot, chunk.chunk, "ends", body, *none) for lot, body in _dealt(lots, held, np.isin(held, ends))]

    place, band, brings = _sorted(_all(_bodies(said, "bands"), 3))
    if len(place):
        names, first, last = chunk.classes(near_words)
        edges = np.flatnonzero(_new(place))
        some = place[edges].astype(np.int64)
        units, keys = chunk.least_units()
        to, there = _lookup(units, names[some])
        brings = np.logical_or.reduceat(brings.astype(bool), edges)
        signed, sizes = chunk.signed(first[some[brings]], last[some[brings]], shingle, bands * rows)
        low, counts = iter(low_bytes(signed).to_pylist()), iter(sizes.tolist())
        for i, a, b, name, key, own in zip(some, edges, [*edges[1:], len(place)], names[some].view(np.int64).tolist(), [int(keys[x]) if y else None for x, y in zip(to, there)], brings):
            about = (next(counts), band[a:b].tolist(), next(low), chunk.data[chunk.starts[first[i]] : chunk.ends[last[i] - 1]].tobytes().decode("utf-8", "replace")) if own else none[2:]
            out.append((0, chunk.chunk, "class", None, name, key, *about))
    return _table(out, **_LOT, **{"class": pa.int64()}, key=pa.int64(), n=pa.int64(), bands=pa.list_(pa.int64()), low=pa.binary(), text=pa.string())


def _asked(table: pa.Table) -> pa.Table:
    """Windows that end a row anywhere, for every chunk that holds them."""
    chunk, (hashes, ends) = _entries(table, None, 2)
    some = np.isin(hashes, hashes[ends != 0])
    return _table(list(_answers(chunk[some], hashes[some])), chunk=pa.int64(), body=pa.binary())


def _sides(chunk: _Chunk, bodies: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Asked windows and what follows and precedes them, up to `size` - 1 words.

    Per window and side with any such word: the window's first word, the side (1, -1), how many words, and the place of its
    content among the distinct ones; per distinct content: a window and side that has it with the least key.
    """
    hashes, at = chunk.prints(size)
    at = at[np.isin(hashes, _all(bodies, 1)[0])]
    text = chunk.text[at]
    after = np.minimum(size - 1, chunk.first[text + 1] - at - size)
    before = np.minimum(size - 1, at - chunk.first[text])
    at, side, words = np.concatenate([at, at]), np.repeat([1, -1], len(at)), np.concatenate([after, before])
    at, side, words = (x[words > 0] for x in (at, side, words))
    content = _stretched(chunk, at, side, words, size)
    order = np.lexsort((chunk.key[chunk.text[at]], content))
    new = _new(content[order])
    place = np.empty(len(at), np.int64)
    place[order] = np.cumsum(new) - 1
    return at, side, words, place, order[new]


def _stretched(chunk: _Chunk, at: np.ndarray, side: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows with more words. Sides are apart: a window extended before it never meets one extended after it."""
    hashes = chunk.hashes(at - np.where(side < 0, words, 0), at + size + np.where(side > 0, words, 0))
    return np.where(side > 0, hashes, ~hashes)


def _sides_sent(chunk: _Chunk, said: pa.Table, lots: int, size: int) -> pa.Table:
    at, side, words, _, some = _sides(chunk, said["body"].to_pylist(), size) if len(said) else _sides(chunk, [], size)
    at, side, words = at[some], side[some], words[some]
    hashes = _stretched(chunk, at, side, np.ones_like(at), size)
    # Entries meet if they go on with the same word, and are told apart there by 32 bits for every word more.
    further = [_stretched(chunk, at, side, np.minimum(words, k), size) & np.uint64(0xFFFFFFFF) for k in range(2, size)]
    pairs = [a | (b << np.uint64(32)) for a, b in zip(further[::2], [*further[1::2], *[np.zeros(len(at), np.uint64)] * (len(further) % 2)])]
    order = np.argsort(hashes, kind="stable")
    columns = [x[order] for x in (hashes, np.arange(len(order)), chunk.key[chunk.text[at]], words, *(x.view(np.int64) for x in pairs))]
    return _table([(lot, chunk.chunk, body) for lot, body in _dealt(lots, *columns)], lot=pa.int32(), chunk=pa.int64(), body=pa.binary())


def _reached(table: pa.Table, size: int) -> pa.Table:
    """How many words further an entry with a smaller key goes on equally."""
    chunk, (hashes, place, keys, words, *pairs) = _entries(table, None, 4 + (size - 1) // 2)
    reach = np.zeros(len(hashes), np.int64)
    _, group, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(counts[group] > 1)
    for k in range(1, size):
        if k > 1:
            rest = rest[words[rest] >= k]
            bits = pairs[(k - 2) // 2].view(np.uint64)[rest] >> np.uint64(32 * (k % 2)) & np.uint64(0xFFFFFFFF)
        else:
            bits = np.zeros(len(rest), np.uint64)
        order = np.lexsort((keys[rest], bits, group[rest]))
        rest, bits = rest[order], bits[order]
        new = _new(group[rest], bits)
        least = keys[rest][new][np.cumsum(new) - 1]
        reach[rest[keys[rest] > least]] = k
    some = reach > 0
    return _table(list(_answers(chunk[some], place[some], reach[some])), chunk=pa.int64(), body=pa.binary())


def _runs(chunk: _Chunk, said: pa.Table, size: int, min_words: int, percent: int) -> pa.Table:
    said = said.to_pylist()[0] if len(said) else {}
    known = {kind: [x["body"] for x in said.get("known") or [] if x["kind"] == kind and x["body"]] for kind in ("units", "prints")}
    held = np.zeros(chunk.n + 1, bool)
    _, at, rows, places = _shared(chunk, known["prints"], size)
    reach = _reach(chunk, said, size)
    text = chunk.text[at]
    edges = [*np.flatnonzero(_new(text)), len(at)]
    for a, b in zip(edges[:-1], edges[1:]):
        base = int(chunk.first[text[a]])
        for i, j in _joined([*zip(at[a:b].tolist(), rows[a:b].tolist(), places[a:b].tolist())], reach, size, percent):
            held[max(i, base) : j] = True

    n, first, last = chunk.units
    if len(first):
        units, least = chunk.least_units()
        near = [np.array([x[c] for x in said.get("near") or []], np.int64) for c in ("class", "least")]
        for others, better in (_all(known["units"], 2), near):
            to, there = _lookup(units, others.view(np.uint64))
            np.minimum.at(least, to[there], better[there])
        to, there = _lookup(units, chunk.hashes(first, last))
        owner = chunk.text[first]
        hit = np.zeros(len(first), bool)
        hit[there] = chunk.key[owner[there]] > least[to[there]]
        hit &= chunk.named[owner]
        held[: chunk.n] |= np.repeat(hit[:n], last[:n] - first[:n])
        # A line like another may still begin or end with sentences of its own: those without any repeated word stay.
        words = np.flatnonzero(held)
        for i in n + np.flatnonzero(hit[n:]):
            a, b = np.searchsorted(words, [first[i], last[i]])
            if a < b:
                sentences = np.searchsorted(last[:n], words[[a, b - 1]], "right")
                held[first[sentences[0]] : last[sentences[1]]] = True

    held = held[: chunk.n]
    new = _new(chunk.text)
    starts = np.flatnonzero(held & (new | ~np.concatenate([[False], held[:-1]]))) if chunk.n else np.zeros(0, np.int64)
    ends = np.flatnonzero(held & (np.concatenate([new[1:], [True]]) | ~np.concatenate([held[1:], [False]]))) if chunk.n else starts
    some = ends - starts + 1 >= min_words
    starts, ends = starts[some], ends[some]
    inner = np.flatnonzero((chunk.data & 0xC0) == 0x80)
    owner = chunk.text[starts]
    spans: list[list[dict]] = [[] for _ in chunk.at]
    total = np.zeros(len(chunk.at), np.int64)
    np.add.at(total, owner, ends - starts + 1)
    starts, ends, base = (x - np.searchsorted(inner, x) for x in (chunk.starts[starts], chunk.ends[ends], chunk.base[owner]))
    for i, a, b in zip(owner.tolist(), (starts - base).tolist(), (ends - base).tolist()):
        spans[i].append({"start": a, "end": b})
    keys = pa.array(chunk.key, pa.int64(), mask=~chunk.named)
    return pa.table({"key": keys, "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "n_words": pa.array(total)})


def _reach(chunk: _Chunk, said: dict, size: int) -> dict[int, list[int]]:
    """Of windows by first word: how many words before and after them a document with a smaller key holds too."""
    at, side, words, place, some = _sides(chunk, said.get("asked") or [], size)
    if not len(at):
        return {}
    keys = chunk.key[chunk.text[at]]
    others = np.zeros(len(some), np.int64)
    to, far = _all(said.get("reach") or [], 2)
    others[to.astype(np.int64)] = far
    far = np.where(keys > keys[some][place], words, others[place])
    out: dict[int, list[int]] = {}
    for i, s, n in zip(at.tolist(), side.tolist(), far.tolist()):
        if n:
            out.setdefault(i, [0, 0])[s > 0] = n
    return out


def _joined(prints: list[tuple[int, int, int]], reach: dict[int, list[int]], size: int, percent: int) -> list[list[int]]:
    """First word and the one after the last of extended rows of windows (first word, row and place where they first stand), joined where the words between them are an edit."""
    rows: list[list] = []
    for x in prints:
        left, right = reach.get(x[0], (0, 0))
        a, b = x[0] - left, x[0] + size + right
        if rows and a <= rows[-1][1]:
            rows[-1][1] = max(rows[-1][1], b)
            rows[-1][3] = x
        else:
            rows.append([a, b, x, x])
    out: list[list[int]] = []
    edits, last = 0, None
    for a, b, first, end in rows:
        if out and first[1] == last[1] and first[2] > last[2]:
            gap = a - out[-1][1]
            other = gap + (first[2] - last[2]) - (first[0] - last[0])
            cost = edits + max(gap, other)
            if other >= 0 and 100 * cost <= (100 - percent) * (b - out[-1][0]):
                out[-1][1], edits, last = b, cost, end
                continue
        out.append([a, b])
        edits, last = 0, end
    return out


def without_passages(docs: DataFrame, found: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` (keys unique) with the spans of `found` taken out of `text`; all rows and columns stay."""
    spans = found.where(F.size("spans") > 0).select(F.col(key).alias("__key"), F.col("spans").alias("__spans"))
    content = F.col(text).cast("string")
    joined = docs.join(spans, F.col(key) == F.col("__key"), "left")
    ends = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda x: x["end"]))
    parts = F.zip_with("__spans", F.slice(ends, 1, F.size("__spans")), lambda s, done: F.substr(content, done + 1, s["start"] - done))
    cleaned = F.concat(F.array_join(parts, ""), F.substr(content, F.element_at(ends, -1) + 1, F.length(content)))
    return joined.select(*[F.when(F.col("__spans").isNull(), F.col(c)).otherwise(cleaned).alias(c) if c == text else F.col(c) for c in docs.columns])


def digest(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, n_spans, n_words and spans written start:end, comma-joined."""
    written = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select(key, F.size("spans").cast("long").alias("n_spans"), "n_words", written.alias("spans"))
