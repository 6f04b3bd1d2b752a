"""Benchmark decontamination: a hash set of normalised benchmark n-grams against every window of every document.

Words are runs of digits, ASCII letters and all other characters beyond ASCII; A-Z count as lower case. A window is `n`
consecutive words of a benchmark item, or a shorter item as a whole. Windows are hashed with numpy over a whole batch of
texts; positions whose hash is in the set are compared with the window's words, so a hash collision hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcurate.llm.common import apart, small
from linkcurate.llm.hashing import hashed_words, window_hashes

#: Words of this operator: digits, ASCII letters and everything beyond ASCII.
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_PART = 2 << 20


def words_of(text: str | None) -> list[bytes]:
    data, starts, ends, _, _ = hashed_words([(text or "").encode("utf-8", "surrogatepass")], _WORD)
    return [data[a:b].tobytes() for a, b in zip(starts, ends)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class WindowSet:
    """The windows of some benchmark items: per window length the hashes in ascending order, and item and first word of each window."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: list[int | None]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(items: list[tuple[int | None, str | None]], n: int) -> WindowSet:
        data, starts, ends, hashes, first = hashed_words([(text or "").encode("utf-8", "surrogatepass") for _, text in items], _WORD)
        counts = np.diff(first)
        windows = {}
        for size in {min(n, int(x)) for x in counts if x}:
            mine = np.flatnonzero(counts >= n if size == n else counts == size)
            each = counts[mine] - size + 1
            at = np.repeat(first[mine] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            keys, item = window_hashes(hashes, size)[at], np.repeat(mine, each)
            order = np.lexsort((item, keys))
            windows[size] = keys[order], item[order].astype(np.int32), at[order]
        return WindowSet(data, starts, ends, [i for i, _ in items], windows)

    def _candidates(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """Place, length and first entry of the set for every window of the text whose hash is in it."""
        out = []
        for n, (known, _, _) in self.windows.items():
            windows = window_hashes(hashes, n)
            at = np.searchsorted(known, windows)
            at[at == len(known)] = 0
            some = np.flatnonzero(known[at] == windows)
            out += zip(some.tolist(), [n] * len(some), at[some].tolist())
        return out

    def _same(self, data, starts, ends, i: int, at: int, n: int) -> bool:
        """Whether the n words from place i on are the set's from place `at` on."""
        return all(
            data[starts[i + j] : ends[i + j]].tobytes() == self.data[self.starts[at + j] : self.ends[at + j]].tobytes() for j in range(n)
        )

    def _verified(self, data, starts, ends, candidates) -> tuple[list[tuple[int, int]], set[int]]:
        ranges, items = [], set()
        for i, n, k in candidates:
            known, item, first = self.windows[n]
            for k in range(k, int(np.searchsorted(known, known[k], "right"))):
                if self._same(data, starts, ends, i, int(first[k]), n):
                    ranges.append((i, i + n))
                    items.add(self.ids[item[k]])
        return merged(ranges), items - {None}

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """Per text its number of words, hit ranges of words (end exclusive, ascending) and items. Hashed in parts of about 2 MB."""
        out: list[tuple[int, list[tuple[int, int]], set[int]]] = []
        part: list[bytes] = []
        size = 0
        for text in texts:
            part.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(part[-1])
            if size > _PART:
                out += self._scan(part)
                part, size = [], 0
        return out + list(self._scan(part) if part else [])

    def _scan(self, part: list[bytes]):
        data, starts, ends, hashes, first = hashed_words(part, _WORD)
        mine: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, n, key in self._candidates(hashes):
            k = int(np.searchsorted(first, i, "right")) - 1
            if i + n <= first[k + 1]:  # the window lies in one text
                mine[k].append((i, n, key))
        for k in range(len(part)):
            ranges, items = self._verified(data, starts, ends, mine[k]) if k in mine else ([], set())
            yield int(first[k + 1] - first[k]), [(a - int(first[k]), b - int(first[k])) for a, b in ranges], items


_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scanned(docs: DataFrame, benchmark: DataFrame, *, n: int, text: str, item: str, item_text: str, broadcast_bytes: int) -> DataFrame:
    """`docs` with `__words`, `__ranges` (hit ranges of words, end exclusive) and `__items` (ascending); no shuffle.

    The set takes some five times the bytes of its texts; it is broadcast only if these take at most `broadcast_bytes`. A larger benchmark is dealt into lots of
    about that size; the rows pass through one scan per lot, each adding what it finds.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
    lots = max(1, -(-size // broadcast_bytes))
    lot = F.pmod(F.xxhash64("item", "text"), F.lit(lots))
    rows = docs.withColumns({
        "__words": F.lit(0).cast("long"), "__ranges": F.expr("cast(array() as array<struct<start:int,end:int>>)"), "__items": F.expr("cast(array() as array<bigint>)"),
    })
    for i in range(lots):
        rows = _scan_lot(rows, text, items if lots == 1 else items.where(lot == i), n)
    return rows


def _scan_lot(rows: DataFrame, text: str, items: DataFrame, n: int) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast(WindowSet.of([tuple(r) for r in items.toLocalIterator()], n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = known.value.scan(batch.column(text).to_pylist())
            ranges, hit_items = [x[1] for x in found], [x[2] for x in found]
            for i, (old, older) in enumerate(zip(batch.column("__ranges").to_pylist(), batch.column("__items").to_pylist())):
                if old:
                    ranges[i] = merged(ranges[i] + [(x["start"], x["end"]) for x in old])
                    hit_items[i] |= set(older)
            new = {
                "__words": pa.array([x[0] for x in found], pa.int64()),
                "__ranges": pa.array([[{"start": a, "end": b} for a, b in x] for x in ranges], _RANGES),
                "__items": pa.array([sorted(x) for x in hit_items], pa.list_(pa.int64())),
            }
            names = batch.schema.names
            yield pa.record_batch([new[x] if x in new else batch.column(x) for x in names], names)

    return rows.mapInArrow(run, rows.schema)


def scan(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 13, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, ranges (hit words, end exclusive, ascending) and items (ascending).

    Null texts have no words; items without words hit nothing, items without id hit but are not listed; null and repeated keys keep
    a row each; other columns play no part.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = scanned(rows, benchmark, n=n, text="text", item=item, item_text=item_text, broadcast_bytes=broadcast_bytes)
    return found.select("doc_id", F.col("__words").alias("n_words"), F.col("__ranges").alias("ranges"), F.col("__items").alias("items"))


def digest(scanned: DataFrame, *, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (some word hit, and at least one word in `share`)."""
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, x: total + (x["end"] - x["start"]))
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return scanned.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, share: int = 20, text: str = "text", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """`docs` without contaminated rows, all columns kept, whatever their names. Rows of null or empty texts stay, repeated rows each."""
    rows, name, back = apart(docs)
    found = scanned(rows, benchmark, n=n, text=name[text], item="item_id", item_text="text", broadcast_bytes=broadcast_bytes)
    hit = F.aggregate("__ranges", F.lit(0).cast("long"), lambda total, x: total + (x["end"] - x["start"]))
    return found.where(~((hit > 0) & (hit * share >= F.col("__words")))).select(*back)


SQL_TWIN = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM b),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dwin JOIN bwin USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS named FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
