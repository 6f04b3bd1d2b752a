"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit numbers serve for the whole signature: the first spreads the shingles, the second, circularly
shifted by k, gives coordinate k as the least value over a document's shingles. Coordinates are banded; documents that
share a band are candidates, and links are confirmed by exact Jaccard similarity of the full shingle sets.

Documents with equal sets form a class, and only its first row goes on, so groups of copies cost one aggregation. Links are
sought in rounds that each make a row or two per document and band, never the pairs of a band: members are compared with the
band's first and last member, then, where a band still holds several components, every member outside the largest one with
the member of another component whose signature is likest. What is left, mostly documents that are linked with nothing, meets
in blocks with its shingles: rows that share too few of them with all others are put aside, and pairs that sizes and
signatures (5 standard deviations below a link's mean) leave open are compared in place; only one link of two components goes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcurate.llm.common import small, stored
from linkcurate.llm.components import stars
from linkcurate.llm.hashing import shingle_sets

_LANES = 1 << 15


def _first(values: np.ndarray) -> np.ndarray:
    """The first permutation, of the numbers below 2**64; its upper half is used."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (values >> np.uint64(32)).astype(np.uint32)


def _second(values: np.ndarray, spare: np.ndarray) -> None:
    """The second permutation, of the numbers below 2**32, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(values, np.uint32(shift), out=spare)
        np.bitwise_xor(values, spare, out=values)
        if factor:
            np.multiply(values, np.uint32(factor), out=values)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of `size` coordinates per set; an empty set has the largest number everywhere."""
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    rows = [i for i, x in enumerate(sets) if len(x)]
    while rows:
        group, held = [], 0
        while rows and (not group or held + len(sets[rows[0]]) <= _LANES):
            held += len(sets[rows[0]])
            group.append(rows.pop(0))
        values = _first(np.concatenate([sets[i] for i in group]))
        edges = np.cumsum([0] + [len(sets[i]) for i in group[:-1]])
        shifted, spare = np.empty_like(values), np.empty_like(values)
        for k in range(size):
            np.add(values, np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF), out=shifted)
            _second(shifted, spare)
            out[group, k] = np.minimum.reduceat(shifted, edges)
    return out


def bands_of(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, different bands apart."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i]
    return ((key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = 32, rows: int = 6, numbered: bool = False
) -> DataFrame:
    """Per row of `docs`: key, n_shingles, component_id (smallest key reachable), kept (key = component_id).

    Sets: distinct shingles of `words` words between ASCII white space, A-Z as a-z; fewer words are one shingle; null, empty and
    blank texts have none and link with nothing. Link: 100 * intersection >= percent * union. With 32 bands of 6 rows a pair at
    80 % is missed with probability 6e-5. Rows with a null key get the smallest key of their component, are never kept, and are
    alone without one; a key that repeats keeps a row each. Other columns play no part.

    `docs` is written once, with a number for each row; with `numbered` it is a stored table already, and `key` numbers its rows.
    """
    if numbered:
        held = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("at"))
    else:
        held = stored(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("at")), "texts")
    signed = stored(held.mapInArrow(lambda b: _signed(b, words, bands, rows), "key long, at long, n long, class binary, bands array<long>, low binary"), "signatures")
    classes = signed.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("at", "n", "bands", "low")).alias("x"))
    classes = stored(classes.select("class", "x.at", "x.n", "x.bands", "x.low"), "sets")
    links = links_of(classes.select("at", "n", "bands", "low"), held.select("at", "text"), words, percent)
    found = stars(links)
    of_class = classes.select("class", "at").join(found.withColumnRenamed("node", "at"), "at", "left")
    of_class = of_class.select("class", F.coalesce("component", "at").alias("component"))
    # Smallest key per component: first per class (copies meet in a combining aggregation), then per component.
    keys = signed.where("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("key"))
    joined = stored(of_class.join(keys, "class"), "classes")
    least = joined.groupBy("component").agg(F.min("key").alias("component_id"))
    least = joined.join(least, "component").select("class", "component_id")
    out = signed.select("key", "n", "class").join(least, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))
    )


def _signed(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        signed = signatures(sets, bands * rows)
        keys = bands_of(signed, bands)
        names = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
        yield pa.record_batch(
            [batch.column("key"), batch.column("at"), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.binary()),
             pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))), low_bytes(signed)],
            ["key", "at", "n", "class", "bands", "low"],
        )


def low_bytes(signed: np.ndarray) -> pa.Array:
    """The lowest byte of every coordinate, a string of bytes per row."""
    low = np.ascontiguousarray(signed.astype(np.uint8))
    offsets = np.arange(len(low) + 1, dtype=np.int32) * low.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low.tobytes())])


def links_of(classes: DataFrame, texts: DataFrame, words: int, percent: int, rounds: int = 1, settled: int = 1) -> DataFrame:
    """Pairs (a, b) that connect what the confirmed links of all candidate pairs connect: of each row found linked, the smallest linked with it, and the last links.

    `classes` has at (unique), n (size of the set), bands and low (lowest bytes of the signature). Bands of up to `settled` members
    are done once all are compared with the first and the last; with 3 or fewer, these are all pairs.
    """
    members = classes.select("at", "n", F.explode("bands").alias("band"))
    one = F.struct("at", "n")
    shared = members.groupBy("band").agg(F.count("*").alias("k"), F.min(one).alias("low"), F.max(one).alias("high")).where("k > 1")
    shared = stored(shared.select("band", "k", F.array("low", "high").alias("ends")), "bands")
    members = stored(_in_bands(members, shared), "members")
    pairs = stored(_star(members, percent), "pairs")
    group = stars(_confirmed(pairs, texts, words, percent))
    tried, mixed = pairs, _mixed(members.select("band", "at", "n"), group, settled)
    for _ in range(rounds):
        met = _met(mixed, classes.select("at", "low"))
        best = met.mapInArrow(lambda batches: _best_partners(batches, percent), "a long, b long, alike int")
        best = best.groupBy("a").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b"))
        some = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        some = stored(some, "pairs")
        tried = tried.union(some)
        group = stars(group.union(_confirmed(some, texts, words, percent)), "node", "component")
        mixed = _mixed(mixed.select("band", "at", "n"), group, settled)
    # What is left meets in full.
    met = _met(mixed, classes.select("at", "low").join(_open_sets(mixed.select("at").distinct(), texts, words, percent), "at"))
    rest = met.mapInArrow(lambda batches: _possible(batches, percent), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    rest = stored(rest, "pairs")
    return group.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_confirmed(rest, texts, words, percent))


def _in_bands(members: DataFrame, shared: DataFrame, rows: int = 500, share: int = 200) -> DataFrame:
    """Members of the bands in `shared` with the band's ends. A band with 1/`share` of all members or more is dealt over lots.

    Such bands number at most `share`, so that their list can be broadcast.
    """
    total, most = shared.agg(F.sum("k"), F.max("k")).first()
    if not total or most <= rows or most * share < total:
        return members.join(shared.select("band", "ends"), "band").select("at", "n", "band", "ends")
    hot = F.broadcast(shared.where(F.expr(f"k > {rows} AND k * {share}L >= {total}L")).select("band", F.expr(f"k div {rows} + 1").alias("lots")))
    dealt = members.join(hot, "band", "left").withColumn("lot", F.coalesce(F.expr("pmod(xxhash64(at), lots)"), F.lit(0))).drop("lots")
    ends = shared.join(hot, "band", "left").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("lots") - 1, F.lit(0)))))
    return dealt.join(ends.select("band", "lot", "ends"), ["band", "lot"]).select("at", "n", "band", "ends")


def _star(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a band's `ends` and its members, as far as their sizes allow a link."""
    pairs = members.select("at", "n", F.explode(F.array_distinct("ends")).alias("end")).where(F.col("at") != F.col("end.at"))
    pairs = pairs.where(100 * F.least("n", F.col("end.n")) >= percent * F.greatest("n", F.col("end.n")))
    return pairs.select(F.least("at", "end.at").alias("a"), F.greatest("at", "end.at").alias("b")).distinct()


def _mixed(members: DataFrame, group: DataFrame, settled: int) -> DataFrame:
    """Members (with their component) of bands of more than `settled` members that hold more than one component."""
    named = members.join(group.withColumnRenamed("node", "at"), "at", "left")
    named = named.select("band", "at", "n", F.coalesce("component", "at").alias("component"))
    bands = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("k")).where(f"x <> y AND k > {settled}")
    bands = stored(bands.select("band", "k", F.lit(0).alias("ends")), "bands")
    return stored(_in_bands(named.withColumn("n", F.struct("n", "component")), bands).select("band", "at", "n.n", "n.component"), "mixed")


def _met(mixed: DataFrame, about: DataFrame, wide: int = 2000, block: int = 400) -> DataFrame:
    """Blocks of a band's members outside its largest component (x) with blocks of all its members (y), sorted by band and block of x."""
    counts = mixed.groupBy("band", "component").count().groupBy("band").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("k"), F.max("count").alias("most"))
    sizes = counts.select("band", "k", F.col("main").alias("ends"), F.expr(f"ceil(k / {block})").alias("ys"), F.expr(f"ceil((k - most) / {wide})").alias("xs"))
    sizes = stored(sizes.select("band", "k", F.struct("ends", "ys", "xs").alias("ends")), "sizes")
    rows = _in_bands(mixed.withColumn("n", F.struct("n", "component")), sizes).select("band", "at", "n.n", "n.component", "ends.*").withColumnRenamed("ends", "main")
    rows = rows.join(about, "at")
    columns = F.struct("at", "n", "component", *[x for x in about.columns if x != "at"])

    def packed(which: DataFrame, blocks: str, name: str) -> DataFrame:
        return which.groupBy("band", "xs", F.expr(f"pmod(xxhash64(at), {blocks})").alias("block")).agg(F.collect_list(columns).alias(name))

    x = packed(rows.where("component <> main"), "xs", "x").drop("xs")
    y = packed(rows, "ys", "y").withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("xs") - 1)))
    return x.join(y.drop("xs").hint("merge"), ["band", "block"]).sortWithinPartitions("band", "block").select("band", "block", "x", "y")


class _Block:
    def __init__(self, rows: pa.StructArray) -> None:
        self.at, self.n, self.group = (rows.field(c).to_numpy() for c in ("at", "n", "component"))
        self.low = np.frombuffer(b"".join(rows.field("low").to_pylist()), np.uint8).reshape(len(rows), -1)
        self.rows = rows

    def tokens(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the given rows, and the place of each one's row among them."""
        column = self.rows.field("tokens")
        each = [np.frombuffer(column[int(i)].as_py(), np.uint32) for i in some]
        return np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])


def _overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], part: int = 2048) -> np.ndarray:
    """Common shingles of every row of x with every row of y."""
    both, out = np.intersect1d(x[0], y[0]), np.zeros(shape, np.float32)
    for i in range(0, len(both), part):
        token, sides = both[i : i + part], []
        for (values, owner), n in zip((x, y), shape):
            there = np.zeros((n, len(token)), np.float32)
            at = np.minimum(np.searchsorted(token, values), len(token) - 1)
            hit = token[at] == values
            there[owner[hit], at[hit]] = 1
            sides.append(there)
        out += sides[0] @ sides[1].T
    return out


def _alike(x: _Block, y: _Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many coordinates agree, and where a link of different components is possible by sizes and signatures."""
    size, share = x.low.shape[1], percent / 100
    agree = np.zeros((len(x.at), len(y.at)), np.int16)
    for i in range(0, len(x.at), 32):
        agree[i : i + 32] = (x.low[i : i + 32, None, :] == y.low[None, :, :]).sum(axis=2)
    open_ = (agree >= size * share - 5 * np.sqrt(size * share * (1 - share))) & (x.group[:, None] != y.group[None, :])
    open_ &= 100 * np.minimum(x.n[:, None], y.n[None, :]) >= percent * np.maximum(x.n[:, None], y.n[None, :])
    return agree, open_


def _best_partners(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """One row (a, b, alike) at most per member of x and band: the member of another component with the likest signature."""
    key, x, best, partner = None, None, None, None

    def found() -> pa.RecordBatch:
        some = best > 0
        return pa.record_batch([pa.array(x.at[some]), pa.array(partner[some]), pa.array(best[some].astype(np.int32))], ["a", "b", "alike"])

    for batch in small(batches, 100):
        for i in range(len(batch)):
            now = batch.column("band")[i].as_py(), batch.column("block")[i].as_py()
            if now != key:
                if key is not None:
                    yield found()
                key, x = now, _Block(batch.column("x")[i].values)
                best, partner = np.zeros(len(x.at), np.int16), np.zeros(len(x.at), np.int64)
            y = _Block(batch.column("y")[i].values)
            agree, open_ = _alike(x, y, percent)
            agree = np.where(open_, agree, 0)
            top = agree.max(axis=1)
            other = np.where((agree == top[:, None]) & open_, y.at[None, :], np.iinfo(np.int64).max).min(axis=1)
            better = (top > best) | ((top == best) & (top > 0) & (other < partner))
            best, partner = np.where(better, top, best), np.where(better, other, partner)
    if key is not None:
        yield found()


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For every two components in two blocks that are linked there, the likest pair (a, b) of their members, by whole sets."""
    for batch in small(batches, 100):
        pairs = [np.zeros((0, 2), np.int64)]
        for i in range(len(batch)):
            x, y = _Block(batch.column("x")[i].values), _Block(batch.column("y")[i].values)
            _, open_ = _alike(x, y, percent)
            rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(rows):
                continue
            both = _overlap(x.tokens(rows), y.tokens(columns), (len(rows), len(columns)))
            union = x.n[rows, None] + y.n[None, columns] - both
            a, b = np.nonzero(open_[np.ix_(rows, columns)] & (100 * both >= percent * union))
            order = np.argsort(-(both / union)[a, b], kind="stable")
            a, b = rows[a[order]], columns[b[order]]
            _, first = np.unique(np.stack([x.group[a], y.group[b]]), axis=1, return_index=True)
            a, b = x.at[a[first]], y.at[b[first]]
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


_BUCKETS = 1 << 20


def _open_sets(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """at and tokens (lower halves of the hashes of its shingles) of the given rows that may still be linked.

    A row is not linked with another if it shares fewer than `percent` of its shingles with all others. Shingles are counted in
    `_BUCKETS` buckets; those alone in their bucket are shared by no other row.
    """
    asked = stored(texts.join(rows, "at").select("at", "text"), "open")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for batch in small(batches):
            for x in shingle_sets(batch.column("text").to_pylist(), words):
                np.add.at(total, (x >> np.uint64(44)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = asked.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    shared = np.zeros(_BUCKETS, bool)
    shared[counted.where("n > 1").select("bucket").toArrow()["bucket"].to_numpy()] = True

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            open_ = [100 * np.count_nonzero(shared[(x >> np.uint64(44)).astype(np.int64)]) >= percent * len(x) for x in sets]
            tokens = [x.astype(np.uint32).tobytes() for x in sets]
            yield pa.record_batch([batch.column("at"), pa.array(tokens, pa.binary())], ["at", "tokens"]).filter(pa.array(open_, pa.bool_()))

    return stored(asked.mapInArrow(keep, "at long, tokens binary"), "open")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    right = texts.select(F.col("at").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("at").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(lambda batches: _compared(batches, words, percent), "a long, b long")


def _compared(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    last, kept = None, None
    for batch in small(batches, 100):
        a = batch.column("a").to_pylist()
        new = [i for i in range(len(a)) if a[i] != (a[i - 1] if i else last)]
        left = iter(shingle_sets([batch.column("text_a")[i].as_py() for i in new], words))
        right = shingle_sets(batch.column("text_b").to_pylist(), words)
        alike, new = [], set(new)
        for i, other in enumerate(right):
            if i in new:
                kept = next(left)
            both = len(np.intersect1d(kept, other, assume_unique=True))
            alike.append(100 * both >= percent * (len(kept) + len(other) - both))
        last = a[-1] if a else last
        yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(alike, pa.bool_()))
