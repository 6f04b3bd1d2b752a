"""Quality of documents by a factorisation machine.

A document is a sparse vector: hashed words, statistics of its structure (letters, marks, lines, repetition) and metadata (the stated
number of characters against the real one). The machine adds to a linear model an interaction of every pair of features, the inner
product of their two factors; by the identity  sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)
a document is scored in time linear in its features.

Features and scores are computed where the rows are. The machine is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcurate.llm.common import small
from linkcurate.llm.hashing import NOT_BLANK, hashed_words

#: Kinds of bytes: 0 others, 1 A-Z, 2 a-z, 3 digits, 4 blanks, 5 line feed, 6 marks of a sentence, 7 exclamation and question marks,
#: 8 other ASCII marks, 9 first bytes of longer characters, 10 further bytes of a character.
_KIND = np.zeros(256, np.int64)
_KIND[[x for x in range(0x21, 0x7F)]] = 8
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[[0x20, 9, 11, 12, 13]], _KIND[10] = 1, 2, 3, 4, 5
_KIND[[ord(x) for x in ".,;:'-()"]], _KIND[[ord(x) for x in "!?"]] = 6, 7
_KIND[0x80:0xC0], _KIND[0xC0:] = 10, 9
_KINDS, _WINDOW = 11, 1 << 20

STATISTICS = (
    "characters words word_length capitals digits blanks sentence_marks exclamations symbols beyond_ascii words_repeated distinct_words "
    "commonest_word lines_per_word distinct_lines spread_of_words stated_characters stated_apart".split()
)


def _windows(data: bytes) -> Iterator[bytes]:
    """A text in parts of about 1 MB that end before white space where there is any."""
    start = 0
    while len(data) - start > _WINDOW:
        end = max(data.rfind(b" ", start, start + _WINDOW), data.rfind(b"\n", start, start + _WINDOW))
        end = end if end > start else start + _WINDOW
        yield data[start:end]
        start = end
    yield data[start:]


class _Counted:
    """Counts of one document, added window by window."""

    def __init__(self, buckets: int) -> None:
        self.buckets = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.kinds = np.zeros(_KINDS, np.int64)
        self.words = self.repeated = 0
        self.distinct = np.zeros(0, np.uint64)
        self.lines = np.zeros(0, np.uint64)
        self.n_lines, self.last = 0, None
        self.size = buckets

    def add(self, kinds: np.ndarray, words: np.ndarray, lines: np.ndarray) -> None:
        self.kinds += kinds
        if len(words):
            self.repeated += int((words[1:] == words[:-1]).sum()) + int(self.last == words[0])
            self.last = words[-1]
        self.words += len(words)
        self.distinct = np.union1d(self.distinct, words)
        bucket, count = np.unique((words & np.uint64(self.size - 1)).astype(np.int64), return_counts=True)
        if len(self.buckets):
            bucket, where = np.unique(np.concatenate([self.buckets, bucket]), return_inverse=True)
            count = np.bincount(where, np.concatenate([self.counts, count])).astype(np.int64)
        self.buckets, self.counts = bucket, count
        self.lines, self.n_lines = np.union1d(self.lines, lines), self.n_lines + len(lines)

    def statistics(self, stated: int | None) -> list[float]:
        k, words = self.kinds.astype(float), max(1, self.words)
        letters, total = max(1.0, k[1] + k[2]), max(1.0, k.sum())
        characters = k.sum() - k[10]
        share = self.counts / words
        return [
            np.log1p(characters), np.log1p(self.words), np.log1p((characters - k[4] - k[5]) / words), k[1] / letters, k[3] / total, k[4] / total, k[6] / total,
            k[7] / total, k[8] / total, k[9] / total, self.repeated / words, len(self.distinct) / words, share.max(initial=0), np.log1p(k[5]) - np.log1p(self.words),
            len(self.lines) / max(1, self.n_lines), -(share * np.log(share)).sum() / np.log(words + 1), np.log1p(max(0, stated)) if stated is not None else -1,
            abs(np.log1p(max(0, stated)) - np.log1p(characters)) if stated is not None else -1,
        ]


def _line_hashes(words: np.ndarray, starts: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """One number per line that has words, equal for lines of the same words."""
    if not len(words):
        return words
    line = np.searchsorted(breaks, starts)
    edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    place = (np.arange(len(words)) - np.repeat(edge, np.diff(np.append(edge, len(words))))).astype(np.uint64)
    return np.add.reduceat((words ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93), edge)


def counted(texts: list[str | None], buckets: int) -> list[_Counted]:
    """Counts of every text; short texts are read together, long ones in windows."""
    out, group, held = [_Counted(buckets) for _ in texts], [], 0

    def read() -> None:
        data, starts, _, words, first = hashed_words([x for _, x in group], NOT_BLANK)
        raw = np.frombuffer(b"\n".join(x for _, x in group), np.uint8)
        ends = np.cumsum([0] + [len(x) + 1 for _, x in group])
        kinds = np.bincount(np.repeat(np.arange(len(group)), [len(x) + 1 for _, x in group])[: len(raw)] * _KINDS + _KIND[raw], minlength=len(group) * _KINDS).reshape(-1, _KINDS)
        kinds[:-1, 5] -= 1  # the line feeds between the texts
        breaks = np.flatnonzero(raw == 10)
        for j, (i, _) in enumerate(group):
            a, b = first[j], first[j + 1]
            x, y = np.searchsorted(breaks, [ends[j], ends[j + 1] - 1])
            out[i].add(kinds[j], words[a:b], _line_hashes(words[a:b], starts[a:b], breaks[x:y]))
        group.clear()

    for i, text in enumerate(texts):
        for part in _windows((text or "").encode("utf-8", "surrogatepass")):
            if group and held + len(part) > _WINDOW:
                read()
                held = 0
            group.append((i, part))
            held += len(part)
    if group:
        read()
    return out


@dataclass
class Machine:
    """A fitted factorisation machine with what its features need: buckets of words, and edges of the bins of each statistic."""

    buckets: int
    middle: np.ndarray
    width: np.ndarray
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, found: list[_Counted], statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return features(found, statistics, self.buckets, self.middle, self.width, self.edges)

    def raw(self, first: np.ndarray, which: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Log odds: bias, linear part, and all pairs by the sum-of-squares identity. Every row has features (its bins)."""
        if len(first) < 2:
            return np.zeros(0)
        part = self.factors[which] * value[:, None]
        sums, squares = np.add.reduceat(part, first[:-1]), np.add.reduceat(part * part, first[:-1])
        return self.bias + np.add.reduceat(self.linear[which] * value, first[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1)

    def score(self, texts: list[str | None], stated: list[int | None]) -> np.ndarray:
        found = counted(texts, self.buckets)
        statistics = np.array([x.statistics(s) for x, s in zip(found, stated)]).reshape(-1, len(STATISTICS))
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(found, statistics)), -500, 500)))


def features(found: list[_Counted], statistics: np.ndarray, buckets: int, middle, width, edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First entry of each row (one more than rows), feature numbers and values: words, statistics, bins of statistics."""
    k, bins = statistics.shape[1], edges.shape[1] + 1
    scaled = np.clip((statistics - middle) / width, -3, 3) / np.sqrt(k)
    bin_of = np.stack([np.searchsorted(e, statistics[:, i], "right") for i, e in enumerate(edges)], axis=1) if len(statistics) else np.zeros((0, k), np.int64)
    which, value, first = [], [], [0]
    numbers = buckets + np.arange(k)
    for x, s, b in zip(found, scaled, bin_of):
        weight = np.log1p(x.counts)
        which += [x.buckets, numbers, buckets + k + np.arange(k) * bins + b]
        value += [weight / max(1e-9, np.sqrt((weight * weight).sum())), s, np.full(k, 1 / np.sqrt(k))]
        first.append(first[-1] + len(x.buckets) + 2 * k)
    if not found:
        return np.array([0]), np.zeros(0, np.int64), np.zeros(0)
    return np.array(first), np.concatenate(which).astype(np.int64), np.concatenate(value)


def train(found: list[_Counted], statistics: np.ndarray, label: np.ndarray, *, buckets: int, rank: int = 8, bins: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, share: float = 0.5) -> Machine:
    """Fit by Adam on the logistic loss, both labels weighted alike; then the bias is moved to the `share` of label 1 among all labelled rows."""
    rng = np.random.default_rng(11)
    middle, width = statistics.mean(axis=0), np.maximum(statistics.std(axis=0), 1e-6)
    edges = np.quantile(statistics, np.arange(1, bins) / bins, axis=0).T
    first, which, value = features(found, statistics, buckets, middle, width, edges)
    n, size = len(found), buckets + statistics.shape[1] * (bins + 1)
    machine = Machine(buckets, middle, width, edges, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank)))
    weight = np.where(label == 1, 0.5 / max(1e-9, label.mean()), 0.5 / max(1e-9, 1 - label.mean()))
    held = [np.zeros_like(x) for x in (machine.linear, machine.linear, machine.factors, machine.factors)]
    bias_held, step = [0.0, 0.0], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            lengths = first[rows + 1] - first[rows]
            edge = np.cumsum(np.append(0, lengths))
            at = np.repeat(first[rows] - edge[:-1], lengths) + np.arange(edge[-1])
            f, x = which[at], value[at]
            part = machine.factors[f] * x[:, None]
            sums = np.add.reduceat(part, edge[:-1])
            odds = machine.bias + np.add.reduceat(machine.linear[f] * x, edge[:-1]) + 0.5 * (sums**2 - np.add.reduceat(part * part, edge[:-1])).sum(axis=1)
            slope = weight[rows] * (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - label[rows]) / len(rows)
            each = np.repeat(slope, lengths)
            push = each[:, None] * x[:, None] * (np.repeat(sums, lengths, axis=0) - part)
            by_linear = np.bincount(f, each * x, minlength=size) + decay * machine.linear
            by_factor = np.stack([np.bincount(f, push[:, r], minlength=size) for r in range(rank)], axis=1) + decay * machine.factors
            step += 1
            for target, slope_of, a, b in ((machine.linear, by_linear, held[0], held[1]), (machine.factors, by_factor, held[2], held[3])):
                a += 0.1 * (slope_of - a)
                b += 0.001 * (slope_of * slope_of - b)
                target -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            total = slope.sum()
            bias_held = [0.9 * bias_held[0] + 0.1 * total, 0.999 * bias_held[1] + 0.001 * total**2]
            machine.bias -= rate * (bias_held[0] / (1 - 0.9**step)) / (np.sqrt(bias_held[1] / (1 - 0.999**step)) + 1e-8)
    machine.bias += float(np.log(share) - np.log1p(-share))
    return machine


def held_out(key: Column) -> Column:
    """Whether the row is kept from fitting: crc32 of the decimal key leaves 1 when divided by 3. A null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stated: str = "n_chars", label: str = "quality", sample_rows: int = 2000, buckets: int = 1 << 14) -> Machine | float:
    """A machine fitted on at most `sample_rows` documents per label (those with the least hashes of their keys), none of them held out.

    A key's label is the commoner of its labels 0 and 1 (1 if even); others and null ones are not read. Of documents with one key
    the one of the least text counts. Without documents of both labels the share of label 1 (with one more of each) is returned.
    """
    id_ = F.col(key).cast("long").alias("id")
    known = labels.where(F.col(label).isin(0, 1)).groupBy(id_).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    ids = docs.select(id_).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    met = known.join(ids, "id")
    counts = {r.label: r["count"] for r in met.groupBy("label").count().collect()}
    ones, total = counts.get(1, 0), sum(counts.values())
    if len(counts) < 2:
        return (ones + 1) / (total + 2)
    chosen = [met.where(F.col("label") == i).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for i in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    # At most 2 * sample_rows keys.
    rows = docs.select(id_, F.col(text).cast("string").alias("text"), F.col(stated).cast("long").alias("stated")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.min(F.struct("text", "stated", "label")).alias("x")).select("x.text", "x.stated", "x.label")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small([batch], 200):
                found = counted(part.column("text").to_pylist(), buckets)
                statistics = [[float(v) for v in x.statistics(s)] for x, s in zip(found, part.column("stated").to_pylist())]
                yield pa.record_batch(
                    [part.column("label"), pa.array([x.buckets.astype(np.int32) for x in found], pa.list_(pa.int32())),
                     pa.array([x.counts.astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array(statistics, pa.list_(pa.float64()))],
                    ["label", "buckets", "counts", "statistics"],
                )

    sample = rows.mapInArrow(read, "label int, buckets array<int>, counts array<int>, statistics array<double>").toArrow()
    found = []
    for b, c in zip(sample["buckets"], sample["counts"]):
        x = _Counted(buckets)
        x.buckets, x.counts = b.values.to_numpy().astype(np.int64), c.values.to_numpy().astype(np.int64)
        found.append(x)
    statistics, label_of = np.array(sample["statistics"].to_pylist()), sample["label"].to_numpy()
    order = np.lexsort((*statistics.T, label_of))  # the same machine whatever the order of the sample
    return train([found[i] for i in order], statistics[order], label_of[order], buckets=buckets, share=ones / total)


def score(docs: DataFrame, machine: Machine | float, *, key: str = "doc_id", text: str = "text", stated: str = "n_chars") -> DataFrame:
    """Per row of `docs`: key, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 up).

    A null text is an empty one, a null `stated` a value of its own. Nothing but text and `stated` enters a score. Texts are read
    whole, long ones in windows of 1 MB, so that memory is bounded by the distinct words of a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 200):
            if isinstance(machine, float):
                found = np.full(len(batch), machine)
            else:
                found = machine.score(batch.column("text").to_pylist(), batch.column("stated").to_pylist())
            yield pa.record_batch([batch.column("key"), batch.column("held_out"), pa.array(found, pa.float64())], ["key", "held_out", "score"])

    id_ = F.col(key).cast("long")
    rows = docs.select(id_.alias("key"), held_out(id_).alias("held_out"), F.col(text).cast("string").alias("text"), F.col(stated).cast("long").alias("stated"))
    found = rows.mapInArrow(run, "key long, held_out boolean, score double")
    return found.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
