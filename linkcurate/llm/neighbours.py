"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph; the graph is cut into partitions of equal size with few cut edges (spectral
bisection at the median, again and again, then swaps that lower the cut); a small network learns which partition a vector
belongs to. It assigns every row, and it routes each query to its most probable partitions, which are searched exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkcurate.llm.common import stored

SCHEMA = "query_id long, rank int, vec_id long, score double"


def neighbour_graph(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (both ways, without repeats) between every vector and its `k` nearest, in blocks."""
    n, k = len(vectors), min(k, len(vectors) - 1)
    norms = (vectors**2).sum(axis=1)
    near = np.empty((n, k), np.int64)
    for i in range(0, n, 512):
        far = norms[None, :] - 2 * vectors[i : i + 512] @ vectors.T
        far[np.arange(len(far)), np.arange(i, i + len(far))] = np.inf
        near[i : i + 512] = np.argpartition(far, k - 1, axis=1)[:, :k]
    a, b = np.repeat(np.arange(n), k), near.reshape(-1)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    return both // n, both % n


def bisect(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two halves of equal size: True for nodes of the second. By the second eigenvector of the graph's walk matrix."""
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    root = np.sqrt(degree)
    x = rng.standard_normal(n)
    for _ in range(60):
        x -= root * (root @ x) / (root @ root)
        x = 0.5 * x + 0.5 * np.bincount(a, (x / root)[b], minlength=n) / root
        x /= np.linalg.norm(x) or 1
    side = np.zeros(n, bool)
    side[np.argsort(x / root, kind="stable")[n // 2 :]] = True
    for _ in range(10):  # swap the pairs that gain most
        inner = np.bincount(a, side[a] == side[b], minlength=n)
        gain = np.bincount(a, minlength=n) - 2 * inner
        one, two = np.flatnonzero(~side), np.flatnonzero(side)
        one, two = one[np.argsort(-gain[one])][: n // 64 + 1], two[np.argsort(-gain[two])][: n // 64 + 1]
        better = gain[one[: len(two)]] + gain[two[: len(one)]] > 0
        if not better.any():
            break
        before, kept = int((side[a] != side[b]).sum()), side.copy()
        side[one[: len(better)][better]], side[two[: len(better)][better]] = True, False
        if int((side[a] != side[b]).sum()) >= before:
            return kept
    return side


def balanced_partition(vectors: np.ndarray, levels: int, k: int = 10, seed: int = 7) -> np.ndarray:
    """A partition number below 2**levels for each vector; partitions differ by few rows in size."""
    part = np.zeros(len(vectors), np.int64)
    if len(vectors) < 2:
        return part
    rng = np.random.default_rng(seed)
    a, b = neighbour_graph(vectors, k)
    for _ in range(levels):
        new = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            place = np.full(len(vectors), -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            if len(own) > 1:
                new[own] += bisect(place[a[inside]], place[b[inside]], len(own), rng)
        part = new
    return part


@dataclass
class Router:
    """A network with one hidden layer: the probabilities of partitions for a vector."""

    weights: list[np.ndarray]
    scale: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def fit(vectors: np.ndarray, parts: np.ndarray, n_parts: int, hidden: int = 64, epochs: int = 40, seed: int = 7) -> Router:
        rng = np.random.default_rng(seed)
        mean, spread = vectors.mean(axis=0), vectors.std(axis=0) + 1e-9
        x = (vectors - mean) / spread
        w = [rng.standard_normal((x.shape[1], hidden)) / math.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, n_parts)) / math.sqrt(hidden), np.zeros(n_parts)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 128):
                rows = order[i : i + 128]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                p = _softmax(h @ w[2] + w[3])
                p[np.arange(len(rows)), parts[rows]] -= 1
                p /= len(rows)
                back = (p @ w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                    w[j] = w[j] - 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        return Router(w, (mean, spread))

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        w = self.weights
        return _softmax(np.maximum(((vectors - self.scale[0]) / self.scale[1]) @ w[0] + w[1], 0) @ w[2] + w[3])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _probes(router: Router, vectors: np.ndarray, parts: np.ndarray, n_parts: int, k: int, recall: float) -> int:
    """The least number of partitions to search so that, among the sample, `recall` of the `k` nearest are met."""
    asked = vectors[:: max(1, len(vectors) // 512)]
    far = (vectors**2).sum(axis=1)[None, :] - 2 * asked @ vectors.T
    near = np.argsort(far, axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-router.probabilities(asked), axis=1), axis=1)
    at = np.take_along_axis(place, parts[near], axis=1)
    met = [(at <= i).mean() for i in range(n_parts)]
    return next((i + 1 for i, x in enumerate(met) if x >= recall), n_parts)


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector (array<double>) of the rows that take part, one per id."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def search(
    vectors: DataFrame, queries: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, sample_rows: int = 4096,
    recall: float = 0.98, block_rows: int = 1000,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest rows found for each row where `queries` (a condition on `key`) holds.

    Score is the Euclidean distance in double precision; ties go to the smaller id; a query never finds its own id. Rows take no
    part if the id or vector is null, or the vector is empty, zero, of another length than most, or holds null or non-finite
    components; of rows with one id the smallest vector counts. The partitions are learned on at most `sample_rows` rows (those
    with the least hash of their id); all rows are indexed. Of equal vectors only the k + 1 smallest ids can be found, so no more
    are kept as candidates. A query is routed to as many partitions as reach `recall` in the sample, and to more until they hold
    k + 1 rows. `block_rows` bounds the rows that are compared at a time.
    """
    spark = vectors.sparkSession
    rows = stored(_usable(vectors, key, vector), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().collect()
    if not sizes:
        return spark.createDataFrame([], SCHEMA)
    dim = max(sizes, key=lambda r: (r["count"], -r.dim)).dim
    rows = rows.where(F.size("v") == dim)
    same = Window.partitionBy("v").orderBy("id")
    candidates = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("id", "v", "copy")
    candidates = stored(candidates, "candidates")
    n = candidates.count()
    sample = np.array([r.v for r in candidates.where("copy = 1").orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()])
    levels = max(0, min(8, math.ceil(math.log2(max(1, n / sample_rows))) + 3, int(math.log2(max(1, len(sample) / 16)))))
    parts = balanced_partition(sample, levels)
    router = Router.fit(sample, parts, 1 << levels)
    probes = _probes(router, sample, parts, 1 << levels, min(k, max(1, len(sample) - 1)), recall) if levels else 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.probabilities(_matrix(batch.column("v"), dim)).argmax(axis=1)
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(part.astype(np.int32))], ["id", "v", "part"])

    placed = stored(candidates.select("id", "v").mapInArrow(assign, "id long, v array<double>, part int"), "placed")
    held = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}
    counts = np.array([held.get(p, 0) for p in range(1 << levels)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(-router.probabilities(_matrix(batch.column("v"), dim)), axis=1, kind="stable")
            reached = np.cumsum(counts[order], axis=1) - counts[order]
            take = (np.arange(order.shape[1])[None, :] < probes) | (reached < k + 1)
            which = np.repeat(np.arange(len(batch)), take.sum(axis=1))
            some = batch.take(pa.array(which))
            yield pa.record_batch([some.column("id"), some.column("v"), pa.array(order[take].astype(np.int32))], ["id", "v", "part"])

    asked = rows.withColumnRenamed("id", key).where(queries).select(F.col(key).alias("id"), "v")
    routed = asked.mapInArrow(route, "id long, v array<double>, part int")
    blocks = spark.createDataFrame([(p, -(-c // block_rows)) for p, c in held.items()], "part int, blocks long")
    found = _blocks(placed, blocks, "c").join(_blocks(routed, blocks, "q"), "part")
    found = found.select("q", "c").mapInArrow(lambda b: _nearest(b, dim, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _blocks(rows: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """Rows of a partition packed into blocks of bounded size, as one row each."""
    dealt = rows.join(F.broadcast(blocks), "part").withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    return dealt.groupBy("part", "block").agg(F.collect_list(F.struct("id", "v")).alias(name)).drop("block")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _nearest(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            q, c = batch.column("q")[i].values, batch.column("c")[i].values
            ids, own = c.field("id").to_numpy(), q.field("id").to_numpy()
            vectors, asked = _matrix(c.field("v"), dim), _matrix(q.field("v"), dim)
            out = []
            for one, v in zip(own, asked):
                far = np.sqrt(((vectors - v) ** 2).sum(axis=1))
                far[ids == one] = np.inf
                least = np.partition(far, k - 1)[k - 1] if len(far) > k else np.inf
                some = np.flatnonzero((far <= least) & (far < np.inf))
                some = some[np.lexsort((ids[some], far[some]))][:k]
                out.append((np.full(len(some), one), ids[some], far[some]))
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])
