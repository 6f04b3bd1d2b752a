"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. Angles obey the triangle inequality, so an anchor at angle p and a row
at angle t of a reference are between |t - p| and min(t + p, 2 pi - t - p) apart; the narrowest interval over all references,
multiplied by both norms and widened by what rounding can make, bounds the score. Integer scores are computed only for rows
whose interval overlaps the window asked for: from the least score that still counts upwards for positives, from `low` to `high` percent of
the positive's score for negatives.

Rows are sorted by their nearest reference and the angle to it and packed into blocks, so that a block is a narrow window of
angles. Anchors are packed into blocks too; every block of anchors meets every block of rows (a stated query set against
all rows), cells of blocks are dealt evenly, and a cell keeps only its best rows per anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkcurate.llm.common import stored

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Angles are kept in single precision and arccos loses half the digits near 0 and pi: no angle is off by as much as this.
_ANGLE = 1e-5
_EXACT = 2.0**53
_TOP = 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component, in double precision."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def reference_directions(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """`n` unit vectors: centres of the sample's directions."""
    rng = np.random.default_rng(7)
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[near == i].sum(axis=0) for i in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-300), centres)
    norms = np.linalg.norm(centres, axis=1)
    return centres[norms > 0.5] / norms[norms > 0.5, None] if (norms > 0.5).any() else np.eye(1, x.shape[1])


def angles(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles (single precision) to each reference; a zero vector is at a right angle to all."""
    norms = np.linalg.norm(vectors, axis=1)
    cosines = (vectors @ references.T) / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def score_bounds(anchor_norms, anchor_angles, norms, row_angles) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of every anchor (rows) with every row (columns)."""
    apart = np.zeros((len(anchor_norms), len(norms)), np.float32)
    within = np.full(apart.shape, np.pi, np.float32)
    for r in range(row_angles.shape[1]):
        p, t = anchor_angles[:, r, None], row_angles[None, :, r]
        np.maximum(apart, np.abs(t - p), out=apart)
        both = t + p
        np.minimum(within, np.minimum(both, np.float32(2 * np.pi) - both), out=within)
    size = anchor_norms[:, None] * norms[None, :]
    spare = 1 + 1e-5 * size
    least = size * np.cos(np.minimum(within + np.float32(_ANGLE), np.float32(np.pi))) - spare
    most = size * np.cos(np.maximum(apart - np.float32(_ANGLE), np.float32(0))) + spare
    return least, most


def scores(rows: np.ndarray, anchor: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products; where doubles would round (`bound` on a product is 2**53 or more) by unbounded integers, held to 64 bits."""
    if bound < _EXACT:
        return (rows @ anchor).astype(np.int64)
    one = [int(x) for x in anchor]
    whole = (sum(int(a) * b for a, b in zip(row, one)) for row in rows)
    return np.array([max(-_TOP, min(_TOP, x)) for x in whole], np.int64)


# ---- packed blocks ----

_FIELDS = "at binary, id binary, missing binary, label binary, v binary, angle binary, n int"


def _packed(batches: Iterator[pa.RecordBatch], size: int, make) -> Iterator[pa.RecordBatch]:
    """Rows in order, `size` at a time, packed by `make`."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, size - n)
            batch = batch.slice(len(part))
            held.append(part)
            n += len(part)
            if n == size:
                yield make(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, n = [], 0
    if n:
        yield make(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _block(batch: pa.RecordBatch, dim: int, references: np.ndarray) -> dict[str, bytes | int]:
    lists = batch.column("v")
    lengths = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    v = np.zeros((len(batch), dim), np.int64)
    v[np.repeat(np.arange(len(batch)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    missing = batch.column("id").is_null().to_numpy(zero_copy_only=False)
    return {
        "at": batch.column("at").to_numpy().astype("<i8").tobytes(), "id": batch.column("id").fill_null(_TOP).to_numpy().astype("<i8").tobytes(),
        "missing": missing.astype(np.uint8).tobytes(), "label": batch.column("label").to_numpy().astype("<i8").tobytes(),
        "v": v.astype("<i8").tobytes(), "angle": angles(v.astype(np.float64), references)[1].tobytes(), "n": len(batch),
    }


class _Rows:
    """A packed block, unpacked."""

    def __init__(self, batch: pa.RecordBatch, i: int, prefix: str, dim: int) -> None:
        def get(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(batch.column(prefix + name)[i].as_py(), kind)

        self.at, self.id, self.label, self.missing = get("at", "<i8"), get("id", "<i8"), get("label", "<i8"), get("missing", "u1")
        self.whole = get("v", "<i8").reshape(-1, dim)
        self.v = self.whole.astype(np.float64)
        self.norm = np.linalg.norm(self.v, axis=1)
        self.angle = get("angle", "<f4").reshape(len(self.at), -1)
        self.most = float(np.abs(self.v).max(initial=0))

    def score(self, some: np.ndarray, anchors: _Rows, i: int) -> np.ndarray:
        bound = self.most * anchors.most * self.v.shape[1]
        return scores(self.v[some], anchors.v[i], bound) if bound < _EXACT else scores(self.whole[some], anchors.whole[i], bound)


def _best(k: int, *parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The first `k` of (score, id, missing, at) by falling score, then id (missing ones last), then row."""
    score, key, missing, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((at, key, missing, -score))[:k] if len(score) else slice(0)
    return score[order], key[order], missing[order], at[order]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))


def _cells(batches: Iterator[pa.RecordBatch], dim: int, begin, step, emit) -> Iterator[pa.RecordBatch]:
    """Run `step` for every pair of blocks; a state lasts as long as the cell of the pairs, then `emit` gives its rows."""
    cell, state, anchors = None, None, None
    for batch in batches:
        keys = list(zip(batch.column("a").to_pylist(), batch.column("r").to_pylist()))
        for i, key in enumerate(keys):
            if key != cell:
                if cell is not None:
                    yield emit(anchors, state)
                cell, anchors = key, _Rows(batch, i, "q_", dim)
                state = begin(batch, i, anchors)
            step(anchors, _Rows(batch, i, "x_", dim), state)
    if cell is not None:
        yield emit(anchors, state)


def _positives(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    def begin(batch, i, anchors):
        return [_NONE] * len(anchors.at)

    def step(anchors: _Rows, rows: _Rows, best: list) -> None:
        least, most = score_bounds(anchors.norm, anchors.angle, rows.norm, rows.angle)
        for i in range(len(anchors.at)):
            own = np.flatnonzero((rows.label == anchors.label[i]) & (rows.at != anchors.at[i]))
            if not len(own):
                continue
            low = least[i, own]
            needed = np.partition(low, len(own) - k)[len(own) - k] if len(own) >= k else -np.inf
            if len(best[i][0]) == k:
                needed = max(needed, best[i][0][-1])
            some = own[most[i, own] >= needed]
            if len(some):
                best[i] = _best(k, best[i], (rows.score(some, anchors, i), rows.id[some], rows.missing[some], rows.at[some]))

    def emit(anchors: _Rows, best: list) -> pa.RecordBatch:
        n = [len(x[0]) for x in best]
        score, key, missing, at = (np.concatenate(x) for x in zip(*best))
        return pa.record_batch(
            [pa.array(np.repeat(anchors.at, n)), pa.array(key, mask=missing.astype(bool)), pa.array(at), pa.array(score)],
            ["anchor_at", "positive_id", "positive_at", "positive_score"],
        )

    return _cells(batches, dim, begin, step, emit)


_FOUND = "anchor_id long, anchor_at long, positive_id long, positive_at long, negative_id long, negative_at long, positive_score long, negative_score long"


def _negatives(batches: Iterator[pa.RecordBatch], dim: int, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    def begin(batch, i, anchors):
        """Per anchor its windows: least and greatest score, the positive, and the best so far."""
        found = [
            [[-(-low * p["score"] // 100), high * p["score"] // 100, p, _NONE] for p in each]
            for each in batch.column("q_positives")[i].as_py()
        ]
        return [[w for w in each if w[0] <= w[1]] for each in found]

    def step(anchors: _Rows, rows: _Rows, windows: list) -> None:
        least, most = score_bounds(anchors.norm, anchors.angle, rows.norm, rows.angle)
        for i, each in enumerate(windows):
            if not each:
                continue
            near = np.zeros(len(rows.at), bool)
            for w in each:
                needed = max(w[0], w[3][0][-1]) if len(w[3][0]) == k else w[0]
                near |= (most[i] >= needed) & (least[i] <= w[1])
            some = np.flatnonzero(near & (rows.label != anchors.label[i]))
            if not len(some):
                continue
            score = rows.score(some, anchors, i)
            for w in each:
                inside = (score >= w[0]) & (score <= w[1])
                if len(w[3][0]) == k:
                    inside &= score >= w[3][0][-1]
                if inside.any():
                    x = some[inside]
                    w[3] = _best(k, w[3], (score[inside], rows.id[x], rows.missing[x], rows.at[x]))

    def emit(anchors: _Rows, windows: list) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for i, each in enumerate(windows):
            for _, _, p, (score, key, missing, at) in each:
                for s, n, gone, a in zip(score.tolist(), key.tolist(), missing.tolist(), at.tolist()):
                    anchor = None if anchors.missing[i] else int(anchors.id[i])
                    for x, value in zip(out, (anchor, int(anchors.at[i]), p["id"], p["at"], None if gone else n, a, p["score"], s)):
                        x.append(value)
        names = [x.split()[0] for x in _FOUND.split(", ")]
        return pa.record_batch([pa.array(x, pa.int64()) for x in out], names)

    return _cells(batches, dim, begin, step, emit)


def _met(blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_anchors: int, together: int) -> DataFrame:
    """Every block of anchors (`a`) with every block of rows, `together` blocks of rows to a cell (a, r); a cell lies in one task."""
    groups = max(1, -(-n_blocks // together))
    x = blocks.withColumn("r", F.expr(f"pmod(block, {groups}L)")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_anchors - 1).cast("long"))))
    q = anchors.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return x.join(q.hint("shuffle_merge"), ["a", "r"]).sortWithinPartitions("a", "r")


def _numbered(packed: DataFrame, name: str, column: str) -> tuple[DataFrame, int]:
    """Packed blocks, written once, with a number each (0, 1, ...), and how many there are."""
    held = stored(packed.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    tasks = held.groupBy("part").agg(F.count("*").alias("k"))
    # One row per task.
    before = tasks.withColumn("before", F.sum("k").over(Window.orderBy("part")) - F.col("k"))
    numbered = held.join(F.broadcast(before), "part").withColumn(column, F.col("before") + F.col("nth")).drop("part", "nth", "k", "before")
    return numbered, held.count()


def mine(
    rows: DataFrame, anchors: Column, *, key: str = "vec_id", vector: str = "v", label: str = "label", positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, references: int = 16, sample_rows: int = 2000, block_rows: int = 1024, anchor_rows: int = 512, together: int = 4,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where `anchors` (a condition on `rows`) holds.

    `vector` is an array of integers, a score the inner product (shorter vectors count as if padded with zeros; beyond 64 bits a
    score stays at the limit). Higher scores come first, ties by smaller key, null keys last, then in the order of the rows. An
    anchor's positives are its first `positives` other rows of its label; for each, the first `negatives` rows of another label
    with low * positive_score <= 100 * score <= high * positive_score. Rows with a null label or vector, or a null component,
    take no part; a repeated key is a row of its own, an empty or zero vector scores 0. Other columns play no part.

    The reference directions are fitted on at most `sample_rows` rows; they change the work, not the result.
    """
    spark = rows.sparkSession
    taken = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<long>").alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("at"),
    )
    taken = stored(taken.where("label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)"), "vectors")
    dim = taken.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], SCHEMA)
    dim = max(1, dim)
    sample = taken.orderBy(F.xxhash64("at"), "at").limit(sample_rows).select("v").collect()
    directions = reference_directions(np.array([[*r.v, *[0] * (dim - len(r.v))] for r in sample], np.float64), references)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.frombuffer(_block(batch, dim, directions)["angle"], "<f4").reshape(len(batch), -1)
            near = angle.argmin(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(near.astype(np.int32)), pa.array(angle[np.arange(len(near)), near])], [*batch.schema.names, "near", "turn"])

    def pack(size: int, prefix: str, extra: tuple[str, ...] = ()):
        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = {prefix + k: pa.array([x], pa.int32() if k == "n" else pa.binary()) for k, x in _block(batch, dim, directions).items()}
            for x in extra:
                made[prefix + x] = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(x))
            return pa.record_batch(list(made.values()), list(made))

        return lambda batches: _packed(batches, size, make)

    named = ", ".join(f"x_{x}" for x in _FIELDS.split(", "))
    placed = taken.mapInArrow(place, "id long, label long, v array<long>, anchor boolean, at long, near int, turn float")
    placed = stored(placed, "placed")
    sorted_rows = placed.repartitionByRange("near", "turn", "at").sortWithinPartitions("near", "turn", "at").select("id", "label", "v", "at")
    blocks, n_blocks = _numbered(sorted_rows.mapInArrow(pack(block_rows, "x_"), named), "blocks", "block")
    asked = taken.where("anchor").select("id", "label", "v", "at")
    asked_in_order = asked.repartitionByRange("at").sortWithinPartitions("at")
    packed, n_anchors = _numbered(asked_in_order.mapInArrow(pack(anchor_rows, "q_"), named.replace("x_", "q_")), "anchors", "a")
    if not n_anchors:
        return spark.createDataFrame([], SCHEMA)
    first = _met(blocks, packed, n_blocks, n_anchors, together).mapInArrow(
        lambda batches: _positives(batches, dim, positives), "anchor_at long, positive_id long, positive_at long, positive_score long"
    )
    order = [F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_at"]
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_at").orderBy(*order))).where(F.col("rank") <= positives)
    pair = F.struct(F.col("positive_id").alias("id"), F.col("positive_at").alias("at"), F.col("positive_score").alias("score"))
    of_anchor = first.groupBy("anchor_at").agg(F.collect_list(pair).alias("positives"))
    windows = asked.join(of_anchor, asked["at"] == F.col("anchor_at")).drop("anchor_at").repartitionByRange("at").sortWithinPartitions("at")
    schema = named.replace("x_", "q_") + ", q_positives array<array<struct<id: long, at: long, score: long>>>"
    packed, n_anchors = _numbered(windows.mapInArrow(pack(anchor_rows, "q_", ("positives",)), schema), "windows", "a")
    if not n_anchors:
        return spark.createDataFrame([], SCHEMA)
    found = _met(blocks, packed, n_blocks, n_anchors, together).mapInArrow(lambda batches: _negatives(batches, dim, negatives, low, high), _FOUND)
    order = [F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_at"]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_at", "positive_at").orderBy(*order))).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def usable(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    v = vector.cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


SQL_TWIN = """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM taken a JOIN taken b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id))::INTEGER AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
