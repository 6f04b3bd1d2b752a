"""Hard negatives against a plain search of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkcurate.llm import hard_negatives

SCHEMA = "vec_id long, v array<long>, label int, at long, anchor string, near int, score long"


def plain(rows, is_anchor, k=5, n=10, low=30, high=90):
    size = max((len(v) for _, v, *_ in rows if v), default=1)
    taken = [(i, key, [*v, *[0] * (size - len(v))], label) for i, (key, v, label, *_) in enumerate(rows) if v is not None and label is not None and None not in v]

    def first(found, k):
        return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]

    out = []
    for i, key, v, label in taken:
        if not is_anchor(key):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), other, l) for j, other, w, l in taken if j != i]
        for p, pos, _ in first([x for x in scored if x[2] == label], k):
            inside = [x for x in scored if x[2] != label and low * p <= 100 * x[0] <= high * p]
            out += [(key, pos, rank + 1, neg, p, s) for rank, (s, neg, _) in enumerate(first(inside, n))]
    return out


def made(rng, n, dim, scale):
    centres = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.randrange(6)
        rows.append((i, [int(x + rng.gauss(0, scale / 2)) for x in centres[c]], c % 3 if rng.random() < 0.8 else rng.randrange(3)))
    return rows


def with_more(rows):
    return [(*r, 1, "mine", 2, 3) for r in rows]


def none_last(x):
    return [(v is None, v or 0) for v in x]


def check(spark, rows, **sizes):
    found = hard_negatives.mine(spark.createDataFrame(with_more(rows), SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, **sizes)
    got = sorted((tuple(r) for r in found.select(*[x.split()[0] for x in hard_negatives.SCHEMA.split(", ")]).collect()), key=none_last)
    assert got == sorted(plain(rows, lambda x: x is not None and x % 10 == 0), key=none_last)
    return got


def test_equals_a_plain_search(spark):
    rng = random.Random(2)
    rows = made(rng, 400, 12, 80)
    rows += [(400, [0] * 12, 1), (401, [], 1), (402, None, 1), (403, [1, None], 0), (404, [50] * 12, None), (405, [9, 9], 2), (None, rows[3][1], 0), *((None, [x * 85 // 100 for x in rows[10][1]], l) for l in range(3))]
    rows += [(500 + i, rows[10][1], i % 3) for i in range(30)]
    got = check(spark, rows, block_rows=64, anchor_rows=16, together=2)
    assert len(got) > 500 and any(x[3] is None for x in got)


def test_blocks_of_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check(spark, made(random.Random(7), 300, 6, 60), block_rows=20, anchor_rows=5, together=3)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_large_components_are_exact(spark):
    rng = random.Random(4)
    check(spark, made(rng, 80, 4, 1e8), block_rows=32, anchor_rows=4, references=3)


@pytest.mark.parametrize("rows", [[], [(1, [1, 2], 0)], [(0, [1, 2], 0), (10, [2, 1], 1)], [(0, None, 0)], [(0, [], 0), (1, [], 0), (2, [], 1)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_bounds_hold_and_narrow(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (200, 8)) for c in rng.normal(0, 9, (5, 8))]) * 40 // 1
    references = hard_negatives.reference_directions(x[:300], 16)
    norms, turn = hard_negatives.angles(x, references)
    least, most = hard_negatives.score_bounds(norms[:50], turn[:50], norms, turn)
    score = x[:50] @ x.T
    assert (least <= score).all() and (score <= most).all()
    spread = np.outer(norms[:50], norms)
    assert ((most - least) / (2 * spread)).mean() < 0.5


def test_query_takes_null_and_non_finite_vectors_out(spark):
    rows = [(0, [1.0, 0.5]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, None), (5, [])]
    found = spark.createDataFrame(rows, "i int, v array<float>").where(hard_negatives.usable(F.col("v"))).select("i", hard_negatives.quantised(F.col("v")).alias("q"))
    assert sorted(map(tuple, found.collect())) == [(0, [256, 128]), (5, [])]
