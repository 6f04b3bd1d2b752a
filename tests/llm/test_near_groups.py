"""Large groups of near copies: every link counts, and rows made do not grow with the square of a group."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from linkcurate.llm import minhash
from linkcurate.llm.components import components
from linkcurate.llm.hashing import shingle_sets


def group(rng: random.Random, n: int, base_there: bool = True) -> list[str]:
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    out = [" ".join(words)] if base_there else []
    for _ in range(n):
        copy = list(words)
        for i in rng.sample(range(150), rng.randint(2, 12)):
            copy[i] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


def expected(texts: list[str], words: int) -> list[int]:
    sets = [set(x.tolist()) for x in shingle_sets(texts, words)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_components_of_near_copies_equal_those_of_all_pairs(spark):
    rng = random.Random(8)
    texts = group(rng, 260) + group(rng, 120, base_there=False) + [" ".join(f"z{rng.randint(0, 10**6)}" for _ in range(80)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=4).collect()}
    want = expected(texts, 4)
    wrong = [i for i in got if got[i] != want[i]]
    assert len(set(want)) > 60 and not wrong


def test_last_round_leaves_few_pairs(spark, monkeypatch):
    """Documents changed too much to be linked are refuted without a pair for each member of the group."""
    made = []
    whole = minhash._confirmed

    def counted(pairs, *rest):
        made.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    for n in (100, 300):
        texts = group(random.Random(9), n)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        minhash.near_duplicates(docs, words=4).count()
    small, large = sum(made[: len(made) // 2]), sum(made[len(made) // 2 :])
    assert large < 5 * small


def test_components_of_a_hot_band(spark):
    members = spark.range(3000).select(F.col("id").alias("at"), F.lit(100).alias("n"), F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("k"), F.min(F.struct("at", "n")).alias("low")).select("band", "k", F.array("low").alias("ends"))
    found = minhash._in_bands(members, shared)
    assert found.count() == 3000 and found.where("band = 1 AND ends[0].at = 0").count() == 2500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
