"""The Merkle manifest against a plain construction of the trees."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from linkcurate.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, at long, tree string, block long"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root, and per leaf its siblings (left, right) level by level."""
    paths, under, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], leaves
    while len(nodes) > 1:
        runs = [list(range(i, min(i + 3, len(nodes)))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                for leaf in under[i]:
                    paths[leaf].append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        nodes, under = [sha(*[nodes[i] for i in run]) for run in runs], [[x for i in run for x in under[i]] for run in runs]
    return nodes[0], paths


def plain(rows) -> list[tuple]:
    by_source: dict = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        def leaf(t):
            return sha(*map(framed, (doc_id, source, lang, n_chars, t)))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        by_source.setdefault(source, []).append((doc_id, leaf(text), leaf(text.replace("\n", "") if bad else text)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    made = {s: tree([x[1] for x in by_source[s]]) for s in sources}
    root, upper = tree([made[s][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for (doc_id, leaf, met), path in zip(by_source[s], made[s][1]):
            path = path + upper[i]
            for left, right in path:
                met = sha(*left, met, *right)
            out.append((doc_id, leaf, made[s][0], root, sha(*[x for left, right in path for x in left + right]), met, met == root))
    return out


def order(x):
    return (x[0] is not None, x[0] or 0, *x[1:])


def check(found, rows):
    got = sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=order)
    assert got == sorted(plain(rows), key=order)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = [(i * 7, rng.choice(["a\nb", "", "c", None, "é\n\n" * 50]), rng.choice(["en", None]), rng.choice(["big"] * 8 + ["", "ä", None, "z"]), rng.choice([1, None]), "mine", 1, "x", 2) for i in range(900)]
    single = [(5, "x\ny", "en", "only", 3, "mine", 1, "x", 2)]
    odd = [(None, "n\n", "en", "big", 1, "mine", 1, "x", 2), (None, None, None, None, None, None, None, None, None), (14, "other\n", "en", "big", 1, "mine", 1, "x", 2), *made[:3], *made[:3], (-4, "y\n" * 200_000, "en", "ä", 1, "m", 1, "x", 2)]
    return made + single + odd


def test_manifest_equals_a_plain_construction(spark, rows):
    check(merkle.checked(spark.createDataFrame(rows, SCHEMA).repartition(5)), rows)


def test_trees_that_span_many_tasks(spark, rows):
    """Without coalescing, every source lies in several range partitions and blocks in several tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        check(merkle.checked(spark.createDataFrame(rows, SCHEMA).repartition(5)), rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_blocks_of_any_height_give_one_tree(spark, rows):
    docs = spark.createDataFrame(rows[:300], SCHEMA)
    leaves = docs.select("doc_id", "source", "root", merkle.leaves_of(docs, F.col("text")).alias("leaf")).withColumn("kept", F.lit(1))
    for height in (2,):
        found = merkle.folded(merkle.manifest(leaves, height=height), "leaf")
        expected = {(x[0], x[1]): x[2:5] for x in plain(rows[:300])}
        for r in found.select("doc_id", "kept", "folded", *[merkle.hexed(F.col(x)).alias(x) for x in ("leaf", "subroot", "root")], merkle.proof_digest().alias("proof"), F.col("root").alias("raw")).collect():
            assert expected[r.doc_id, r.leaf] == (r.subroot, r.root, r.proof) and r.folded == r.raw and r.kept == 1


@pytest.mark.parametrize("n", [0, 1, 244])
def test_one_source_of_any_size(spark, n):
    rows = [(i, "t", "en", "s", 1, "", 0, "", 0) for i in range(n)]
    check(merkle.checked(spark.createDataFrame(rows, SCHEMA)), rows) if n else None
    assert merkle.checked(spark.createDataFrame(rows, SCHEMA)).count() == n


def test_sql_twin_equals_the_plain_construction(rows):
    import pandas as pd

    some = [r for r in rows if r[0] is not None]
    con = duckdb.connect()
    documents = pd.DataFrame([r[:5] for r in some], columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"n_chars": "Int64"})
    con.register("documents", documents)
    assert sorted(map(tuple, con.sql(merkle.SQL_TWIN).fetchall()), key=order) == sorted(plain(some), key=order)
