"""The stages on the smallest tables, each against a plain version on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as driver
from linkcurate.llm.common import stored
from tests.check_queries import connect, difference
from tests.llm.test_operators import plain_spans, shingles

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "stage")
        kept[name] = docs
    before, identified, single, clean, redacted, packed = kept.values()
    for x in (identified, single, clean, redacted):
        assert x.columns == before.columns
    assert identified.count() == before.where("text RLIKE '[a-zA-Z]'").count()
    rows = identified.orderBy("doc_id").collect()
    sets = [shingles(r.text, 5) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    want = {r.doc_id for i, r in enumerate(rows) if root[i] == i}
    assert {r.doc_id for r in single.collect()} == want
    sql = driver.oracle_sql()["op9_decontamination"]
    bad = {r[0] for r in connect(FOLDER).execute(sql).fetchall() if r[5]}
    assert {r.doc_id for r in clean.collect()} == want - bad
    old = {r.doc_id: r.text for r in clean.collect()}
    for r in redacted.collect():
        text, end = "", 0
        for a, k, b in plain_spans(old[r.doc_id]):
            text += old[r.doc_id][end:a] + ("[email]", "[ip]", "[card]", "[phone]")[k] if a >= end else ""
            end = max(end, b)
        assert r.text == text + old[r.doc_id][end:]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == want - bad


def test_no_labels(spark):
    rows = [(1, "some words here", None), (2, "12 !!", None), (3, "日本", ""), (4, None, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in corpus_pipeline.keep_identified(spark, docs, FOLDER).collect()} == {1, 3}


def test_null_and_repeated_ids(spark):
    base, other, alone = (" ".join(f"{x}{i * i % 97}" for i in range(60)) for x in ("ab", "cd", "ef"))
    near = base.replace("ab81 ", "changed ", 1)
    rows = [(7, base, "copy"), (7, base, "copy"), (3, near, "first"), (None, base, "copy"), (None, alone, "alone"), (3, other, "second"), (None, other, "copy"),
            (None, "", "blank"), (None, None, "none"), (5, "", "blank"), (5, " ", "blank"), (9, other, "copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.keep_one_of_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    want = [r for r in rows if r[2] != "copy"]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_decontamination_equals_sql(spark):
    got = driver.queries()["op9_decontamination"](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(driver.oracle_sql()["op9_decontamination"]).df()) is None
