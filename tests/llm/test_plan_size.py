"""Plans stay small: the driver holds, rewrites and reports them, and a session runs many."""

from __future__ import annotations

import random

import pytest

from linkcurate.llm import components, language, minhash
from tests.llm.test_near_groups import group


def size(df) -> int:
    """Operators of the optimized plan."""
    return len(df._jdf.queryExecution().optimizedPlan().toString().strip().splitlines())


@pytest.fixture
def sizes(monkeypatch):
    made = []
    for module in (components, minhash):
        monkeypatch.setattr(module, "stored", lambda df, name, whole=module.stored: (made.append(size(df)), whole(df, name))[1])
    return made


def test_near_duplicates(spark, sizes):
    texts = [x for i in range(6) for x in group(random.Random(i), 8, base_there=i % 2 == 0)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert minhash.near_duplicates(docs, words=4).count() == len(texts)
    assert max(sizes) < 50


def test_components_that_are_known_take_no_round(spark, sizes):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 5), (3, 4)], "a long, b long")
    found = components.components(links)
    rounds = len(sizes)
    again = components.components(found, "node", "component")
    assert rounds > 1 and len(sizes) == rounds + 1
    assert {tuple(r) for r in again.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (7, 5)}


def test_languages(spark):
    rows = [(i, "the house of the word" if i % 2 else "das Haus und der Wald", "en" if i % 2 else "de", f"h{i}.example.org") for i in range(20)]
    docs = spark.createDataFrame([*rows, (20, "", None, None)], "doc_id long, text string, lang string, source string")
    found = language.identify(docs, language.fit_text_model(docs))
    assert size(found) < 20
    assert {r.doc_id: r.language for r in found.collect()} == {r[0]: r[2] for r in rows} | {20: None}
