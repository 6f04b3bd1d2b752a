"""The factorisation machine against sums over all pairs, its features against plain counts, and its accuracy on held-out rows."""

from __future__ import annotations

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkcurate.llm import quality

DOCS = "doc_id long, text string, n_chars long, lang string, source string, score double, held_out string, key string, label int, id string, x int"


def with_more(rows):
    return [(*r, "en", "s", 9.0, "mine", "k", 7, "i", 1) for r in rows]


def made(rng, n):
    """Good prose, and three kinds of junk."""
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 120))]
        good = rng.random() < 0.7
        kind = rng.randrange(3)
        text = " ".join(words) + ".\n" if good else [" ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[:9] for _ in range(8)), " | ".join(words)][kind]
        rows.append((i, text, len(text)))
        labels.append((i, int(good)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = made(random.Random(3), 600)
    docs, marks = spark.createDataFrame(with_more(rows), DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")
    return docs, marks, dict(labels), quality.fit(docs, marks)


def test_held_out_rows_are_told_apart(fitted):
    docs, _, label, machine = fitted
    got = quality.score(docs, machine).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in label if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, fitted):
    docs, marks, _, machine = fitted
    other = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs.withColumns({"lang": F.lit("de"), "source": F.lit(None).cast("string")}).repartition(3), other)
    assert np.array_equal(again.factors, machine.factors) and again.bias == machine.bias


def test_linear_time_score_equals_all_pairs(fitted):
    machine = fitted[3]
    texts = ["", None, "a b c a", "ÜBER Alles!! " * 30]
    found = quality.counted(texts, machine.buckets)
    statistics = np.array([x.statistics(s) for x, s in zip(found, [None, 3, 7, 400])])
    first, which, value = machine.rows(found, statistics)
    plain = []
    for a, b in zip(first, first[1:]):
        pairs = sum(machine.factors[which[i]] @ machine.factors[which[j]] * value[i] * value[j] for i, j in combinations(range(a, b), 2))
        plain.append(machine.bias + machine.linear[which[a:b]] @ value[a:b] + pairs)
    assert np.allclose(machine.raw(first, which, value), plain)


def test_counts_equal_plain_ones_and_windows_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["", None, "one One two.\n\none\n", "x\n" * 50, " ".join(rng.choice(["a", "bé", "C!", "9,\n"]) for _ in range(4000))]

    def read():
        return quality.counted(texts, 1 << 14)

    whole = read()
    for text, x in zip(texts, whole):
        raw = (text or "").encode()
        lower = raw.decode().translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x20\x09-\x0d]+", lower)
        assert x.words == len(words) == x.counts.sum() and len(x.distinct) == len(set(words))
        assert x.repeated == sum(a == b for a, b in zip(words, words[1:]))
        lines = [t for t in (re.findall(r"[^\x20\x09-\x0d]+", line) for line in lower.split("\n")) if t]
        assert x.n_lines == len(lines) and len(x.lines) == len({tuple(t) for t in lines})
        assert x.kinds[1] == len(re.findall(rb"[A-Z]", raw)) and x.kinds[5] == raw.count(b"\n") and x.kinds.sum() == len(raw)
    monkeypatch.setattr(quality, "_WINDOW", 1000)
    for a, b in zip(whole, read()):
        assert (a.words, a.repeated) == (b.words, b.repeated) and np.array_equal(a.counts, b.counts) and np.array_equal(a.kinds, b.kinds)


def test_nulls_repeats_and_long_texts(spark, fitted):
    rows = [(1, None, None), (1, "", 0), (1, "", 0), (None, "word", 4), (2, "a" * 3_000_000, 5), (3, "W!! " * 1_000_000, -1)]
    got = quality.score(spark.createDataFrame(with_more(rows), DOCS), fitted[3]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and not [r for r in got if r.doc_id is None and r.held_out]
    assert len({r.score for r in got if r.doc_id == 1}) == 2


def test_without_labels_or_rows(spark, fitted):
    docs, marks, _, machine = fitted
    none = quality.fit(docs, marks.where("false"))
    assert none == 0.5 and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.fit(docs, marks.where("quality = 1")) > 0.99
    odd = marks.where("quality = 1").union(spark.createDataFrame([(1, None), (None, 1), (2, 9)], marks.schema))
    assert quality.fit(docs, odd) > 0.99
    assert quality.score(docs.where("false"), machine).collect() == []
    assert quality.fit(docs.where("false"), marks) == 0.5
