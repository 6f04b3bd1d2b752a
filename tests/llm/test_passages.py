"""Passages over several chunks: against brute force, the cut into paragraphs, and what is stored."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pyarrow as pa

from linkcurate.llm import passages

_SENTENCE = re.compile(r"[^\s][^.!?\n]*(?:[.!?]++(?!\s|\Z)[^.!?\n]*)*[.!?]*", re.ASCII)
_LINE = re.compile(r"[^\s][^\n]*", re.ASCII)


def test_paragraphs_of_chunk():
    rng = random.Random(3)
    odd = [*"ab.!?\n \t\r", "é", "a.b", "...", " . ", ". ", "\n.", "\x0b", "\x1f", " "]
    texts = [None, "", " \n ", "one. two", "one.", ". a b. c", ". . . x", "? !\n! ?", "a.b c.", "x)." , *("".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(500))]
    chunk = passages._Chunk(pa.table({"chunk": [0] * len(texts), "at": range(len(texts)), "key": range(len(texts)), "text": pa.array(texts, pa.string())}))
    n, first, last = chunk.units
    got = [{True: [], False: []} for _ in texts]
    for i, (a, b) in enumerate(zip(first, last)):
        owner = chunk.text[a]
        assert owner == chunk.text[b - 1]
        got[owner][i < n].append(chunk.data[chunk.starts[a] : chunk.ends[b - 1]].tobytes().decode())
    for text, found in zip(texts, got):
        sentences, lines = ([(a, text[a:b].rstrip(" \t\n\r\x0b\x0c")) for a, b in (x.span() for x in form.finditer(text or ""))] for form in (_SENTENCE, _LINE))
        assert found[True] == [x.lower() for _, x in sentences], text
        assert found[False] == [x.lower() for a, x in lines if (a, x) not in sentences], text


def _made(rng: random.Random) -> list[tuple[int | None, list[str]]]:
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4)) + ("." if rng.random() < 0.07 else "")
    words = lambda n: [word() for _ in range(n)]
    copied, common = [words(rng.randint(40, 90)) for _ in range(12)], words(55)
    made: list[tuple[int | None, list[str]]] = []
    for i in range(90):
        inside = rng.choice(copied)
        made.append((rng.randint(0, 60), [*words(rng.randint(0, 30)), *inside[rng.randint(0, 5) :], *words(rng.randint(1, 20)), *(common if i % 3 == 0 else []), *words(rng.randint(0, 9))]))
    return [*made, (None, made[0][1]), (1000, [])]


def test_passages_against_brute_force(spark):
    made = _made(random.Random(4))
    rows = [(i, k, " ".join(words)) for i, (k, words) in enumerate(made)]
    docs = spark.createDataFrame(rows, "at long, doc_id long, text string").repartition(7, "at")
    found = {}
    for r in passages.repeated_passages(docs).collect():
        found.setdefault(r.doc_id, []).append([(x.start, x.end) for x in r.spans])
    least: dict[tuple, int] = {}
    for k, words in made:
        for i in range(len(words) - 49):
            if k is not None:
                x = tuple(words[i : i + 50])
                least[x] = min(k, least.get(x, k))
    expected = {}
    for (k, words), (_, _, text) in zip(made, rows):
        held = [False] * len(words)
        for i in range(len(words) - 49):
            if k is not None and least[tuple(words[i : i + 50])] < k:
                held[i : i + 50] = [True] * 50
        spans, at = [], 0
        for i, w in enumerate(words):
            if held[i]:
                spans = [*spans[:-1], (spans[-1][0], at + len(w))] if i and held[i - 1] else [*spans, (at, at + len(w))]
            at += len(w) + 1
        expected.setdefault(k, []).append(spans)
    assert sum(map(len, sum(expected.values(), []))) > 40
    # Nothing is missed; words that lie between two such runs, or that others hold next to one, may go too.
    assert found.keys() == expected.keys()
    length = lambda all_spans: sum(b - a for spans in all_spans for a, b in spans)
    for k, wanted in expected.items():
        for mine, spans in zip(sorted(found[k]), sorted(wanted)):
            assert all(any(c <= a and b <= d for c, d in mine) for a, b in spans), k
    assert length(sum(found.values(), [])) <= 1.1 * length(sum(expected.values(), []))


def test_passages_store_little(spark, tmp_path):
    """Tables that stay hold the texts once, and marks of what is shared."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    texts = [". ".join(" ".join(word() for _ in range(20)) for _ in range(25)) for _ in range(300)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, *texts[:100]])], "doc_id long, text string")
    docs.write.option("compression", "zstd").parquet(str(tmp_path / "in"))
    size = lambda at: {p: p.stat().st_size for p in Path(at).rglob("*.parquet")}
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = size(folder)
    found = passages.digest(passages.repeated_passages(spark.read.parquet(str(tmp_path / "in")))).collect()
    assert sum(r.n_spans for r in found) == 100
    stored = sum(n for p, n in size(folder).items() if p not in before)
    assert stored < 2 * sum(size(tmp_path).values())
