"""Every operator against a plain version on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkcurate.llm import (
    components, decontaminate, language, minhash, neighbours, packing, page_text, passages, personal_data, token_counts, token_files,
)
from linkcurate.llm.chunks import Encoder
from linkcurate.llm.common import fresh_path

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, at long, n long, block long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 8))) + rng.choice(["", "", "", ".", ",", "!\n"]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split(" ")
    near = [" ".join(w if i != k else "changed" for i, w in enumerate(words)) for k in (5, 60, 115)]
    odd = ["", " \n\t ", "a", "one two", "One TWO", "x " * 3000, "y" * 50_000, "a<|endoftext|> b  <|endoftext|>", "it's 12 ٣² 日本    z\r\n\x1c q", "é Σ ΑΣ"]
    made = [base, *near, base, base.upper(), *odd, *(prose(rng, rng.randint(1, 300)) for _ in range(20))]
    return [*enumerate(made), (None, "null key"), (None, None), (900, None), (901, base), (901, base)]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 1, "x", 5, 6, 7) for k, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(path: str, text: str | None) -> list[int]:
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def as_sorted(found) -> list[tuple]:
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_chunks_give_the_ids_of_the_library():
    rng = random.Random(1)
    letters = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "\x85", " ", "　", "\x1c", "'s", "1", "²", "Ⅷ", "!", "<|endoftext|>", "日", "Σ", "​", "\x00", "😀", "İ"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["w " * 2_000_000]
    for path in (BYTES, WORDS):
        encoder, whole = Encoder(path, keep=50), Tokenizer.from_file(path)
        for text in made:
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, rows, empty):
    for block in (1 << 25, 1):
        got = token_counts.count_tokens(docs, BYTES, limit=300, block_chars=block).collect()
        want = [(k, len((t or "").encode()), n, n > 300) for k, t in rows for n in [len(ids(BYTES, t))]]
        assert as_sorted(got) == as_sorted(want)
    assert token_counts.count_tokens(empty, BYTES).count() == 0


def test_token_files(spark, docs, rows, empty):
    folder = fresh_path(spark, "files")
    manifest = token_files.write_files(docs, WORDS, folder, file_ids=500)
    assert manifest.count() > 2
    got = token_files.read_files(manifest, folder).collect()
    whole = {(k, t): ids(WORDS, t) + [1] for k, t in rows}
    assert sorted((r.key is not None, r.key or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((k is not None, k or 0, whole[k, t]) for k, t in rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids) // 4, zlib.crc32(r.ids))
        start += r.n_tokens
    assert [r.key for r in sorted(got, key=lambda r: r.start)] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert token_files.read_files(token_files.write_files(empty, WORDS, fresh_path(spark, "files")), folder).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 1000])
def test_variable_length_coding(n):
    values = (np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64) >> np.arange(n, dtype=np.uint64) % np.uint64(32)).astype("<u4")
    control, data = token_files.encode(values)
    assert token_files.decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n).tolist() == values.tolist()


def test_packing(docs, rows, empty):
    got = packing.pack(docs, BYTES, capacity=64).collect()
    want = []
    for k, t in rows:
        whole = ids(BYTES, t) + [2]
        edges = [0, *range(len(whole) % 64 or 64, len(whole) + 1, 64)]
        want += [(k, i, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert as_sorted(r[:5] for r in got) == as_sorted(want)
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 64
    gaps: list[int] = []  # best-fit decreasing, one piece after the other
    for n in sorted((r[3] for r in want), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(64 - n)
    assert len(held) == len(gaps)
    assert packing.pack(empty, BYTES).count() == 0


def shingles(text: str | None, n: int) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_near_duplicates(docs, rows, empty):
    sets = [shingles(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    want = [(k, len(s), least[find(i)], k is not None and k == least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))]
    assert as_sorted(minhash.near_duplicates(docs, words=4).collect()) == as_sorted(want)
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near: dict[int, set] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in got:
        seen, todo = {node}, [node]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[node] == min(seen)
    assert set(got) == {a for a, b in links if a != b} | {b for a, b in links if a != b}


def test_decontamination(spark, docs, rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    base = rows[0][1].split(" ")
    items = [(1, " ".join(base[10:40])), (10, "one TWO!"), (2, None), (3, " ... "), (None, "a"), (4, "x x x x x x x x x x x x x x"), (2, "not there at all, ever, in any of these documents or so it seems here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for k, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(13, len(b))
            for i in range(len(w) - n + 1) if n else []:
                if any(w[i : i + n] == b[j : j + n] for j in range(len(b) - n + 1)):
                    hit |= set(range(i, i + n))
                    found |= {str(item)} - {"None"}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((k, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    for bound in (32 << 20, 60):
        got = decontaminate.digest(decontaminate.scan(docs, bench, broadcast_bytes=bound))
        assert as_sorted(got.collect()) == as_sorted(want)
        clean = decontaminate.clean_documents(docs, bench, broadcast_bytes=bound)
        assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
    none = decontaminate.digest(decontaminate.scan(docs, bench.limit(0)))
    assert none.where("contaminated OR n_hit > 0").count() == 0


PRIVATE = [
    "", None, "no data here", "mail a.b@c.org, x@y and q@r.s_t@u.v.w!", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 010.0.0.255", "4111 1111 1111 1111 x 4111-1111-1111-1112 4111  1111",
    "call +1 (274) 555-9629. +12 34 +1234567890123456", "é日 +44 20 7946 0958 z@é.de a@b.c", "\n".join(f"u{i}@host{i}.org 10.0.0.{i % 300}" for i in range(400)), "a" * 30_000 + "@b.c", "1" * 30_000, "+1" + " " * 20_000,
]


def plain_spans(text: str | None) -> list[tuple[int, int, int]]:
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    size = lambda v: len(re.sub(r"\D", "", v))
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= size(v) <= 19 and luhn(re.sub(r"\D", "", v))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= size(v) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0]))


def test_personal_data(spark):
    more = {
        "write to anna12 (at) mail.example.org today": "email", "contact: li07 [at] uni-x dot de now": "email", "call me: 274-555-9629 soon": "phone", "tel (274) 555-9629 thanks": "phone",
        "login from 10[.]0[.]12[.]7 seen": "ip", "we look at the dot plot today": None, "since 2024-05-12 it is": None, "ISBN 978-3-16-148410-0": None,
    }
    rows = list(enumerate([*PRIVATE, *more]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in personal_data.digest(personal_data.find(docs)).collect()}
    for i, t in rows:
        base = plain_spans(t)
        written = [f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert got[i].base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest(), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert set(written) <= set(got[i].spans.split(",")) | {""}
        if t in more:
            assert {x.split(":")[0] for x in got[i].spans.split(",") if x} == {more[t]} - {None}, (t, got[i].spans)
    clean = personal_data.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[0] == "" and text[1] is None and text[3] == "mail [email], x@y and [email]_t@u.v.w!".replace("_t@u.v.w", text[3][text[3].index("[email]", 8) + 7 : -1])
    assert "[phone]" in text[6] and not plain_spans(text[8])


def test_redact_many_spans_inside_one(spark):
    ips = "1.2.3.4." * 20
    rows = [(0, f"to a@{ips}secret-host.example.org or 10.0.0.1"), (1, f"to a@{ips}x.example.org, b@{ips}y.example.org"), (2, "10.0.0.1 " * 100)]
    got = {r.doc_id: r.text for r in personal_data.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "to [email] or [ip]", 1: "to [email], [email]", 2: "[ip] " * 100}


def test_passages(spark, empty):
    rng = random.Random(9)
    sentence = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(7))
    near = sentence(60)
    made = [
        (3, f"{sentence(5)} {passage}\n{sentence(20)}"), (1, f"{sentence(8)}\n{passage}"), (2, f"{passage} {sentence(3)}"), (4, sentence(80)), (5, passage[:200]), (6, None), (None, passage), (7, ""),
        (8, f"{sentence(4)} {near}"), (9, near.replace(near.split()[30], "other")), (10, " ".join([sentence(4)] * 30)), (2, f"{passage} {sentence(3)}"),
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t in made], "doc_id long, text string, at string")
    got = sorted((r.doc_id, tuple(tuple(x) for x in r.spans)) for r in passages.repeated_passages(docs).collect() if r.spans)
    at = lambda t, x: ((t.index(x), t.index(x) + len(x)),)
    second = made[9][1]
    assert got == [(2, at(made[2][1], passage)), (2, at(made[2][1], passage)), (3, at(made[0][1], passage)), (9, ((0, len(second)),))]
    cut = passages.without_passages(docs.where("doc_id = 3"), passages.repeated_passages(docs)).first().text
    assert cut == made[0][1].replace(passage, "")
    assert passages.repeated_passages(empty).count() == 0


def test_passages_inside_sentences(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(5))
    words = lambda n: [word() for _ in range(n)]
    inside, short, long = words(51), words(49), words(70)
    tail = [w + "." if i % 8 == 7 else w for i, w in enumerate(words(64))]  # one line of short sentences
    changed = [*tail[:20], "other", *tail[21:]]
    edited = [*long[:33], "new", *long[34:]]
    made = [
        (0, words(9) + inside + words(9)), (1, words(6) + long + words(20)), (2, tail), (3, words(30) + short + words(5)),
        (4, words(7) + inside + words(12)), (5, words(3) + edited + words(4)), (6, changed), (7, words(8) + short + words(8)), (8, inside[:25] + words(1) + inside[40:]),
    ]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in made], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    texts = {k: " ".join(t) for k, t in made}
    got = {k: [texts[k][a:b] for a, b in r.spans] for k, r in found.items() if r.spans}
    assert got == {4: [" ".join(inside)], 5: [" ".join(edited)], 6: [" ".join(changed)]}
    assert {k: found[k].n_words for k in got} == {4: 51, 5: 70, 6: 64}


def test_page_text_of_embedded_elements():
    page = "<p>area <math><mi>a</mi><mo>=</mo><mn>7</mn></math> holds<object>plain words</object></p><noscript><p>fallback</p></noscript><svg><text>drawn</text></svg><textarea>typed</textarea><p>next<template>x</template>"
    assert [x[1] for x in page_text.blocks(page)] == ["area a=7 holdsplain words", "fallback", "drawn", "next"]
    for tag in ("iframe", "object", "canvas", "svg", "math", "noscript", "textarea", "template"):
        assert [x[1] for x in page_text.blocks(f"<p>one</p><{tag}><p>two</p>")] == ["one", "two"], tag
    assert [x[1] for x in page_text.blocks("<p>one</p><script><p>two</p>")] == ["one"]


def test_more_than_fifty_languages(spark):
    rng = random.Random(5)
    names = [f"l{i:02}" for i in range(60)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for x in names}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x, "one.host") for i, x in enumerate([*names[:50] * 3, *names[50:] * 2])]
    docs = spark.createDataFrame([*rows, (900, " ".join(words["l59"]), None, "one.host")], "doc_id long, text string, lang string, source string")
    model = language.fit_text_model(docs)
    assert model.languages == names
    got = {r.doc_id: r.language for r in language.identify(docs, model).collect()}
    assert got == {**{r[0]: r[2] for r in rows}, 900: "l59"}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    vectors = (centres[rng.integers(30, size=3000)] + 0.3 * rng.standard_normal((3000, 16))).astype(np.float32)
    vectors[100:700] = vectors[0]  # a large group of equal vectors
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(3000, None, "x"), (3100, [0.0] * 16, "x"), (3200, [float("nan")] * 16, "x"), (3300, [1.0] * 3, "x"), (3400, [None] * 16, "x"), (None, [1.0] * 16, "x"), rows[5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got: dict[int, list] = {}
    for r in neighbours.search(table, F.col("vec_id") % 100 == 0, sample_rows=500, block_rows=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    x, met = vectors.astype(float), 0
    for q, found in got.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        want = np.lexsort((np.arange(3000), far))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and np.allclose([s for _, _, s in found], [far[v] for _, v, _ in found], atol=1e-12)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        met += len({v for _, v, _ in found} & set(want.tolist()))
    assert met >= 0.95 * 10 * len(got)
    assert [v for _, v, _ in sorted(got[100])] == [0, *range(101, 110)]
    few = neighbours.search(table.where("vec_id < 5"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank) for r in sorted(few)] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert neighbours.search(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_page_text(spark):
    page = (
        '<html><head><title>T</title><script>var x="</p><p>no"</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy this now</div>'
        "<article><h1>Title &amp; more</h1><p>First   paragraph\n of <b>bold</b>ness &#233;&nbsp;x.<br>Next line here.<p>Second one &lt;b&gt; that is a bit longer than the first one was.</article>"
        '<div class="comments"><div class="comment"><p>Nice post!</p></div></div><footer>&copy; example.org</footer></body></html>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (4, "u", "<p" * 2000), (5, "u", "plain words"), (None, "u", page), (1, "u", page)]
    got = page_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    want = "Title & more\nFirst paragraph of boldness é x. Next line here.\nSecond one <b> that is a bit longer than the first one was."
    assert [r.text for r in got if r.page_id in (1, None)] == [want] * 3
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)
    assert {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_text_on_held_out_pages():
    made = [page_text.labelled(page_text._made_page(np.random.default_rng([99, i]))) for i in range(150)]
    made = [x for x in made if x[0]]
    scores = page_text.Labeller.of().scores(page_text.vectors([x[0] for x in made]))
    assert np.mean(np.concatenate([(s >= 0.5) == x[1] for s, x in zip(scores, made)])) > 0.99


def test_language(spark, empty):
    rng = random.Random(2)
    sounds = {"en": ["the", "ing", "and", "wh"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "oi", "ère", "que"]}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(lang, 40), lang, f"www.site{i % 4}.{lang}") for i in range(60) for lang in [rng.choice(list(sounds))]]
    rows += [(100, None, "en", "a.de"), (101, "", None, None), (102, "12 34 !!", "fr", "a.fr"), (103, say("de", 30), None, None), (104, say("fr", 60), "en", "www.site1.en"), (105, "", "xx", "a.b"), (None, say("en", 30), "en", "x.en"), (1, say("en", 30), "en", "x.en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, language string")
    model = language.fit_text_model(docs, languages=3)
    assert model.languages == ["de", "en", "fr"]
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    true = {r[0]: r[2] for r in rows[:60]}
    assert all(r.language == true[r.doc_id] for r in got if r.doc_id in true and r.doc_id != 1)
    by = {r.doc_id: r for r in got}
    assert all((by[i].language, by[i].posterior, by[i].identified) == (None, 0.0, False) for i in (100, 101, 102, 105))
    assert by[103].language == "de" and by[104].language == "fr"
    # Short text that says nothing: host and declaration decide.
    unclear = spark.createDataFrame([(1, "zz", "de", "www.site1.de")], "doc_id long, text string, lang string, source string")
    assert language.identify(unclear.union(docs.select("doc_id", "text", "lang", "source")), model).where("doc_id = 1 AND text = 'zz'").first().language == "de"
    assert language.identify(empty, language.fit_text_model(empty)).count() == 0
    page = language.page_evidence(spark.createDataFrame([("https://u@a.Example.de:80/x", "<html lang='de-AT'><style>p{}</style><p>Hallo</p>"), (None, None)], "url string, html string")).collect()
    assert (page[0].lang, page[0].host, page[0].text.split()) == ("de", "a.example.de", ["Hallo"]) and (page[1].lang, page[1].host) == ("", "")
