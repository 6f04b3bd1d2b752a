import random
import re
import string

import pytest
from pyspark.sql import functions as F

from linkcurate.functions import html, text, urls
from linkcurate.rules import CATEGORY_PATTERNS, LOGIN_PATTERNS, PROMO_PATTERNS, check_pattern


def test_safe_file_name(one):
    assert one(text.safe_file_name, "My Title: A Guide / How-To? *Awesome*") == "My Title A Guide How-To Awesome"
    assert one(text.safe_file_name, "   ") == "untitled_note"
    long = one(lambda c: text.safe_file_name(c, 50), "A " * 60)
    assert len(long) <= 50
    # The last piece goes even when the cut falls on the end of a word.
    assert one(lambda c: text.safe_file_name(c, 9), "alpha bet gamma") == "alpha"
    assert one(text.safe_file_name, "x" * 90) == "x" * 80
    assert one(text.safe_file_name, "snake_case__name wide") == "snake case name wide"


def test_extract_urls(one):
    message = (
        "See https://code.example.org/a/b, and https://x.com/u/status/1! "
        "Again https://code.example.org/a/b. Then https://a.com?q=1 and (https://b.org/w_(z))"
    )
    assert one(urls.extract_urls, message) == [
        "https://code.example.org/a/b", "https://x.com/u/status/1", "https://a.com", "https://b.org/w_",
    ]
    assert one(urls.extract_urls, "", None, "no link http:// https://nodot") == [[], [], []]
    assert one(urls.extract_urls, "HTTPS://Example.COM:8080/x y") == ["HTTPS://Example.COM:8080/x"]


def test_extract_urls_equals_the_plain_pattern(one):
    plain = re.compile(r"""https?://(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?::\d+)?(?:/[^\s<>'"`()]*)?""", re.I)
    rng = random.Random(2)
    parts = ["http://", "https://", "a", "b-c", ".", "..", "com", "org", "1", ":80", "/x", "/", " ", ",", "?q=1", "é", "("]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 24))) for _ in range(3000)]
    texts += ["https://" + "a." * 200 + "org/x", "http://a..b.com/x,http://c.org/y", "http://end.org.. "]
    want = [list(dict.fromkeys(u.rstrip(".,!?:;)") for u in plain.findall(t))) for t in texts]
    assert one(urls.extract_urls, *texts) == want


def test_extract_urls_survives_long_hosts(one):
    assert one(urls.extract_urls, "https://" + "a." * 20000 + "1 end") == []
    assert one(urls.extract_urls, "https://a.com" + "/seg" * 50000)[0].endswith("/seg")


def test_routes(one):
    links = ["https://netflix.com/a", "https://www.YouTube.com/x", "https://github.com/a/b", "https://example.org", "not a link"]
    assert one(urls.source_type, *links) == ["x", "youtube", "github", "web", "web"]
    assert one(lambda c: urls.source_type(c, strict=True), *links) == ["web", "youtube", "github", "web", "web"]
    assert one(lambda c: urls.source_type(c, force_visual=True), links[2]) == "web"
    assert one(urls.effective_source, "https://youtube.com/abc", "https://arxiv.org/list/cs", "https://github.com/only") == ["web"] * 3


def test_ids(one):
    assert one(urls.video_id, "https://youtu.be/bkFnPiMHzcE?si=test123") == "bkFnPiMHzcE"
    assert one(urls.video_id, "https://youtube.com/channelpathwithmany") == "channelpath"
    assert one(urls.paper_id, "https://arxiv.org/pdf/2405.12345v2", "https://arxiv.org/abs/x") == ["2405.12345v2", None]
    assert one(urls.repository, "https://github.com/o/r/tree/main?x=1", "https://github.com/o") == ["o/r", None]
    assert one(urls.readme_candidates, "https://github.com/o/r")[2] == "https://raw.githubusercontent.com/o/r/master/README.md"
    assert one(urls.path, "https://h.org/a;p/b;q=1?x#y", "https://h.org") == ["/a;p/b", ""]
    assert one(urls.slug, "https://h.org/a/b c", "https://h.org") == ["a b c", "page"]


def test_clean_transcript(one):
    raw = "[snorts] [music] >> Hello world! This is a a test. [applause] >> We discuss AI."
    assert one(text.clean_transcript, raw) == "Hello world! This is a test. We discuss AI."
    assert one(text.clean_transcript, "The the THE end", "слово Слово да", None) == ["The end", "слово да", ""]
    assert one(text.clean_transcript, "a  b\n \n\n\nc [Music playing]") == "a b\n\nc"


@pytest.mark.parametrize("repeats", [99, 100, 101, 202, 2_000, 100_000])
def test_stutters_of_any_length(one, repeats):
    assert one(text.fold_stutters, "so " + "word " * repeats + "end") == "so word end"


def test_stutters_equal_the_unbounded_pattern(one):
    rng = random.Random(7)
    plain = re.compile(r"\b([a-zA-Zа-яА-ЯіїєґІЇЄҐ]+)(?:\s+\1\b)+", re.IGNORECASE)
    texts = [
        "".join(rng.choice(["a", "A", "b", "ab", "é", "1", "_", "да", "Да", " ", "  ", "\n", "-", "'"]) for _ in range(60))
        for _ in range(300)
    ]
    assert one(text.fold_stutters, *texts) == [plain.sub(r"\1", t) for t in texts]


def test_clean_promo(one):
    raw = (
        "Here is the architectural review. З питань реклами: @promo_bot. Don't forget to like and subscribe! Final conclusions."
    )
    clean = one(text.clean_promo, raw)
    assert clean == "Here is the architectural review. Final conclusions."
    assert one(text.clean_promo, "Так. ПІДПИСУЙТЕСЬ на наш канал! ставьте лайки и дальше. Конец", "Ссылка в описании тут. Да") == [
        "Так. Конец", "Да",
    ]
    assert one(text.clean_promo, None, "  plain\t text ") == ["", "plain text"]


def test_stutters_equal_the_plain_rule(one):
    word = "[a-zA-Zа-яА-ЯіїєґІЇЄҐ]"
    plain = re.compile(rf"\b({word}+)(?:\s+\1\b)+", re.I)
    rng = random.Random(4)
    parts = ["a", "A", "the", "The", "ї", "Ї", " ", "  ", "\n", "-", "1", "é", "ſ", "s", "."]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(2, 20))) for _ in range(2000)]
    texts += ["Word " * 100_000 + "WORD end", "so SO so. so", ""]
    assert one(text.fold_stutters, *texts) == [plain.sub(r"\1", t) for t in texts]


def test_gates_never_hide_a_match(one):
    rng = random.Random(3)
    patterns = [p for ps in CATEGORY_PATTERNS.values() for p in ps] + LOGIN_PATTERNS + PROMO_PATTERNS
    words = [w for p in patterns for w in re.findall(r"[\w+&-]+(?:\\s[+*][\w&-]+)*", p.replace("\\b", " "))]
    words = [re.sub(r"\\s[+*]", rng.choice([" ", "  ", "\n"]), w) for w in words] + ["engineer$5", "engineer 9", "fullstack qa", "agents"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "s", ".", "-x", "é"]) for _ in range(12)) for _ in range(150)]
    texts += [t.upper() for t in texts[:40]] + ["ſign in", "loKal sıgn İn"]

    def hits(c):
        return text.gated(text.fold_case(c), patterns, lambda gates: F.array(*gates))

    for t, gates in zip(texts, one(hits, *texts), strict=True):
        for pattern, gate in zip(patterns, gates, strict=True):
            assert gate or not re.search(pattern, t, re.IGNORECASE), (pattern, t)


def test_pattern_guard():
    with pytest.raises(ValueError):
        check_pattern(r"(?:\s+\w)+")
    with pytest.raises(ValueError):
        check_pattern(r"(a|b){2,}")
    assert check_pattern(r"[)]+(?:a){1,5}") == r"[)]+(?:a){1,5}"


def test_strip_matches_python(one):
    texts = [c + "x y" + c for c in text.SPACES] + ["", "​x"]
    assert one(text.strip, *texts) == [t.strip() for t in texts]
    assert set(text.SPACES) == {chr(i) for i in range(0x3100) if chr(i).isspace()}
    assert all(c in text.SPACES for c in string.whitespace)


def test_pages(one):
    page = (
        "<html><head><title>A &amp; B&#33;</title></head><body><!-- c --><nav>menu</nav><div class='my cookie-bar'>x</div>"
        "<div id='layers-1'>y</div><section class='popup big'>z</section><p>Hi &lt;b&gt; &#x41;&#1076;&#99999999;<br>there</p>"
        "<script>1<2</script><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    )
    assert one(html.page_title, page, "<p>no title</p>") == ["A & B!", "Article Note"]
    # A cell adds a blank; squeezing keeps a single blank at the start of a line.
    assert one(html.main_text, page) == "Hi <b> Aд\ufffd\nthere\n\n a b"
