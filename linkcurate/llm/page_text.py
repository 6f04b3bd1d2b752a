"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of text blocks. Each block has a vector of its tag path (tags, classes, ids and roles, hashed), of its
words (hashed) and of its form; a bidirectional LSTM in numpy reads the sequence, so every block is classed in view of the
whole page. Blocks classed as article text are joined by line feeds.

The labeller is trained on pages made here (`_made_page`): articles in many layouts among menus, headers, footers, sidebars,
notices, adverts, forms and comments, with tags left open as pages on the web have them. No table is read for it.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcurate.llm.common import once
from linkcurate.llm.hashing import NOT_BLANK, hashed_words

_BLOCKS = frozenset(
    "html head body title address article aside blockquote button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNREAD = frozenset("script style template textarea".split())
#: A new one of these ends an open one of the same kind in the nearest container.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CONTAINERS = frozenset("article aside blockquote body dl div fieldset figure footer form header main nav ol section table ul tr".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>")
_START = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_BARE = re.compile(r"[^>\"']*+")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PATH, _WORDS, _FORM, _HIDDEN = 192, 12, 7, 16
#: A block is described by this many names of its nearest elements and their classes.
_DEPTH = 64


class _Markup:
    """The tags of a page from left to right, in time linear in the page whatever it holds.

    A tag ends at the first `>` outside quotes, or, where a quote is never closed, at the first `>`; without one `<` is text.
    Comments and declarations have no name; a comment that is not closed takes the rest.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.open: set[int] | None = None  # quotes from which no tag ends; None until one is met

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name, whether it is an end tag, and attributes of the next tag."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", False, ""
            if at > self.last:
                at = page.find("<!--", at)
                if at < 0:
                    return None
                continue
            if page.startswith(("<!", "<?"), at):
                return at, page.find(">", at) + 1, "", False, ""
            found = _START.match(page, at)
            if found:
                whole = _TAG.match(page, at) if self.open is None else None
                end = whole.end() if whole else self._end(found.end())
                return at, end, found[2].lower(), bool(found[1]), page[found.end() : end - 1]
            at += 1
        return None

    def _end(self, at: int) -> int:
        page, first, met = self.page, at, []
        self.open = set() if self.open is None else self.open
        while at < len(page):
            at = _BARE.match(page, at).end()
            if page.startswith(">", at):
                return at + 1
            if at in self.open or at == len(page):
                break
            met.append(at)
            at = page.find(page[at], at + 1) + 1
            if not at:
                break
        self.open.update(met)
        return page.find(">", first) + 1


class _Open:
    """The open elements, with the places of every name, so that none is sought by walking up."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths: list[tuple[str, ...]] = []
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def push(self, name: str, path: tuple[str, ...]) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in _CONTAINERS:
            self.containers.append(len(self.names))
        self.names.append(name)
        self.paths.append(path)

    def cut(self, at: int) -> None:
        while len(self.names) > at:
            self.places[self.names.pop()].pop()
            self.paths.pop()
        while self.containers and self.containers[-1] >= at:
            self.containers.pop()

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def container(self) -> int:
        return self.containers[-1] if self.containers else -1

    def end(self, name: str) -> None:
        """An end tag closes its element; of inline ones only within the nearest container."""
        at = self.last(name)
        if at >= 0 and (name in _BLOCKS or self.container() <= at):
            self.cut(at)

    def begin(self, name: str) -> None:
        """The start of a block ends its like in the nearest container, and an open paragraph."""
        at = max(self.last(x) for x in _ENDS.get(name, set()) | {"p"})
        if at >= 0 and at >= self.container():
            self.cut(at)

    def path(self) -> tuple[str, ...]:
        return tuple(x for names in self.paths[-_DEPTH:] for x in names)[-_DEPTH:]


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, float, int]]:
    """Path, text, share of text in links, and level of every block that has text, in page order.

    Character references are decoded, white space is one space; scripts, styles, templates, text fields
    and comments hold no text. A template or field that is not closed is read like any other element.
    Time is linear in the page, with tags, quotes, elements and comments left open as well.
    """
    page = page or ""
    markup, open_ = _Markup(page), _Open()
    out: list[tuple[tuple[str, ...], str, float, int]] = []
    text: list[str] = []
    linked = at = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((open_.path(), whole, min(1.0, linked / len(whole)), len(open_.names)))
        text.clear()
        linked = 0

    def read(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = html.unescape(piece)
        text.append(piece)
        if "a" in open_.names[-4:]:
            linked += len(piece.strip())

    while True:
        found = markup.next(at)
        if not found:
            read(page[at:])
            break
        start, end, name, ending, attributes = found
        if start > at:
            read(page[at:start])
        at = end
        if not name:
            continue
        if ending:
            if name in _BLOCKS:
                flush()
            open_.end(name)
            continue
        if name in _UNREAD:
            if not attributes.endswith("/") and name not in unclosed:
                close = _closing(name).search(page, at, markup.last + 1)
                if close:
                    at = close.end()
                elif name in ("script", "style"):
                    at = len(page)
                else:
                    unclosed.add(name)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCKS:
            flush()
            if name not in ("html", "head", "body"):
                open_.begin(name)
        if name not in _VOID and not (attributes.endswith("/") and name not in _BLOCKS):
            open_.push(name, (name, *_named(attributes)))
    flush()
    return out


@lru_cache(64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)


@lru_cache(20_000)
def _named(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(f".{word}" for found in _NAMES.finditer(attributes) for word in re.split(r"[\s_-]+|(?<=[a-z])(?=[A-Z])", found[1] or found[2] or found[3] or "") for word in [word.lower()] if word)


@lru_cache(20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(_PATH)
    for i, x in enumerate(reversed(path)):
        at = zlib.crc32(x.encode())
        out[at % _PATH] += (1 if at >> 16 & 1 else -1) * max(0.5, 1 - i / 10)
    return out


def vectors(page_blocks: list[list[tuple]]) -> list[np.ndarray]:
    """One row per block for each page."""
    every = [b for page in page_blocks for b in page]
    if not every:
        return [np.zeros((0, _PATH + _WORDS + _FORM)) for _ in page_blocks]
    _, _, _, hashes, first = hashed_words([b[1].encode("utf-8", "surrogatepass") for b in every], NOT_BLANK)
    n = np.diff(first)
    counts = np.bincount(np.repeat(np.arange(len(every)), n) * _WORDS + (hashes[first[0] :] % np.uint64(_WORDS)).astype(np.int64), minlength=len(every) * _WORDS)
    counts = counts.reshape(-1, _WORDS) / np.sqrt(np.maximum(n, 1))[:, None]
    form = np.array([[np.log1p(len(t)) / 8, np.log1p(k) / 6, link, min(level, 30) / 10, t[-1] in ".!?:;", t[0].isupper(), "©" in t] for (_, t, link, level), k in zip(every, n)], float)
    whole = np.concatenate([np.stack([_path_vector(b[0]) for b in every]), counts, form], axis=1)
    return np.split(whole, np.cumsum([len(x) for x in page_blocks])[:-1])


class Labeller:
    """Two LSTMs, one in each direction, and a logistic output on both states."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        size = _PATH + _WORDS + _FORM
        self.weights: dict[str, np.ndarray] = {}
        for way in "fb":
            self.weights[f"x{way}"] = rng.standard_normal((size, 4 * _HIDDEN)) / np.sqrt(size)
            self.weights[f"h{way}"] = rng.standard_normal((_HIDDEN, 4 * _HIDDEN)) / np.sqrt(_HIDDEN)
            self.weights[f"b{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], _HIDDEN)
        self.weights |= {"out": rng.standard_normal(2 * _HIDDEN) * 0.1, "bias": np.zeros(1)}

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        """States for x (steps, pages, size); a page's state stays as it is at steps beyond its blocks."""
        steps, n, _ = x.shape
        gates = x @ self.weights[f"x{way}"] + self.weights[f"b{way}"]
        h, c = np.zeros((n, _HIDDEN)), np.zeros((n, _HIDDEN))
        out, held = np.zeros((steps, n, _HIDDEN)), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = gates[t] + h @ self.weights[f"h{way}"]
            i, f, o = (1 / (1 + np.exp(-np.clip(g[:, k * _HIDDEN : (k + 1) * _HIDDEN], -30, 30))) for k in (0, 1, 2))
            u = np.tanh(g[:, 3 * _HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            tan = np.tanh(new)
            if keep:
                held.append((t, i, f, o, u, c, h, tan, m))
            c, h = np.where(m, new, c), np.where(m, o * tan, h)
            out[t] = h
        return out, held

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of article text per block; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            group = [order.pop()]
            while order and (len(group) + 1) * len(pages[group[0]]) <= 8192 and len(group) < 256:
                group.append(order.pop())
            x, mask = self._padded([pages[i] for i in group])
            both = np.concatenate([self._run(x, mask, way, False)[0] for way in "fb"], axis=2)
            p = 1 / (1 + np.exp(-(both @ self.weights["out"] + self.weights["bias"])))
            for k, i in enumerate(group):
                out[i] = p[: len(pages[i]), k]
        return out

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), pages[0].shape[1])), np.zeros((steps, len(pages)), bool)
        for k, page in enumerate(pages):
            x[: len(page), k], mask[: len(page), k] = page, True
        return x, mask

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, rate: float = 0.01, seed: int = 3) -> None:
        rng, t = np.random.default_rng(seed), 0
        moment = {k: (np.zeros_like(w), np.zeros_like(w)) for k, w in self.weights.items()}
        by_length = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [by_length[i : i + 24] for i in range(0, len(by_length), 24)]
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                x, mask = self._padded([pages[i] for i in groups[g]])
                y = np.zeros(mask.shape)
                for k, i in enumerate(groups[g]):
                    y[: len(labels[i]), k] = labels[i]
                grads, t = self._gradients(x, mask, y), t + 1
                for k, d in grads.items():
                    d = np.clip(d, -1, 1)
                    m, v = moment[k]
                    m *= 0.9
                    m += 0.1 * d
                    v *= 0.999
                    v += 0.001 * d * d
                    self.weights[k] = self.weights[k] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {way: self._run(x, mask, way, True) for way in "fb"}
        both = np.concatenate([runs[way][0] for way in "fb"], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.weights["out"] + self.weights["bias"])))
        d = np.where(mask, p - y, 0) / mask.sum()
        grads = {"out": np.einsum("tn,tnk->k", d, both), "bias": np.array([d.sum()])}
        back = d[:, :, None] * self.weights["out"]
        for k, way in enumerate("fb"):
            own = back[:, :, k * _HIDDEN : (k + 1) * _HIDDEN]
            dh, dc = np.zeros_like(own[0]), np.zeros_like(own[0])
            dx, dwh = np.zeros((*x.shape[:2], 4 * _HIDDEN)), np.zeros_like(self.weights[f"h{way}"])
            for step, i, f, o, u, c, h, tan, m in reversed(runs[way][1]):
                dh = dh + own[step]
                dnew = np.where(m, dc + dh * o * (1 - tan**2), 0)
                gate = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), np.where(m, dh * tan * o * (1 - o), 0), dnew * i * (1 - u**2)], axis=1)
                dx[step] = gate
                dwh += h.T @ gate
                dh, dc = np.where(m, 0, dh) + gate @ self.weights[f"h{way}"].T, np.where(m, dnew * f, dc)
            grads |= {f"x{way}": np.einsum("tns,tng->sg", x, dx), f"h{way}": dwh, f"b{way}": dx.sum(axis=(0, 1))}
        return grads

    @staticmethod
    def of(pages: int = 900, epochs: int = 16, seed: int = 11) -> Labeller:
        """Trained once per process."""
        def make() -> Labeller:
            made = [labelled(_made_page(np.random.default_rng([seed, i]))) for i in range(pages)]
            made = [x for x in made if x[0]]
            model = Labeller(seed)
            model.train(vectors([x[0] for x in made]), [x[1] for x in made], epochs)
            return model

        return once(("labeller", pages, epochs, seed), make)


_TEXT, _REST = "\ue000", "\ue001"


def labelled(page: str) -> tuple[list[tuple], np.ndarray]:
    """Blocks of a made page and whether each is article text, by the mark at the front of each text."""
    found = blocks(page)
    clean = [(path, text.replace(_TEXT, "").replace(_REST, "").strip(), link, level) for path, text, link, level in found]
    labels = [float(_TEXT in b[1]) for b in found]
    some = [i for i, b in enumerate(clean) if b[1]]
    return [clean[i] for i in some], np.array([labels[i] for i in some])


def _made_page(rng: np.random.Generator) -> str:
    """A page in a random layout; every text starts with a mark of what it is."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    maybe = lambda p: rng.random() < p

    def words(n: int) -> str:
        made = "".join(chr(97 + c) for c in rng.integers(0, 26, 9 * n))
        out, i = [], 0
        for k in rng.integers(1, 10, n):
            out.append(made[i : i + k])
            i += k
        for k in range(int(n * pick(0, 0, 0, 0.1, 0.4))):
            out[k * 7 % n] = pick(str(rng.integers(10**6)), f"{out[0]}.{k}@mail.example.com", "+1 (555) 010-0199", "10.1.2.3", "$$$", "2024", "###")
        return pick(" ", " ", " ", " | ", "!! ").join(out).capitalize() + pick(".", ".", ".", ",", "", "&amp;")

    def rest(*known: str, most: int = 25) -> str:
        return _REST + (pick(*known) if maybe(0.5) and known else words(int(rng.integers(1, most))))

    def inside(tag: str, body: str, *names: str, open_end: float = 0.0) -> str:
        kind = pick("class", "class", "id")
        name = f' {kind}="{pick(*names)}"' if names else ""
        return f"<{tag}{name}>{body}" + ("" if maybe(open_end) else f"</{tag}>")

    def links(n: int) -> str:
        made = [f'<a href="/{i}">{rest("Home", "News", "About", "Sport", most=4)}</a>' for i in range(n)]
        return inside("ul", "".join(f"<li>{x}</li>" for x in made)) if maybe(0.7) else pick("", " | ").join(made)

    def menu() -> str:
        return inside("nav", links(int(rng.integers(1, 9)))) if maybe(0.6) else inside("div", links(int(rng.integers(1, 9))), "menu", "navbar", "nav", "breadcrumb", "breadcrumbs", "main-menu", "toc")

    def advert() -> str:
        return inside(pick("div", "div", "aside", "section", "p"), rest("Buy now", "Advertisement", "Sponsored", most=60), "ad", "ads", "advert", "ad-box", "advertisement", "sponsor", "sponsored", "promo", "banner")

    def notice() -> str:
        return inside(pick("div", "section"), f"<p>{rest('We use cookies', 'Accept all cookies', most=40)}</p><button>{rest('OK', 'Accept')}</button>", "cookie", "cookie-banner", "consent", "notice", "popup", "gdpr", "newsletter", "alert")

    def form() -> str:
        return f"<form{pick('', ' class=\"search\"', ' id=\"login\"')}><label>{rest('E-mail', 'Name', 'Search')}</label><input name=q><select><option>{rest('one')}<option>{rest('two')}</select><button>{rest('Send', 'Subscribe', 'Search')}</button></form>"

    def sidebar() -> str:
        return inside(pick("aside", "div", "section"), f"<h3>{rest('Related', 'Most read')}</h3>" + links(int(rng.integers(2, 7))) + (f"<p>{rest(most=40)}</p>" if maybe(0.5) else ""), "sidebar", "widget", "related", "side", "recommended", "share", "social", "tags")

    def comments() -> str:
        one = lambda: inside(pick("div", "li", "article"), f"<b>{rest('Anna', 'guest')}</b><p>{rest(most=50)}</p>", "comment", "reply", "comment-body", "user-comment")
        return inside(pick("section", "div", "ol"), f"<h3>{rest('Comments', '3 comments')}</h3>" + "".join(one() for _ in range(rng.integers(1, 6))), "comments", "comment-list", "responses", "discussion", "disqus")

    def header() -> str:
        return inside("header", pick(f"<h1>{rest()}</h1>", f"<p>{rest()}</p>", menu())) if maybe(0.5) else inside("div", rest(), "header", "masthead", "top", "site-header", "logo")

    def footer() -> str:
        body = pick(f"&copy; {rest('www.example.com', 'All rights reserved')}", f"<p>{rest('All rights reserved', 'Imprint')}</p>", links(3), rest())
        return inside("footer", body, open_end=0.1) if maybe(0.7) else inside("div", body, "footer", "copyright", "site-footer", "bottom", "legal")

    def text(n: int = 60) -> str:
        body = _TEXT + words(int(rng.integers(1, n)))
        if maybe(0.3):
            body = f"<b>{body}{pick('</b>', '<br>', '</b>')}"
        return body + (f" <a href=/x>{words(2)}</a> {words(5)}" if maybe(0.15) else "")

    def piece() -> str:
        kind = rng.random()
        if kind < 0.66:
            return f"<p>{text(int(pick(4, 30, 90, 250)))}" + ("" if maybe(0.2) else "</p>")
        if kind < 0.74:
            return inside(pick("h2", "h3"), text(8))
        if kind < 0.82:
            return inside(pick("ul", "ol"), "".join(f"<li>{text(20)}" + ("" if maybe(0.3) else "</li>") for _ in range(rng.integers(1, 5))))
        if kind < 0.88:
            return pick(inside("blockquote", f"<p>{text(30)}</p>"), inside("pre", text(20)), inside("figure", f"<img src=x><figcaption>{text(10)}</figcaption>"))
        if kind < 0.91:
            return "<table>" + "".join(f"<tr><td>{text(6)}</td><td>{text(6)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>"
        return f"<div>{text(40)}</div>" if kind < 0.94 else pick(advert, sidebar, form, notice)()

    title = _TEXT + words(int(rng.integers(1, 12)))
    body = (f"<h1>{title}</h1>" if maybe(0.8) else "") + "".join(piece() for _ in range(rng.integers(1, 16)))
    if maybe(0.15):
        body += comments()
    kind = rng.random()
    if kind < 0.45:
        main = inside("article", body, open_end=0.15)
    elif kind < 0.6:
        main = inside("main", inside("article", body) if maybe(0.4) else body)
    elif kind < 0.9:
        main = inside(pick("div", "div", "section", "td"), body, "content", "article", "post", "entry-content", "story", "main", "article-body", "post-content", "text")
        main = f"<table><tr>{main}</tr></table>" if main.startswith("<td") else main
    else:
        main = body
    before = "".join(f() for f in (header, menu, notice, advert, form, sidebar) if maybe(0.45))
    after = "".join(f() for f in (sidebar, advert, comments, form, notice, footer) if maybe(0.45))
    head = f"<head><title>{_REST}{words(5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{before}<!-- x -->{main}{after}" + ("" if maybe(0.2) else "</body></html>")


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html", train_pages: int = 900) -> DataFrame:
    """key, url, text (blocks classed as article text, joined by a line feed; empty if none), n_chars (code points), per row.

    Null and empty pages have empty text; null and repeated keys keep a row each; other columns play no part.
    """
    model = Labeller.of(train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                found = [blocks(x.as_py()) for x in part.column("html")]
                scores = model.scores(vectors(found))
                texts = ["\n".join(b[1] for b, p in zip(page_blocks, score) if p >= 0.5) for page_blocks, score in zip(found, scores)]
                yield pa.record_batch(
                    [part.column("key"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)
