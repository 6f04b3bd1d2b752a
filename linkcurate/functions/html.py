"""Title and main text of raw pages as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5 as named_characters

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkcurate.functions.text import let, squeeze, strip
from linkcurate.rules import CLUTTER_CLASS, CLUTTER_CLASS_OR_ID, CLUTTER_ID

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
COMMENT = r"(?s)<!--.*?-->"
DROPPED_TAGS = ("head", "script", "style", "noscript", "template", "nav", "footer")
BLOCK_TAGS = (
    "p", "div", "br", "hr", "h[1-6]", "ul", "ol", "li", "table", "tr", "article", "section",
    "header", "main", "aside", "pre", "blockquote", "figure", "form", "dl", "dt", "dd",
)
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# Named characters, from Python's table: those that end in a semicolon, and those that may go without; a no-break space is a space here.
NAMED = {name[:-1]: char for name, char in named_characters.items() if name.endswith(";")} | {"nbsp": " "}
OPEN_NAMED = {name: NAMED[name] for name in named_characters if not name.endswith(";")}
# Numbers 128 to 159 stand for the characters of Windows' Latin code page where it has one.
LATIN = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;)"
_OPEN_REFERENCE = rf"^({'|'.join(sorted(OPEN_NAMED, key=lambda x: (-len(x), x)))})"


def _table(entries: dict[str, str]) -> Column:
    pairs = ",".join(f"{name}\x1f{char}" for name, char in entries.items() if char not in (",", "\x1f"))
    return F.str_to_map(F.concat(F.lit(pairs), F.lit(",comma\x1f\uf8ff")), F.lit(","), F.lit("\x1f"))


def _number(reference: Column) -> Column:
    """The character of `#65;` or `#x41;`; a number that is none gives the replacement character."""
    digits = F.regexp_extract(reference, r"^#0*([0-9]+)", 1)
    hexed = F.regexp_extract(reference, r"^#[xX]0*([0-9a-fA-F]+)", 1)
    point = F.when(digits != "", F.when(F.length(digits) <= 7, digits.cast("int")).otherwise(-1)).otherwise(
        F.when(F.length(hexed) <= 6, F.conv(hexed, 16, 10).cast("int")).otherwise(-1)
    )
    latin = F.array(*[F.lit(LATIN.get(n) or chr(n)) for n in range(128, 160)])
    valid = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(point.cast("bigint")), 8, "0")), "UTF-32")
    return F.when(point.between(128, 159), F.get(latin, point - 128)).when(valid, char).otherwise("\ufffd")


def _replacements(found: Column) -> Column:
    """Distinct references with what they stand for (null: nothing): the big tables are looked at once per distinct one."""
    def known(reference: Column) -> Column:
        named = F.try_element_at(_table(NAMED), F.nullif(F.regexp_extract(reference, r"^([a-zA-Z][a-zA-Z0-9]*);$", 1), F.lit("")))
        start = F.regexp_extract(reference, _OPEN_REFERENCE, 1)
        opened = F.concat(F.try_element_at(_table(OPEN_NAMED), F.nullif(start, F.lit(""))), F.substr(reference, F.length(start) + 1))
        named = F.replace(F.coalesce(named, opened), F.lit("\uf8ff"), F.lit(","))
        return F.when(reference.startswith("#"), _number(reference)).otherwise(named)

    return F.map_from_arrays(found, F.transform(found, known))


def unescape(text: Column) -> Column:
    """Decode character references, each once: numbers of any length, all names, and the old names without a semicolon."""
    reference = lambda piece: F.coalesce(
        F.nullif(F.regexp_extract(piece, _REFERENCE, 1), F.lit("")), F.regexp_extract(piece, _OPEN_REFERENCE, 1)
    )

    def decoded(pieces: Column) -> Column:
        return let(F.transform(pieces, reference), lambda found: let(_replacements(F.array_distinct(found)), lambda names: joined(pieces, found, names)))

    def joined(pieces: Column, found: Column, names: Column) -> Column:
        each = F.zip_with(pieces, found, lambda piece, x: F.coalesce(
            F.concat(F.try_element_at(names, x), F.substr(piece, F.length(x) + 1)), F.concat(F.lit("&"), piece)
        ))
        return F.array_join(each, "")

    def whole(given: Column) -> Column:
        pieces = F.split(given, "&")
        return F.when(given.contains("&"), F.concat(pieces[0], let(F.slice(pieces, F.lit(2), F.size(pieces) - 1), decoded))).otherwise(given)

    return let(text, whole)


def page_title(html: Column, default: str = "Article Note") -> Column:
    title = strip(unescape(F.regexp_extract(html, TITLE, 1)))
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(default))


def _noise(piece: Column, dropped: Sequence[str], fragments: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Whether a piece of markup that follows `<` starts an element to drop: by its name, or by a fragment of its class or id."""
    found = F.lit(False)
    if dropped:
        found = piece.rlike(rf"^(?i:{'|'.join(dropped)})(?:[\s/>]|$)")
    for attributes, tokens in fragments:
        if tokens:
            token = f"(?:{'|'.join(tokens)})"
            found = found | piece.rlike(
                rf"""^[a-zA-Z][^\s/>]*(?=[\s/])[^>]*?[\s"'/](?i:{attributes})\s*=\s*(?:"[^"]*?{token}|'[^']*?{token}|[^\s"'>]*?{token})"""
            )
    return found


def _drop_elements(html: Column, dropped: Sequence[str], fragments: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """`html` without the chosen elements, each up to the end tag that matches its start tag.

    The markup is split into pieces that follow a `<`. One fold over them carries the name of the element that is being dropped and
    how many elements of that name are open in it, and collects ranges of pieces; what lies between the ranges is joined again.
    """
    def kind(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^/?([a-zA-Z][^\s/>]*)", 1))
        tag = piece.contains(">") & (name != "")
        step = F.when(~tag, 0).when(piece.startswith("/"), -1).when(name.isin(*VOID_TAGS), 0).otherwise(1)
        noise = tag & ~piece.startswith("/") & _noise(piece, dropped, fragments)
        return F.struct(name.alias("name"), step.alias("step"), noise.alias("noise"))

    start = F.struct(
        F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(0).alias("first"), F.lit(0).alias("i"),
        F.expr("cast(array() as array<struct<first: int, last: int, tail: boolean>>)").alias("ranges"),
    )

    def fold(state: Column, tag: Column) -> Column:
        inside, same = state["depth"] > 0, state["name"] == tag["name"]
        closes = inside & same & (tag["step"] == -1) & (state["depth"] == 1)
        cut = inside & same & (tag["name"] == "p") & (tag["step"] == 1)  # a paragraph holds no other
        begins = (~inside | cut) & tag["noise"]
        alone = begins & (tag["step"] == 0)
        one = lambda first, tail: F.array(F.struct(first.alias("first"), state["i"].alias("last"), F.lit(tail).alias("tail")))
        ranges = F.when(closes, F.concat(state["ranges"], one(state["first"], True))).when(cut, F.concat(state["ranges"], one(state["first"], False))).when(
            alone, F.concat(state["ranges"], one(state["i"], True))
        ).otherwise(state["ranges"])
        depth = F.when(begins & ~alone, 1).when(closes | cut | ~inside, 0).otherwise(state["depth"] + F.when(same, tag["step"]).otherwise(0))
        return F.struct(
            F.when(begins, tag["name"]).otherwise(state["name"]).alias("name"), depth.alias("depth"),
            F.when(begins, state["i"]).otherwise(state["first"]).alias("first"), (state["i"] + 1).alias("i"), ranges.alias("ranges"),
        )

    def rejoined(pieces: Column) -> Column:
        later = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
        return F.concat(pieces[0], let(later, lambda p: let(F.aggregate(F.transform(p, kind), start, fold)["ranges"], lambda r: between(p, r))))

    def between(pieces: Column, ranges: Column) -> Column:
        marked = lambda part: F.array_join(F.transform(part, lambda x: F.concat(F.lit("<"), x)), "")
        after = lambda r: r["last"] + F.when(r["tail"], 1).otherwise(0)

        def kept(r: Column, i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(after(F.get(ranges, i - 1)))
            tail = F.when(r["tail"], F.regexp_extract(F.get(pieces, r["last"]), r"(?s)>(.*)$", 1)).otherwise("")
            return F.concat(marked(F.slice(pieces, begin + 1, r["first"] - begin)), tail)

        end = F.when(F.size(ranges) > 0, after(F.get(ranges, F.size(ranges) - 1))).otherwise(0)
        rest = marked(F.slice(pieces, end + 1, F.size(pieces)))
        return F.when(F.size(ranges) == 0, marked(pieces)).otherwise(F.concat(F.array_join(F.transform(ranges, kept), ""), rest))

    return let(F.split(html, "<"), rejoined)


def strip_clutter(
    html: Column,
    *,
    class_or_id: Sequence[str] = tuple(CLUTTER_CLASS_OR_ID),
    class_only: Sequence[str] = tuple(CLUTTER_CLASS),
    id_only: Sequence[str] = tuple(CLUTTER_ID),
    dropped: Sequence[str] = (),
) -> Column:
    """Remove banner-like elements chosen by a fragment of their class or id, and elements of the names in `dropped`.

    Fragments are patterns, letter case counts. An element goes with all it holds, nested elements of its own name too; one that is
    never closed stays.
    """
    return _drop_elements(html, dropped, (("class|id", class_or_id), ("class", class_only), ("id", id_only)))


def _written_links(html: Column) -> Column:
    """Links as `[words](target)`: what stands before an end tag `</a>` belongs to the last start tag before it."""
    def written(part: Column) -> Column:
        found = F.regexp_extract(part, r"(?is)^.*<a(\s[^>]*)>", 1)
        target = F.regexp_extract(found, r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
        target = F.regexp_replace(target, r"""(?is)^\shref\s*=\s*["']?|["']$""", "")
        words = F.regexp_extract(part, r"(?is)^.*<a\s[^>]*>(.*)$", 1)
        before = F.substr(part, F.lit(1), F.length(part) - F.length(words))
        empty = F.trim(F.regexp_replace(words, r"(?s)<[^>]*>", "")) == ""
        return F.when((target == "") | empty, part).otherwise(F.concat(before, F.lit("["), words, F.lit("]("), target, F.lit(")")))

    def joined(parts: Column) -> Column:
        ended = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), written)
        return F.concat(F.array_join(ended, ""), F.element_at(parts, -1))

    return let(F.split(html, r"(?i)</a\s*>"), joined)


def main_text(html: Column, *, strip_kwargs: dict | None = None, dropped: Sequence[str] = DROPPED_TAGS, links: bool = True) -> Column:
    """Readable text: no comments, scripts, navigation, clutter or tags; links as `[words](target)` unless `links` is off."""
    html = F.regexp_replace(html, COMMENT, "")
    html = strip_clutter(html, dropped=dropped, **(strip_kwargs or {}))
    html = _written_links(html) if links else html
    html = F.regexp_replace(html, rf"(?is)</?(?:{'|'.join(BLOCK_TAGS)})(?:[\s/][^>]*)?>", "\n")
    html = F.regexp_replace(html, r"(?is)</?t[dh](?:[\s/][^>]*)?>", " ")
    html = F.regexp_replace(html, r"(?s)</?[a-zA-Z!][^>]*>", "")
    return squeeze(unescape(html))
