"""Text cleaning as Spark column expressions. No Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkcurate.rules import PROMO_PATTERNS, SOUND_TAGS, check_pattern

# Characters a Unicode-aware strip removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set inside a (?U) character class.
SPACE_CLASS = r"\s\x1c-\x1f"
TO_END = 2**31 - 1

# Word letters of the stutter rule; the last four fold to Latin letters.
WORD = "[a-zA-Zа-яА-ЯіїєґІЇЄҐıİſ\u212a]"
# Up to this many words are searched for one by one.
FEW_WORDS = 24


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (linear in the text)."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """One blank between words, at most one empty line, no outer space."""
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    text = F.regexp_replace(text, rf"(?U)\n[{SPACE_CLASS}]*\n+", "\n\n")
    return strip(text)


def head(text: Column, size: int) -> Column:
    """The first `size` characters (code points)."""
    return F.substring(text, 1, size)


def any_pattern(pattern: str) -> str:
    """A rule pattern with case folding and Unicode classes switched on."""
    return "(?iU)" + check_pattern(pattern)


# --- Fixed values: letters that only a case-blind match equates to another letter.
EXTRA_CASES = {
    "ı": "i", "İ": "i", "ſ": "s", "\u212a": "k", "\u1c80": "в", "\u1c81": "д", "\u1c82": "о", "\u1c83": "с", "\u1c84": "т", "\u1c85": "т", "\u1c86": "ъ",
}
ODD_LETTER = r"[\u0130-\u0131\u017f\u1c80-\u1c86\u212a]"
# Letters of which the lower-case form is the only one that a case-blind match may meet in a folded text.
PLAIN = "a-z0-9а-яёіїєґ"


def fold_case(text: Column) -> Column:
    """Lower case, with the letters that only a case-blind match equates to Latin or Cyrillic ones; texts without them are not translated."""
    letters = "".join(EXTRA_CASES)
    odd = lambda t: (F.octet_length(t) != F.length(t)) & t.rlike(ODD_LETTER)
    return let(text, lambda t: F.lower(F.when(odd(t), F.translate(t, letters, "".join(EXTRA_CASES.values()))).otherwise(t)))


def required_words(pattern: str) -> list[tuple[str, bool]] | None:
    """Folded words of which every match of the pattern holds at least one, None if unknown.

    Known are patterns that begin with a list of phrases, `(?:one\\s+phrase|another)` or the same between boundaries, in plain
    letters. The flag tells that the word is a whole word of the text. Long words are preferred, then whole ones.
    """
    # An optional group and what stands in a character class take no part.
    simple = re.sub(r"\(\?:[^()|]*\)[?*]|\[[^\]]*\][*+?]?", "\\\\S*", pattern)
    found = re.match(r"(\\b)?\(\?:([^()]*)\)(?![?*{])(\\b)?", simple)
    if not found or "|" in re.sub(r"\([^()]*\)", "", simple[found.end() :]):
        return None
    out = set()
    for phrase in found[2].split("|"):
        words = re.split(r"\\s\+", phrase)
        some = []
        for i, word in enumerate(words):
            bounded = (i > 0 or found[1]) and (i < len(words) - 1 or found[3])
            if re.fullmatch(f"[{PLAIN}]+", word.lower()):
                some.append((word.lower(), bool(bounded)))
            else:
                # Parts between other signs; hyphens and the like, with or without blanks, end a word as a boundary does.
                parts = re.split(rf"((?:\\.[*+?]?|.[*+?]|\{{[^}}]*\}}|[^{PLAIN}])+)", word.lower())
                ends = [bool(i > 0 or found[1]), *[re.fullmatch(r"(?:\\s[*+])*[-/,](?:\\s[*+])*", x) is not None for x in parts[1::2]], bool(i < len(words) - 1 or found[3])]
                some += [(x, ends[k] and ends[k + 1]) for k, x in enumerate(parts[::2]) if x]
        if not some:
            return None
        out.add(max(some, key=lambda x: (len(x[0]) > 3, x[1], len(x[0]))))
    return sorted(out) if min(len(x) for x, _ in out) > 1 else None


def gated(folded: Column, patterns: Sequence[str], use: Callable[[list[Column]], Column]) -> Column:
    """`use(gates)` with one cheap test per pattern that no text with a match fails.

    A few required words are searched for in `folded` (see `fold_case`). When
    there are many, the text is split once and its words are looked up in the
    set of required whole words.
    """
    required = [required_words(p) for p in patterns]
    known = sorted({w for r in required if r for w, whole in r if whole})
    if len(known) <= FEW_WORDS:
        required, known = [r and [(w, False) for w, _ in r] for r in required], []

    def tests(lower: Column, found: Column) -> Column:
        gates = []
        for r in required:
            whole = [F.lit(w) for w, is_whole in r or [] if is_whole]
            gate = F.arrays_overlap(found, F.array(*whole)) if whole else F.lit(r is None)
            for word in (w for w, is_whole in r or [] if not is_whole):
                gate = gate | lower.contains(word)
            gates.append(gate)
        return use(gates)

    def looked_up(lower: Column) -> Column:
        if not known:
            return tests(lower, F.array())
        # A required word has no blank, so what stands between blanks is looked at once, however often it occurs.
        pieces = F.array_join(F.array_distinct(F.split(lower, " ")), " ")
        words = lambda p: F.array_intersect(F.split(p, r"(?U)\W+"), F.array(*map(F.lit, known)))
        return let(pieces, lambda p: let(words(p), lambda found: tests(p, found)))

    return let(folded, looked_up)


def safe_file_name(title: Column, max_length: int = 80) -> Column:
    """A title as a portable file name.

    A name that is too long is cut and loses its last blank-separated piece,
    even when the cut falls on the end of a word.
    """
    name = F.regexp_replace(title, r'[\\/*?:"<>|#\[\]^~`]', "")
    name = strip(F.regexp_replace(name, rf"(?U)[{SPACE_CLASS}_]+", " "))
    name = F.coalesce(F.nullif(name, F.lit("")), F.when(title.isNotNull(), F.lit("untitled_note")))
    return let(
        name,
        lambda n: F.when(
            F.length(n) > max_length, F.regexp_replace(head(n, max_length), " [^ ]*$", "")
        ).otherwise(n),
    )


def remove_sound_tags(text: Column, tags: Sequence[str] = tuple(SOUND_TAGS)) -> Column:
    return F.regexp_replace(text, rf"(?iU)\[(?:{'|'.join(tags)})[^\]]*\]", " ")


def remove_turn_marks(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)>[{SPACE_CLASS}]*>[{SPACE_CLASS}]*", " ")


def fold_stutters(text: Column) -> Column:
    """Keep the first of a run of one repeated word, however long the run.

    A word goes, with the white space before it, if it is the word before that white space again. One pattern takes a whole run: its
    group is repeated possessively, which Java's matcher does in a loop without going deeper. That pattern equates the letters ı
    and ſ to i and s, which the rule does not; texts with those letters are cut into words and what stands between them.
    """
    again = rf"[{SPACE_CLASS}]++(?iu:\1)\b"
    pair, run = rf"(?U)\b({WORD}++){again}", rf"(?U)\b({WORD}++)(?:{again})++"

    def folded(tokens: Column) -> Column:
        words = F.transform(tokens, lambda t: F.when(t.rlike(f"^{WORD}+$"), F.lower(F.replace(t, F.lit("İ"), F.lit("i")))))
        blank = F.transform(tokens, lambda t: t.rlike(rf"(?U)^[{SPACE_CLASS}]+$"))
        again = lambda w, b: F.transform(w, lambda x, i: F.coalesce(F.get(b, i - 1) & (x == F.get(w, i - 2)), F.lit(False)))
        gone = let(words, lambda w: let(blank, lambda b: again(w, b)))
        return let(gone, lambda g: F.array_join(F.filter(tokens, lambda t, i: ~(F.get(g, i) | F.coalesce(F.get(g, i + 1), F.lit(False)))), ""))

    cut = lambda given: let(F.regexp_extract_all(given, F.lit(r"(?U)\w+|\W+"), F.lit(0)), folded)
    told_apart = lambda given: given.contains("ı") | given.contains("ſ")
    return let(text, lambda given: F.when(~told_apart(given), F.regexp_replace(given, run, "$1")).when(given.rlike(pair), cut(given)).otherwise(given))


def clean_transcript(text: Column) -> Column:
    """Spoken text without sound tags, turn marks and stutters."""
    return F.coalesce(squeeze(fold_stutters(remove_turn_marks(remove_sound_tags(text)))), F.lit(""))


def clean_promo(text: Column, patterns: Sequence[str] = tuple(PROMO_PATTERNS)) -> Column:
    """Text without sponsor, subscribe, like and description-link phrases."""
    def clean(given: Column) -> Column:
        cleaned = given
        for pattern in patterns:
            cleaned = F.regexp_replace(cleaned, any_pattern(pattern), "")
        # One gate for all patterns: a removal may create a match for a later one.
        return gated(
            fold_case(given), patterns,
            lambda gates: F.when(reduce(Column.__or__, gates, F.lit(False)), cleaned).otherwise(given),
        )

    return F.coalesce(squeeze(let(text, clean)), F.lit(""))


def clean_spoken(text: Column) -> Column:
    """Both cleaners in the order used for video transcripts."""
    return clean_promo(clean_transcript(text))
