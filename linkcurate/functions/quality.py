"""Capture and note quality rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkcurate.functions.text import any_pattern, fold_case, gated, head, let, strip
from linkcurate.rules import LOGIN_PATTERNS, LOGIN_WINDOW, MIN_NOTE, MIN_TEXT, STUB_NOTE


def integrity_reason(
    text: Column,
    patterns: Sequence[str] = tuple(LOGIN_PATTERNS),
    *,
    window: int = LOGIN_WINDOW,
    min_chars: int = MIN_TEXT,
) -> Column:
    """Why a captured text is unusable, NULL if it is fine.

    Login words in the first `window` characters are tested before the length.
    """
    def length_reason(clean: Column) -> Column:
        size = F.length(clean)
        label = F.concat(
            F.lit("Text length too short ("), size.cast("string"), F.lit(f" chars < {min_chars} chars)")
        )
        return F.when(size < min_chars, label)

    def login_reason(start: Column) -> Column:
        def first_hit(gates: list[Column]) -> Column:
            reason = F.lit(None).cast("string")
            for gate, pattern in reversed(list(zip(gates, patterns, strict=True))):
                label = F.lit(f"Detected login wall pattern matching '{pattern}'")
                reason = F.when(gate & start.rlike(any_pattern(pattern)), label).otherwise(reason)
            return reason

        return gated(fold_case(start), patterns, first_hit)

    return let(
        strip(F.coalesce(text, F.lit(""))),
        lambda clean: F.coalesce(let(head(clean, window), login_reason), length_reason(clean)),
    )


def integrity(text: Column, patterns: Sequence[str] = tuple(LOGIN_PATTERNS), **kwargs) -> Column:
    """`struct(failed, reason)` of `integrity_reason`."""
    return let(
        integrity_reason(text, patterns, **kwargs),
        lambda reason: F.struct(reason.isNotNull().alias("failed"), reason.alias("reason")),
    )


def has_visuals(tiles: Column) -> Column:
    return F.coalesce(F.size(tiles) > 0, F.lit(False))


def is_usable(failed: Column, text: Column, tiles: Column) -> Column:
    """Not failed, and either illustrated or long enough."""
    enough = F.length(strip(F.coalesce(text, F.lit("")))) >= MIN_TEXT
    return ~F.coalesce(failed, F.lit(False)) & (has_visuals(tiles) | enough)


def note_failed(content: Column, title: Column, min_chars: int = MIN_NOTE) -> Column:
    """A note of a failed capture, or one with hardly any text."""
    return (
        content.contains("#failed_scrape")
        | title.contains("Failed Scrape")
        | (F.length(strip(content)) < min_chars)
    )


def is_dead_stub(failed: Column, content: Column, max_chars: int = STUB_NOTE) -> Column:
    return failed & (F.length(content) < max_chars)


def needs_reprocessing(category: Column, title: Column, url: Column) -> Column:
    """Registered items worth another try: unsorted, failed, or of a source with a better extractor."""
    return (
        (category == "other")
        | F.lower(F.coalesce(title, F.lit(""))).contains("failed")
        | url.contains("youtube.com")
        | url.contains("youtu.be")
        | url.contains("arxiv.org")
    )
