"""Joining ordered pieces of text: threads, transcripts, and choices between candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcurate.functions.text import strip
from linkcurate.rules import TRANSCRIPT_LANGUAGES

# --- Fixed values: separators between the pieces.
POST_SEPARATOR = "\n\n---\n\n"
FEED_SEPARATOR = "\n\n"
SNIPPET_SEPARATOR = " "

PART_ROWS = 4096


def thread_separator(url: Column) -> Column:
    """Separator for the pieces of a page, chosen by the whole address; NULL for other sites."""
    return F.when(url.contains("x.com") | url.contains("twitter.com"), F.lit(POST_SEPARATOR)).when(
        url.contains("linkedin.com"), F.lit(FEED_SEPARATOR)
    )


def _joined(position: str, separator: str) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(position, "text")))
    return F.array_join(F.transform(ordered, lambda s: s["text"]), separator)


def text_parts(
    pieces: DataFrame,
    keys: Sequence[str],
    position: str = "pos",
    text: str = "text",
    *,
    separator: str = SNIPPET_SEPARATOR,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Stripped, non-blank pieces joined in order: `keys, part, text`.

    A part covers `part_rows` consecutive positions, so however long one thread
    is, no task collects more than that (positions are unique per key). The
    parts of a key joined by the separator are its whole text; a text of up to
    `part_rows` positions is a single part.
    """
    clean = pieces.select(
        *keys, F.col(position).alias("_pos"), strip(F.col(text)).alias("text"),
        F.floor(F.col(position) / part_rows).cast("bigint").alias("part"),
    ).filter(F.col("text") != "")
    return clean.groupBy(*keys, "part").agg(_joined("_pos", separator).alias("text"))


def whole_texts(parts: DataFrame, keys: Sequence[str], separator: str = SNIPPET_SEPARATOR) -> DataFrame:
    """One row per key from `text_parts`, for texts that have to fit a row anyway."""
    return parts.groupBy(*keys).agg(_joined("part", separator).alias("text"))


def joined_texts(
    pieces: DataFrame, keys: Sequence[str], position: str = "pos", text: str = "text", *,
    separator: str = SNIPPET_SEPARATOR, part_rows: int = PART_ROWS,
) -> DataFrame:
    """One row per key: its pieces joined in order. Long texts come together in two steps, which changes no result."""
    return whole_texts(text_parts(pieces, keys, position, text, separator=separator, part_rows=part_rows), keys, separator)


def preferred_tracks(
    tracks: DataFrame, languages: Sequence[str] = tuple(TRANSCRIPT_LANGUAGES)
) -> DataFrame:
    """The track to use per video: first preferred language present, else the first track.

    `tracks` has `video_id, lang, pos`.
    """
    wanted = F.array(*[F.lit(x) for x in languages])
    rank = F.coalesce(F.nullif(F.array_position(wanted, F.col("lang")), F.lit(0)), F.lit(len(languages) + 1))
    best = tracks.groupBy("video_id").agg(F.min(F.struct(rank.alias("rank"), "pos", "lang")).alias("b"))
    return best.select("video_id", F.col("b.lang").alias("lang"), F.col("b.pos").alias("pos"))


def first_usable(responses: DataFrame, min_chars: int = 50) -> DataFrame:
    """Per link the first candidate by `pos` with status 200 and more than `min_chars` characters."""
    good = responses.filter((F.col("status") == 200) & (F.length("text") > min_chars))
    best = good.groupBy("url").agg(F.min(F.struct("pos", "text")).alias("b"))
    return best.select("url", F.col("b.pos").alias("pos"), F.col("b.text").alias("text"))
