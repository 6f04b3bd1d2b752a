"""Fields of Atom entries, video metadata and model answers, and the texts built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkcurate.functions.text import SPACE_CLASS, let, strip
from linkcurate.schemas import MODEL_ANSWER

# --- Fixed values: placeholders for missing metadata.
VIDEO_TITLE_DEFAULT = "YouTube Video / Podcast"
CHANNEL_DEFAULT = "YouTube Channel"
NO_TRANSCRIPT_NOTE = "[Note: No subtitle transcript track was found for this video. Analyzing title and metadata.]"
NO_TRANSCRIPT_REASON = "No transcript or description available for YouTube video"
MIN_VIDEO_TITLE = 15


def _first_entry(xml: Column, tag: str) -> Column:
    """Stripped content of the first `tag` after an entry opens, NULL if absent."""
    pattern = rf"(?s)<entry>.*?<{tag}>(.*?)</{tag}>"
    return F.when(xml.rlike(pattern), strip(F.regexp_extract(xml, pattern, 1)))


def paper_title(xml: Column, arxiv_id: Column) -> Column:
    title = F.replace(_first_entry(xml, "title"), F.lit("\n"), F.lit(" "))
    return F.coalesce(title, F.concat(F.lit("ArXiv Paper "), arxiv_id))


def paper_abstract(xml: Column) -> Column:
    return F.coalesce(_first_entry(xml, "summary"), F.lit(""))


def paper_authors(xml: Column) -> Column:
    names = F.regexp_extract_all(
        xml, F.lit(rf"(?dU)<author>[{SPACE_CLASS}]*<name>(.*?)</name>"), F.lit(1)
    )
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("Unknown"))


def paper_text(title: Column, authors: Column, arxiv_id: Column, abstract: Column) -> Column:
    return F.concat(
        F.lit("# Title: "), title,
        F.lit("\n# Authors: "), authors,
        F.lit("\n# ArXiv ID: "), arxiv_id,
        F.lit("\n\n## Abstract:\n"), abstract,
    )


def video_title(metadata: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.title"), F.lit(VIDEO_TITLE_DEFAULT))


def video_channel(metadata: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.author_name"), F.lit(CHANNEL_DEFAULT))


def _has_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def video_text(title: Column, channel: Column, watch_url: Column, transcript: Column) -> Column:
    body = F.when(
        _has_text(transcript), F.concat(F.lit("\n## Full Spoken Transcript:\n"), transcript)
    ).otherwise(F.lit("\n" + NO_TRANSCRIPT_NOTE))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# Video Title: "), title),
        F.concat(F.lit("# Channel / Creator: "), channel),
        F.concat(F.lit("# URL: "), watch_url),
        body,
    )


def video_failure(title: Column, transcript: Column) -> Column:
    """Reason for a video that has neither a transcript nor a telling title."""
    return F.when(
        ~_has_text(transcript) & (F.length(title) < MIN_VIDEO_TITLE), F.lit(NO_TRANSCRIPT_REASON)
    )


def _object_or_null(text: Column) -> Column:
    """The text itself when it is valid JSON for an object, else NULL. A key may repeat; its last value counts."""
    return F.when(F.json_object_keys(text).isNotNull(), text)


def answer_json(raw: Column) -> Column:
    """The JSON object inside a model's answer, NULL when there is none.

    Tries the answer without its code fence, then the outermost braces.
    """
    def unfenced(text: Column) -> Column:
        bare = F.regexp_replace(text, rf"(?U)^```(?:json)?[{SPACE_CLASS}]*", "")
        bare = F.regexp_replace(bare, rf"(?U)[{SPACE_CLASS}]*```$", "")
        return F.when(text.startswith("```"), bare).otherwise(text)

    def tried(clean: Column) -> Column:
        braces = F.regexp_substr(clean, F.lit(r"(?s)\{.*\}"))
        return F.coalesce(_object_or_null(clean), let(braces, _object_or_null))

    return let(let(strip(F.coalesce(raw, F.lit(""))), unfenced), tried)


def parse_answer(raw: Column) -> Column:
    """A model's answer as a struct; all fields NULL for junk."""
    return F.from_json(F.coalesce(answer_json(raw), F.lit("{}")), MODEL_ANSWER, {"mode": "PERMISSIVE"})
