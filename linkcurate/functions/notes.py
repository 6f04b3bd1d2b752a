"""Reading fields out of markdown notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcurate.functions.quality import note_failed
from linkcurate.functions.text import SPACE_CLASS, TO_END, head, strip
from linkcurate.rules import CORPUS_HEAD, EXCERPT_HEAD, HEAD_LINES

_S = f"[{SPACE_CLASS}]"
HEADING = rf"(?mdU)^#{_S}+.+$"
SOURCE_LINK = rf"(?dU)\*\*Source URL\*\*:{_S}*\[.*?\]\((https?://[^)]+)\)"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TAG = r"#([a-zA-Z0-9_\-/]+)"
FRONT_FIELD = r"""(?md)^%s: ["']?(.*?)["']?$"""
CONTINUED = "\n... [Source content continued in individual note] ..."
NO_INSIGHTS = "No specific insights"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def note_title(content: Column, name: Column) -> Column:
    """First level-one heading, else the file stem."""
    line = F.regexp_substr(content, F.lit(HEADING))
    return F.coalesce(strip(F.substring(line, 2, TO_END)), stem(name))


def source_link(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, SOURCE_LINK, 1), F.lit(""))


def note_head(content: Column, lines: int = HEAD_LINES) -> Column:
    return F.substring_index(content, "\n", lines)


def front_matter(content: Column, field: str) -> Column:
    """One front-matter field from the head of a note, quotes removed."""
    value = F.regexp_extract(note_head(content), FRONT_FIELD % field, 1)
    return F.nullif(value, F.lit(""))


def section(content: Column, heading: str) -> Column:
    """Body of a `##` section up to the next line that starts with `##`; '' if absent."""
    words = rf"{_S}+".join(["##", heading])
    return strip(F.regexp_extract(content, rf"(?sU){words}{_S}*\n(.*?)(?=\n##|\z)", 1))


def summary(content: Column) -> Column:
    return section(content, "AI Summary")


def insights(content: Column) -> Column:
    lines = F.split(section(content, "Key Insights"), LINE_BREAK)
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, rf"(?U)^[-*•]{_S}*", "")))
    return F.filter(bare, lambda x: (x != "") & ~x.startswith(NO_INSIGHTS))


def tags(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TAG), F.lit(1))


def excerpt(content: Column, size: int = EXCERPT_HEAD) -> Column:
    """Quoted start of the original source, with a marker when it was cut; '' if absent."""
    body = section(content, "Original Source")
    return F.when(F.length(body) > size, F.concat(head(body, size), F.lit(CONTINUED))).otherwise(body)


def parse_notes(files: DataFrame, *, front_matter_url: bool = True) -> DataFrame:
    """Parse note files (`file_path`, `file_name`, `category`, `content`).

    Generated notes keep their address only in the front matter. With
    `front_matter_url` it stands in when the body has no source link; without,
    `url` is the body link alone.
    """
    content = F.col("content")
    link = source_link(content)
    if front_matter_url:
        link = F.coalesce(link, front_matter(content, "url"))
    return (
        files.withColumn("title", note_title(content, F.col("file_name")))
        .withColumn("url", link)
        .withColumn("summary", summary(content))
        .withColumn("insights", insights(content))
        .withColumn("tags", tags(content))
        .withColumn("is_failed", note_failed(content, F.col("title")))
    )


def classifier_corpus() -> Column:
    """Lower-cased text the rule classifier reads, from the columns of `parse_notes`."""
    return F.lower(
        F.concat_ws(
            "\n",
            F.col("title"),
            stem(F.col("file_name")),
            F.coalesce(F.col("url"), F.lit("")),
            F.col("summary"),
            F.array_join("insights", " "),
            head(F.col("content"), CORPUS_HEAD),
        )
    )
