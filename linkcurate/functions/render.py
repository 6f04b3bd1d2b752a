"""Rendering notes, tags, paths, requests and small formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from linkcurate.functions.notes import file_name
from linkcurate.functions.text import head, safe_file_name, strip
from linkcurate.rules import REQUEST_HEAD, TAXONOMY
from linkcurate.schemas import MODEL_ANSWER


def tag_line(tags: Column) -> Column:
    kept = F.filter(tags, lambda t: t.isNotNull() & (t != ""))
    return F.array_join(
        F.transform(kept, lambda t: F.concat(F.lit("#"), F.translate(F.ltrim(t, F.lit("#")), " -", "__"))), " "
    )


def tile_links(tiles: Column, prefix: str = "../attachments") -> Column:
    return F.transform(
        tiles,
        lambda t: F.concat(
            F.lit("![Visual Snapshot "), (t["index"] + 1).cast("string"),
            F.lit(f"]({prefix}/"), file_name(t["path"]), F.lit(")"),
        ),
    )


def _block(items: Column, heading: str) -> Column:
    """A `##` block of items with empty lines between, '' without items."""
    return F.when(
        F.size(items) > 0, F.concat(F.lit(f"\n\n## {heading}\n"), F.array_join(items, "\n\n"))
    ).otherwise(F.lit(""))


def note_markdown(prefix: str = "../attachments") -> Column:
    """The note of a triage row (columns of `schemas.TRIAGE`)."""
    bullets = F.array_join(F.transform("insights", lambda i: F.concat(F.lit("- "), i)), "\n")
    snippets = F.transform(
        "code_snippets", lambda s: F.concat(F.lit("```\n"), strip(s), F.lit("\n```"))
    )
    text = F.concat(
        F.lit("---\nurl: "), F.col("url"),
        F.lit("\ndate: "), F.col("date_str"),
        F.lit("\ncategory: "), F.col("category"),
        F.lit("\ntype: "), F.col("item_type"),
        F.lit("\n---\n\n# "), F.col("title"),
        F.lit("\n\n## AI Summary\n"), F.col("summary"),
        F.lit("\n\n## Key Insights\n"),
        F.when(F.size("insights") > 0, bullets).otherwise(F.lit("- No specific insights extracted.")),
        _block(snippets, "Code Snippets"),
        _block(tile_links(F.col("visual_tiles"), prefix), "Visual Snapshots"),
        F.lit("\n\n## Tags\n"), F.coalesce(tag_line(F.col("tags")), F.lit("")),
        F.lit("\n\n---\n## Original Source\n"), F.coalesce(F.col("original_text"), F.lit("")),
        F.lit("\n"),
    )
    return F.concat(strip(text), F.lit("\n"))


def note_path(vault: str, category: Column, title: Column) -> Column:
    return F.concat(F.lit(vault.rstrip("/") + "/"), category, F.lit("/"), safe_file_name(title), F.lit(".md"))


def note_date(date: Column, today: Column | None = None) -> Column:
    return F.date_format(F.coalesce(date, today if today is not None else F.current_timestamp()), "yyyy-MM-dd")


def clock(seconds: Column) -> Column:
    """Seconds as `MMm SSs`; minutes keep counting past 60."""
    whole = seconds.cast("bigint")
    return F.format_string("%02dm %02ds", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def taxonomy_text(taxonomy: Mapping[str, str] = TAXONOMY) -> str:
    """One bullet per category."""
    return "\n".join(f"- **{name}**: {guide}" for name, guide in taxonomy.items())


def taxonomy_block(taxonomy: Mapping[str, str] = TAXONOMY) -> Column:
    return F.lit(taxonomy_text(taxonomy))


def instructions(taxonomy: Mapping[str, str] = TAXONOMY) -> str:
    """What a model is told before its requests: the categories to choose from, and the fields of its answer (`schemas.MODEL_ANSWER`)."""
    fields = ", ".join(f'"{f.name}": {"[...]" if isinstance(f.dataType, ArrayType) else chr(34) + "..." + chr(34)}' for f in MODEL_ANSWER.fields)
    return (
        "You sort saved web content into a library of notes.\n\n"
        f"Choose exactly one of these categories:\n{taxonomy_text(taxonomy)}\n\n"
        "An offer of work is of category \"jobs\" and type \"job\"; all else is of type \"knowledge\". Summarise what is said in some paragraphs "
        "and list concrete insights; leave advertising, sponsors and navigation out. Write in English, whatever the language of the "
        "content. Put code worth keeping into code_snippets.\n\n"
        f"Answer with one JSON object and nothing else: {{{fields}}}\n"
    )


def model_request() -> Column:
    """Request text for a triage model from the columns of `schemas.SCRAPED`."""
    tiles = F.coalesce(F.greatest(F.size("visual_tiles"), F.lit(0)), F.lit(0))
    notice = F.when(
        tiles > 0,
        F.concat(F.lit("\nAttached Visual Screenshot Tiles: "), tiles.cast("string"), F.lit(" image(s).")),
    ).otherwise(F.lit(""))
    body = F.when(
        F.coalesce(F.col("text"), F.lit("")) != "", head(F.col("text"), REQUEST_HEAD)
    ).otherwise(F.lit("[Visual Document - See attached screenshot tiles]"))
    return F.concat(
        F.lit("URL: "), F.col("url"),
        F.lit("\nSource Type: "), F.col("source_type"),
        F.lit("\nTitle: "), F.col("title"), notice,
        F.lit("\n\nCONTENT TO ANALYZE:\n"), body, F.lit("\n"),
    )
