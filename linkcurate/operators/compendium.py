"""All valid notes as one ordered document."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkcurate.functions.notes import excerpt
from linkcurate.operators.joins import small_side
from linkcurate.rules import CHAPTER_THEME_DEFAULT, DOMAIN_THEMES, TABLE_THEME_DEFAULT
from linkcurate.sources.tables import materialize

TAGS_SHOWN = 5
INSIGHTS_SHOWN = 6
SUMMARY_IGNORED = "Summary generated from visual analysis"
ORDER = ["section", "chapter", "file_path", "line_no"]


def theme(category: Column, default: str, themes: Mapping[str, str] = DOMAIN_THEMES) -> Column:
    """Description of a category by lookup in a literal map, no join."""
    table = F.create_map(*[F.lit(x) for pair in themes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit(default))


def catalog(notes: DataFrame) -> DataFrame:
    """Valid notes per category: `category, n`."""
    return notes.filter(~F.col("is_failed")).groupBy("category").agg(F.count("*").alias("n"))


def catalog_totals(counts: DataFrame) -> DataFrame:
    """`notes, domains` over the catalog; zeros for an empty one."""
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("notes"), F.count("*").alias("domains")
    )


def chapters(counts: DataFrame) -> DataFrame:
    """Catalog with chapter numbers, biggest first, names on ties.

    The window runs over one row per folder, after the aggregation.
    """
    order = Window.orderBy(F.desc("n"), "category")
    return counts.withColumn("chapter", F.row_number().over(order))


def note_lines() -> Column:
    """The lines of one note as an array, from the columns of `parse_notes`."""
    none = F.array().cast("array<string>")

    def some(condition: Column, *lines: Column | str) -> Column:
        given = [F.lit(x) if isinstance(x, str) else x for x in lines]
        return F.when(F.coalesce(condition, F.lit(False)), F.array(*given)).otherwise(none)

    tags = F.transform(F.slice("tags", 1, TAGS_SHOWN), lambda t: F.concat(F.lit("#"), t))
    points = F.transform(F.slice("insights", 1, INSIGHTS_SHOWN), lambda i: F.concat(F.lit("- "), i))
    quoted = excerpt(F.col("content"))
    return F.concat(
        F.array(F.concat(F.lit("## "), F.col("title"))),
        some(F.col("url") != "", F.concat(F.lit("- **Source URL**: "), F.col("url"))),
        F.array(F.concat(
            F.lit("- **Category Path**: `vault/"), F.col("category"), F.lit("/"), F.col("file_name"), F.lit("`")
        )),
        some(F.size("tags") > 0, F.concat(F.lit("- **Tags**: "), F.array_join(tags, " "))),
        F.array(F.lit("")),
        some(
            (F.col("summary") != "") & ~F.col("summary").contains(SUMMARY_IGNORED),
            "### Executive Summary", F.col("summary"), "",
        ),
        F.when(
            F.size("insights") > 0,
            F.concat(F.array(F.lit("### Core Takeaways & Key Insights")), points, F.array(F.lit(""))),
        ).otherwise(none),
        some(
            quoted != "", "### Source Excerpt / Dialogue",
            F.concat(F.lit("```text\n"), quoted, F.lit("\n```")), "",
        ),
        F.array(F.lit("---\n")),
    )


def _header(totals: DataFrame, generated: Column) -> DataFrame:
    lines = F.array(
        F.lit("# 🧠 Personal Intelligence & Engineering Knowledge Base"),
        F.lit("> **Master Knowledge Compendium for NotebookLM Synthesis & Audio Deep Dives**"),
        F.concat(
            F.lit("> **Generated**: "), F.date_format(generated, "yyyy-MM-dd HH:mm"),
            F.lit(" UTC | **Total Analyzed Sources**: "), F.col("notes").cast("string"),
            F.lit(" notes across "), F.col("domains").cast("string"), F.lit(" domains"),
        ),
        F.lit(""), F.lit("---"), F.lit(""),
        F.lit("## 📖 Executive Table of Contents & Knowledge Domains"), F.lit(""),
        F.lit("| Domain | Folder | Notes Count | Key Themes |"), F.lit("|---|---|---|---|"),
    )
    return totals.select(F.posexplode(lines).alias("line_no", "line")).select(
        F.lit(0).alias("section"), F.lit(0).alias("chapter"), F.lit("").alias("file_path"), "line_no", "line"
    )


def _table(numbered: DataFrame) -> DataFrame:
    row = F.concat(
        F.lit("| **"), F.upper("category"), F.lit("** | `/"), F.col("category"), F.lit("` | "),
        F.col("n").cast("string"), F.lit(" | "), theme(F.col("category"), TABLE_THEME_DEFAULT), F.lit(" |"),
    )
    return numbered.select(
        F.lit(1).alias("section"), "chapter", F.lit("").alias("file_path"), F.lit(0).alias("line_no"),
        row.alias("line"),
    )


def _chapter_heads(numbered: DataFrame) -> DataFrame:
    lines = F.array(
        F.concat(
            F.lit("# Chapter "), F.col("chapter").cast("string"), F.lit(": "), F.upper("category"),
            F.lit(" ("), F.col("n").cast("string"), F.lit(" Document Sources)"),
        ),
        F.concat(F.lit("*"), theme(F.col("category"), CHAPTER_THEME_DEFAULT), F.lit("*\n")),
    )
    return numbered.select("chapter", F.posexplode(lines).alias("line_no", "line")).select(
        F.lit(3).alias("section"), "chapter", F.lit("").alias("file_path"), "line_no", "line"
    )


def compendium_lines(notes: DataFrame, generated: Column | None = None) -> DataFrame:
    """The document as rows `section, chapter, file_path, line_no, line`; sort by `ORDER`.

    No chapter is ever collected: a note becomes its lines in one projection,
    and the global sort by `ORDER` alone makes the document.
    """
    generated = F.current_timestamp() if generated is None else generated
    valid = notes.filter(~F.col("is_failed"))
    counts = materialize(catalog(notes))
    numbered = chapters(counts)
    rule = counts.agg(F.count("*").alias("_")).select(
        F.lit(2).alias("section"), F.lit(0).alias("chapter"), F.lit("").alias("file_path"),
        F.lit(0).alias("line_no"), F.lit("\n---\n").alias("line"),
    )
    bodies = (
        valid.join(small_side(numbered.select("category", "chapter")), "category")
        .select("chapter", "file_path", F.posexplode(note_lines()).alias("line_no", "line"))
        .select(F.lit(3).alias("section"), "chapter", "file_path", "line_no", "line")
    )
    parts = [_header(catalog_totals(counts), generated), _table(numbered), rule, _chapter_heads(numbered), bodies]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_compendium(lines: DataFrame, path: str) -> None:
    """Write the document as text files whose names sort in document order.

    The sort partitions by range, so concatenating the files in name order is
    the document; nothing passes through one task.
    """
    lines.orderBy(*ORDER).select("line").write.mode("overwrite").text(path)
