"""Turning fetched material into captures (`schemas.SCRAPED`), one function per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcurate.functions import feeds
from linkcurate.functions.html import main_text, page_title
from linkcurate.functions.quality import has_visuals, integrity_reason
from linkcurate.functions.text import clean_spoken, strip
from linkcurate.functions.urls import paper_id, repository, source_type, video_id, watch_url
from linkcurate.operators.assemble import FEED_SEPARATOR, POST_SEPARATOR, first_usable, joined_texts, preferred_tracks, thread_separator
from linkcurate.operators.triage import UNTITLED
from linkcurate.rules import MIN_TEXT
from linkcurate.schemas import SCRAPED

NOT_CAPTURED = "No captured material for this link"


def captured(
    frame: DataFrame,
    source: str | Column,
    title: Column,
    text: Column,
    reason: Column,
    tiles: Column | None = None,
) -> DataFrame:
    """Shape columns into captures; a reason means the capture failed."""
    frame = frame.withColumn("_reason", reason)
    return frame.select(
        "url",
        F.coalesce(F.nullif(title, F.lit("")), F.lit(UNTITLED)).alias("title"),
        strip(F.coalesce(text, F.lit(""))).alias("text"),
        (F.lit(source) if isinstance(source, str) else source).alias("source_type"),
        F.col("_reason").isNotNull().alias("failed_scrape"),
        F.col("_reason").alias("failure_reason"),
        F.array().cast("array<string>").alias("code_snippets"),
        F.coalesce(tiles if tiles is not None else F.lit(None), F.array())
        .cast(SCRAPED["visual_tiles"].dataType).alias("visual_tiles"),
    ).select(*SCRAPED.fieldNames())


def capture_pages(pages: DataFrame, *, strip_kwargs: dict | None = None) -> DataFrame:
    """Web pages (`url, html`, optionally `visual_tiles`).

    Images stand in only for a text that is too short; such a page is not failed.
    """
    tiles = F.col("visual_tiles") if "visual_tiles" in pages.columns else F.lit(None).cast(SCRAPED["visual_tiles"].dataType)
    body = pages.withColumn("_text", main_text(F.col("html"), strip_kwargs=strip_kwargs))
    long_enough = F.length("_text") >= MIN_TEXT
    reason = F.when(long_enough | ~has_visuals(tiles), integrity_reason(F.col("_text")))
    return captured(
        body, "web", page_title(F.col("html")), F.col("_text"), reason, F.when(~long_enough, tiles)
    )


def capture_threads(threads: DataFrame) -> DataFrame:
    """Posts of social sites (`url, source_type, title, text, visual_tiles`)."""
    tiles = F.col("visual_tiles")
    reason = F.when(~has_visuals(tiles), integrity_reason(F.col("text")))
    title = F.coalesce(
        F.nullif("title", F.lit("")), F.concat(F.initcap("source_type"), F.lit(" Document"))
    )
    return captured(threads, F.col("source_type"), title, F.col("text"), reason, tiles)


def capture_repositories(responses: DataFrame) -> DataFrame:
    """Readme responses per repository link (`url, pos, status, text`)."""
    title = F.concat(F.lit("GitHub - "), repository(F.col("url")))
    return captured(
        first_usable(responses), "github", title, F.col("text"), integrity_reason(F.col("text"))
    )


def capture_papers(entries: DataFrame) -> DataFrame:
    """Paper feeds (`url, xml`); papers bypass the integrity check."""
    paper = (
        entries.withColumn("_id", paper_id(F.col("url")))
        .withColumn("_title", feeds.paper_title(F.col("xml"), F.col("_id")))
    )
    text = feeds.paper_text(
        F.col("_title"), feeds.paper_authors(F.col("xml")), F.col("_id"), feeds.paper_abstract(F.col("xml"))
    )
    return captured(paper, "arxiv", F.col("_title"), text, F.lit(None).cast("string"))


def capture_videos(videos: DataFrame) -> DataFrame:
    """Videos (`url, metadata, transcript`), transcripts cleaned; they bypass the integrity check."""
    video = (
        videos.withColumn("_title", feeds.video_title(F.col("metadata")))
        .withColumn("_spoken", clean_spoken(F.col("transcript")))
    )
    text = feeds.video_text(
        F.col("_title"), feeds.video_channel(F.col("metadata")),
        watch_url(video_id(F.col("url"))), F.col("_spoken"),
    )
    return captured(
        video, "youtube", F.col("_title"), text, feeds.video_failure(F.col("_title"), F.col("_spoken"))
    )


def assemble_threads(posts: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Threads for `capture_threads` from posts in order (`url, pos, text`, optionally `title`) and images (`url, visual_tiles`).

    Posts of one address are joined with the separator of its site, in two steps, so that no task holds a whole long thread. The title
    is that of the first post that has one. An address with images and no posts is a thread without text.
    """
    titled = "title" in posts.columns
    whole = None
    for separator in (POST_SEPARATOR, FEED_SEPARATOR):
        mine = posts.filter(thread_separator(F.col("url")) == separator)
        texts = joined_texts(mine, ["url"], separator=separator)
        whole = texts if whole is None else whole.unionByName(texts)
    if titled:
        heads = posts.filter(F.coalesce("title", F.lit("")) != "").groupBy("url").agg(F.min_by("title", "pos").alias("title"))
        whole = whole.join(heads, "url", "full")
    else:
        whole = whole.withColumn("title", F.lit(None).cast("string"))
    return with_images(whole, images).withColumn("source_type", source_type(F.col("url"))).select("url", "source_type", "title", "text", "visual_tiles")


def assemble_videos(tracks: DataFrame, snippets: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Videos for `capture_videos` from their tracks (`url, lang, pos`), snippets (`url, track, pos, text`) and `url, metadata`.

    Of the tracks the preferred one is taken (`track` is its `pos`), and only its snippets are joined. A video without a track, or
    without metadata, has that part NULL.
    """
    best = preferred_tracks(tracks.withColumnRenamed("url", "video_id")).select(F.col("video_id").alias("url"), F.col("pos").alias("track"))
    spoken = joined_texts(snippets.join(best, ["url", "track"], "left_semi"), ["url"]).withColumnRenamed("text", "transcript")
    if metadata is None:
        return spoken.select("url", F.lit(None).cast("string").alias("metadata"), "transcript")
    return metadata.select("url", "metadata").join(spoken, "url", "full").select("url", "metadata", "transcript")


def with_images(rows: DataFrame, images: DataFrame | None) -> DataFrame:
    """`rows` (one per `url`) with `visual_tiles`, and a row for each address that has images only."""
    if images is None:
        return rows.withColumn("visual_tiles", F.lit(None).cast(SCRAPED["visual_tiles"].dataType))
    return rows.join(images.select("url", "visual_tiles"), "url", "full")
