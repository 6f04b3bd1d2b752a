"""The jobs a user calls. Each returns frames; writing them is a separate step (a dry run skips it)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcurate.functions.notes import parse_notes
from linkcurate.functions.render import note_date
from linkcurate.functions.urls import effective_source
from linkcurate.operators import extract
from linkcurate.operators.compendium import compendium_lines
from linkcurate.operators.links import message_links, one_per_url
from linkcurate.operators.registry import (
    apply_moves, reprocess_candidates, skip_processed, sync_with_notes, upsert,
)
from linkcurate.operators.reminders import job_reminders
from linkcurate.operators.reorganize import Reorganisation, files_after, reorganise
from linkcurate.operators.resolve import resolve_paths
from linkcurate.operators.stats import session_outcomes
from linkcurate.operators.tiles import tile_arrays
from linkcurate.operators.triage import BatchModel, Model, triage
from linkcurate.rules import CATEGORY_PATTERNS
from linkcurate.schemas import SCRAPED
from linkcurate.sources.messages import message_scan
from linkcurate.sources.notes import note_scan
from linkcurate.sources.tables import materialize
from linkcurate.sources.vault import note_files, work_order


@dataclass(frozen=True)
class Fetched:
    """What was fetched for the links, one table per source; each may be missing."""

    pages: DataFrame | None = None     # url, html [, visual_tiles]
    threads: DataFrame | None = None   # url, source_type, title, text, visual_tiles
    readmes: DataFrame | None = None   # url, pos, status, text
    papers: DataFrame | None = None    # url, xml
    videos: DataFrame | None = None    # url, metadata, transcript
    clutter: dict | None = None        # arguments for `functions.html.strip_clutter`
    # Pieces, put together for open links only: posts of a thread, tracks and snippets of a video, sizes of page images.
    posts: DataFrame | None = None     # url, pos, text [, title]
    tracks: DataFrame | None = None    # url, lang, pos
    snippets: DataFrame | None = None  # url, track (pos of the track), pos, text
    video_metadata: DataFrame | None = None  # url, metadata
    images: DataFrame | None = None    # url, width, height; cut into tiles under `attachments`
    attachments: str = "attachments"
    errors: DataFrame | None = None    # url, error: fetching it raised; the item fails and is counted


def assembled(todo: DataFrame, fetched: Fetched) -> Fetched:
    """`fetched` with its pieces put together: threads from posts, videos from tracks, tiles from image sizes.

    Pieces of links that are not in `todo` (one row per `url`) are dropped before anything is joined or sorted.
    """
    wanted = todo.select("url", effective_source(F.col("url")).alias("source_type"))

    def of(table: DataFrame | None, *sources: str) -> DataFrame | None:
        rows = wanted.filter(F.col("source_type").isin(*sources)) if sources else wanted
        return None if table is None else table.join(rows.select("url"), "url", "left_semi")

    made: dict[str, DataFrame] = {}
    images = None if fetched.images is None else tile_arrays(of(fetched.images), fetched.attachments)
    if fetched.posts is not None and fetched.threads is None:
        made["threads"] = extract.assemble_threads(of(fetched.posts, "x", "linkedin"), of(images, "x", "linkedin"))
    if fetched.snippets is not None and fetched.tracks is not None and fetched.videos is None:
        made["videos"] = extract.assemble_videos(
            of(fetched.tracks, "youtube"), of(fetched.snippets, "youtube"), of(fetched.video_metadata, "youtube")
        )
    if images is not None and fetched.pages is not None and "visual_tiles" not in fetched.pages.columns:
        taken = ["web"] if "threads" in made else ["web", "x", "linkedin"]
        made["pages"] = extract.with_images(of(fetched.pages), of(images, *taken))
    return replace(fetched, **made)


#: Routes whose links are tried as plain pages when their own material gives nothing.
FALLS_BACK = ("github", "arxiv", "x", "linkedin")


def captures(todo: DataFrame, fetched: Fetched, *, force_visual: bool = False) -> DataFrame:
    """Captures of the links in `todo` (one row per `url`), with its other columns.

    Material is joined before it is parsed, so pages of links that are skipped
    are never looked into. A link without material is a failed capture. Of
    several rows for one link a fixed one is taken, by a combining aggregation.
    A repository, paper or social page whose own material is missing or failed
    falls back to the page at its address, if that was fetched.
    """
    routed = todo.withColumn("source_type", effective_source(F.col("url"), force_visual=force_visual))

    def of(source: list[str], table: DataFrame) -> DataFrame:
        wanted = table.join(routed.filter(F.col("source_type").isin(source)).select("url"), "url", "left_semi")
        if "pos" in table.columns:  # several candidates per link; the first usable one is chosen later
            return wanted
        rest = [c for c in table.columns if c != "url"]
        one = wanted.groupBy("url").agg(F.min(F.struct(F.xxhash64(*rest).alias("_h"), *rest)).alias("_r"))
        return one.select("url", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*table.columns)

    branches = [
        (fetched.threads, ["x", "linkedin"], extract.capture_threads),
        (fetched.readmes, ["github"], extract.capture_repositories),
        (fetched.papers, ["arxiv"], extract.capture_papers),
        (fetched.videos, ["youtube"], extract.capture_videos),
    ]
    found = None
    for table, sources, capture in branches:
        if table is not None:
            rows = capture(of(sources, table))
            found = rows if found is None else found.unionByName(rows)
    nothing = extract.captured(
        routed, F.col("source_type"), F.lit(None).cast("string"), F.lit(None).cast("string"),
        F.lit(extract.NOT_CAPTURED),
    )
    both, first = nothing.alias("n"), F.lit(None)
    if found is not None:
        both = both.join(found.alias("f"), "url", "left")
        first = F.when(F.col("f.failed_scrape").isNotNull(), F.lit("f"))
    if fetched.pages is not None:
        pages = extract.capture_pages(of(["web", *FALLS_BACK], fetched.pages), strip_kwargs=fetched.clutter)
        both = both.join(pages.alias("p"), "url", "left")
        good = F.lit(False) if found is None else F.coalesce(~F.col("f.failed_scrape"), F.lit(False))
        first = F.when(good, F.lit("f")).when(F.col("p.failed_scrape").isNotNull(), F.lit("p")).otherwise(first)
    both = both.withColumn("_of", first)

    def chosen(column: str) -> Column:
        value = F.col(f"n.{column}")
        for side, table in (("f", found), ("p", fetched.pages)):
            if table is not None:
                value = F.when(F.col("_of") == side, F.col(f"{side}.{column}")).otherwise(value)
        return value.alias(column)

    return both.select("url", *[chosen(c) for c in SCRAPED.fieldNames() if c != "url"]).join(todo, "url")


@dataclass(frozen=True)
class Ingested:
    """Result of an ingestion. Triage rows and paths are stored once; the frames join them by link."""

    items: DataFrame      # triage columns, message_id, date, target_path, is_overwrite
    results: DataFrame    # url, title, category, type, target_path, is_overwrite, visual_tiles
    notes: DataFrame      # schemas.NOTE_FILES
    updates: DataFrame    # schemas.REGISTRY rows to upsert
    reminders: DataFrame
    errors: DataFrame     # url, error, failed: links that raised and failed, and links that no model answered, which are processed by default values
    outcomes: DataFrame   # processed, skipped, failed

    def registry_after(self, registry: DataFrame) -> DataFrame:
        return upsert(registry, self.updates)

    def checkpoint_updates(self) -> DataFrame:
        """Checkpoint rows for the last link worked on; the feed runs newest first."""
        last = self.items.filter(F.col("message_id").isNotNull()).orderBy(
            F.asc_nulls_last("date"), "message_id", F.desc("pos")
        ).limit(1)
        return last.select(
            F.explode(F.create_map(
                F.lit("last_processed_message_id"), F.col("message_id").cast("string"),
                F.lit("last_processed_url"), F.col("url"),
            )).alias("key", "value"),
            F.col("processed_at").alias("updated_at"),
        )


def _work_on(
    todo: DataFrame,
    links: DataFrame,
    registry: DataFrame,
    files: DataFrame,
    fetched: Fetched,
    vault: str,
    now: Column,
    *,
    model: Model | BatchModel | None,
    fallback: Model | BatchModel | None,
    rules: Mapping[str, list[str]],
    force_visual: bool,
    mode: str,
    again: bool = False,
) -> Ingested:
    todo = materialize(todo.select("url", "message_id", "date", "pos", "hits"), "todo")
    tried, lost = todo, None
    if fetched.errors is not None:
        lost = fetched.errors.join(todo.select("url"), "url", "left_semi").groupBy("url").agg(F.min("error").alias("error"))
        lost = materialize(lost, "lost")
        todo = materialize(todo.join(lost, "url", "left_anti"), "todo")
    # Stored, because triage reads failed and open captures apart, and its filters would parse all material again each time.
    scraped = materialize(captures(todo, assembled(todo, fetched), force_visual=force_visual), "captures")
    triaged = triage(
        scraped.withColumn("_day", note_date(F.col("date"), now)), F.col("_day"),
        model=model, fallback=fallback, rules=rules,
    )
    placed = resolve_paths(materialize(triaged, "triaged"), registry, files, vault, mode)
    items = _overwriting(placed.join(todo, "url").withColumn("processed_at", now), again)
    results = items.select(
        "url", "title", "category", F.col("item_type").alias("type"), "target_path", "is_overwrite",
        F.transform("visual_tiles", lambda t: t["path"]).alias("visual_tiles"),
    )
    updates = items.select(
        "url", "title", F.col("target_path").alias("file_path"), "category", "item_type",
        F.col("message_id").alias("telegram_message_id"), "processed_at",
        F.sha2(F.coalesce("original_text", F.lit("")), 256).alias("content_hash"),
    )
    errors = items.filter(F.col("error").isNotNull()).select("url", "error", F.lit(False).alias("failed"))
    if lost is not None:
        errors = errors.unionByName(lost.select("url", "error", F.lit(True).alias("failed")))
    outcomes = session_outcomes(tried, links, lost)
    return Ingested(items, results, note_files(items), updates, job_reminders(items, now), errors, outcomes)


def _overwriting(items: DataFrame, again: bool) -> DataFrame:
    """`is_overwrite` also where the run itself wrote the file before: for an item on the same path that was worked on
    earlier, or, if links are worked on `again` at every hit, for an earlier hit of the link."""
    order = work_order(items)
    first = items.groupBy("target_path").agg(F.min(order).alias("_first"))
    met = F.col("is_overwrite") | (order != F.col("_first"))
    if again:
        met = met | (F.col("hits") > 1)
    return items.join(first, "target_path").withColumn("is_overwrite", met).select(*items.columns)


def ingest(
    messages: DataFrame,
    registry: DataFrame,
    files: DataFrame,
    fetched: Fetched,
    vault: str,
    *,
    since: Column | None = None,
    limit: int | None = None,
    session: bool = False,
    reprocess: bool = False,
    now: Column | None = None,
    model: Model | BatchModel | None = None,
    fallback: Model | BatchModel | None = None,
    rules: Mapping[str, list[str]] = CATEGORY_PATTERNS,
    force_visual: bool = False,
    mode: str = "prefix",
) -> Ingested:
    """Ingest the links of messages.

    A batch (`session=False`) works on every link and its oldest message counts.
    A session skips links whose note exists, before anything is parsed, and the
    newest message counts; `reprocess` switches the skipping off.
    """
    hits = message_links(message_scan(messages, since, limit))
    redo = reprocess or not session
    links = materialize(one_per_url(hits, "oldest" if redo else "newest"), "links")
    todo = links if redo else skip_processed(links, registry, files)
    return _work_on(
        todo, links, registry, files, fetched, vault, F.current_timestamp() if now is None else now,
        model=model, fallback=fallback, rules=rules, force_visual=force_visual, mode=mode, again=redo,
    )


def ingest_links(
    links: DataFrame,
    registry: DataFrame,
    files: DataFrame,
    fetched: Fetched,
    vault: str,
    *,
    now: Column | None = None,
    model: Model | BatchModel | None = None,
    fallback: Model | BatchModel | None = None,
    rules: Mapping[str, list[str]] = CATEGORY_PATTERNS,
    force_visual: bool = False,
    mode: str = "prefix",
) -> Ingested:
    """Ingest given links (`url`) without a feed; each distinct one is worked on once and its note gets today's date."""
    todo = links.filter(F.coalesce(F.col("url"), F.lit("")) != "").groupBy("url").agg(F.count("*").alias("hits")).select(
        "url", F.lit(None).cast("bigint").alias("message_id"), F.lit(None).cast("timestamp").alias("date"), F.lit(0).alias("pos"), "hits"
    )
    todo = materialize(todo)
    return _work_on(
        todo, todo, registry, files, fetched, vault, F.current_timestamp() if now is None else now,
        model=model, fallback=fallback, rules=rules, force_visual=force_visual, mode=mode,
    )


def reprocess_failed(
    registry: DataFrame,
    files: DataFrame,
    fetched: Fetched,
    vault: str,
    *,
    limit: int | None = None,
    now: Column | None = None,
    model: Model | BatchModel | None = None,
    fallback: Model | BatchModel | None = None,
    rules: Mapping[str, list[str]] = CATEGORY_PATTERNS,
    mode: str = "prefix",
) -> Ingested:
    """Work again on unsorted, failed and re-extractable records; their notes get today's date."""
    todo = reprocess_candidates(registry, limit).select(
        "url", F.col("telegram_message_id").alias("message_id"),
        F.lit(None).cast("timestamp").alias("date"), F.lit(0).alias("pos"), F.lit(1).alias("hits"),
    )
    todo = materialize(todo)
    return _work_on(
        todo, todo, registry, files, fetched, vault, F.current_timestamp() if now is None else now,
        model=model, fallback=fallback, rules=rules, force_visual=False, mode=mode,
    )


@dataclass(frozen=True)
class Reorganised:
    plan: Reorganisation
    files: DataFrame
    registry: DataFrame


def reorganize(
    files: DataFrame, registry: DataFrame, vault: str, rules: Mapping[str, list[str]] = CATEGORY_PATTERNS
) -> Reorganised:
    """Sort the notes of `other`, and the files and registry that follow."""
    plan = reorganise(parse_notes(note_scan(files, "other")), vault, rules)
    return Reorganised(plan, files_after(files, plan), apply_moves(registry, plan.moves))


def sync_registry(registry: DataFrame, files: DataFrame) -> DataFrame:
    return sync_with_notes(registry, note_scan(files))


def compendium(files: DataFrame, generated: Column | None = None, **parse: Callable) -> DataFrame:
    """Lines of the compiled document over all valid notes."""
    return compendium_lines(parse_notes(note_scan(files), **parse), generated)
