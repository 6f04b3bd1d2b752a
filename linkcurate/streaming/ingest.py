"""Message streams: links, dedupe, counts, and the full ingestion per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkcurate.functions.urls import source_type
from linkcurate.operators.links import message_links
from linkcurate.plans.jobs import Fetched, Ingested, ingest
from linkcurate.sources.messages import message_stream as stream_files  # noqa: F401
from linkcurate.sources.vault import Vault


def link_stream(messages: DataFrame, since: Column | None = None) -> DataFrame:
    """Links of a stream of messages after the cutoff."""
    kept = messages.filter(F.col("text") != "")
    if since is not None:
        kept = kept.filter(F.col("date").isNull() | (F.col("date") >= since))
    return message_links(kept)


def first_links(links: DataFrame, horizon: str | None = None) -> DataFrame:
    """Each link once.

    Without a horizon the state keeps every link ever seen, as the registry
    does. With one (say `7 days`) a link is remembered for that long after it
    arrived, whatever its message's date: no link is lost, in a feed that runs
    newest first too, and one that arrives again later passes; the registry
    check of the batch then catches it.
    """
    if horizon is None:
        return links.dropDuplicates(["url"])
    arrived = links.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", horizon)
    return arrived.dropDuplicatesWithinWatermark(["url"]).drop("_arrived")


def running_counts(links: DataFrame, key: Column | None = None, name: str = "source_type") -> DataFrame:
    """Count per route (or another key) so far, for complete or update mode."""
    key = source_type(F.col("url")) if key is None else key
    return links.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def ingest_batch(
    vault: Vault, fetched: Callable[[], Fetched], root: str, on_done: Callable[[Ingested, int], None] | None = None, **options
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that runs a session over each micro-batch.

    It reads the vault as of the earlier batches and merges what it made under
    its own batch number, so a batch that runs twice leaves the same tables. Of
    the registry it reads and rewrites only the buckets of its links. Empty
    batches are accepted.
    """
    def run(messages: DataFrame, batch: int) -> None:
        buckets = vault.registry.touched(message_links(messages))
        done = ingest(
            messages, vault.registry.read(batch, buckets), vault.notes.read(batch), fetched(), root,
            session=True, **options,
        )
        vault.record(done.notes, done.updates, done.checkpoint_updates(), batch)
        if on_done:
            on_done(done, batch)

    return run


def run_for(query: StreamingQuery, seconds: float) -> bool:
    """Let a query work for a time budget; True if it finished by itself.

    What it has not reached is read by the next run from the same checkpoint
    location.
    """
    finished = query.awaitTermination(seconds)
    if not finished:
        query.stop()
    return bool(finished)
