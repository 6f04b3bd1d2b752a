"""Where the note of a link goes: stored path, moved note, or a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkcurate.functions.notes import file_name, note_head
from linkcurate.functions.render import note_path
from linkcurate.functions.text import SPACE_CLASS
from linkcurate.operators.joins import is_small, join_unique
from linkcurate.sources.tables import materialize

SHORTEST_URL = 11  # http://a.bc
_TO_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*"


def note_addresses(files: DataFrame) -> DataFrame:
    """Values that follow `url: ` in the first lines of each note: `file_path, address, quoted`."""
    found = F.regexp_extract_all(
        note_head(F.col("content")), F.lit(rf"(?U)url: ([^{SPACE_CLASS}]+)"), F.lit(1)
    )
    value = files.select("file_path", F.explode(F.array_distinct(found)).alias("_v"))
    inner = F.regexp_extract("_v", r"""^(["'])(.*?)\1""", 2)
    quoted = inner != ""
    return value.select(
        "file_path", F.when(quoted, inner).otherwise(F.col("_v")).alias("address"), quoted.alias("quoted")
    )


def moved_by_address(urls: DataFrame, files: DataFrame, mode: str = "prefix") -> DataFrame:
    """Links (distinct `url`) with the first note that carries them in its head: `url, moved_path`.

    In prefix mode an unquoted address also answers for the links it begins
    with, so a note of `.../ab` is found for `.../a`. An address is cut only at
    lengths that occur among the links of its own host, and, for links that end
    within a host, among those: so the rows made grow with the addresses, not
    with their lengths. The cuts are joined by equality. A counted-small set of
    links is broadcast to them; otherwise they are reduced to one note each,
    partly before the shuffle, and then joined.
    """
    if mode not in ("prefix", "exact"):
        raise ValueError(f"mode must be 'prefix' or 'exact', not {mode!r}")
    address = note_addresses(files)
    keys = address.select("file_path", F.col("address").alias("url"))
    if mode == "prefix":
        open_ = address.filter(~F.col("quoted") & (F.length("address") > SHORTEST_URL))
        keys = keys.unionByName(_cut_addresses(open_.select("file_path", "address"), urls))
    first = F.min("file_path").alias("moved_path")
    if is_small(urls):
        return keys.join(F.broadcast(urls), "url").groupBy("url").agg(first)
    return urls.join(keys.groupBy("url").agg(first), "url")


def _cut_addresses(addresses: DataFrame, urls: DataFrame) -> DataFrame:
    """Beginnings (`file_path, url`) of addresses that a link of `urls` may be."""
    cut = lambda rows: rows.select("file_path", F.expr("substring(address, 1, _size)").alias("url"))
    hosted = addresses.withColumn("_host", F.lower(F.regexp_extract("address", _TO_HOST, 0)))
    known = urls.select(F.lower(F.regexp_extract("url", _TO_HOST, 0)).alias("_host"), F.length("url").alias("_size"), F.col("url"))
    # Links that go on after their host: the lengths met with this host. Lengths are bounded by those of links.
    longer = known.filter(F.col("_size") > F.length("_host")).groupBy("_host").agg(F.collect_set("_size").alias("_sizes"))
    same = join_unique(hosted, longer, "_host", "file_path", "inner")
    inside = cut(same.withColumn("_size", F.explode("_sizes")).filter(F.col("_size") < F.length("address")))
    # Links that are a host alone: it may be the beginning of another host.
    bare = known.filter(F.col("_size") <= F.length("_host")).select("_size").distinct()
    sizes = [r._size for r in bare.collect()]
    if not sizes:
        return inside
    within = F.filter(F.array(*map(F.lit, sorted(sizes))), lambda n: (n <= F.length("_host")) & (n < F.length("address")))
    return inside.unionByName(cut(hosted.withColumn("_size", F.explode(within))))


def notes_by_name(files: DataFrame) -> DataFrame:
    """First path per base name: `file_name, named_path`."""
    return files.groupBy("file_name").agg(F.min("file_path").alias("named_path"))


def resolve_paths(
    items: DataFrame, registry: DataFrame, files: DataFrame, vault: str, mode: str = "prefix"
) -> DataFrame:
    """Add `target_path` and `is_overwrite` to items (one row per `url`, with `category`, `title`).

    A stored path that still exists is reused. A registered note that moved is
    found by its address, then by its file name. Everything else gets
    `{vault}/{category}/{safe title}.md`; the flag tells whether that exists.

    All lookups run on links and paths alone; the items, texts and all, meet
    the decision in one join at the end.
    """
    stored = registry.select("url", F.col("file_path").alias("_stored"))
    known = materialize(
        items.select("url", note_path(vault, F.col("category"), F.col("title")).alias("_default"))
        .join(stored, "url", "left").withColumn("_name", file_name(F.col("_stored")))
    )
    paths = files.select("file_path").distinct()
    has_stored = paths.select(F.col("file_path").alias("_stored"), F.lit(True).alias("_at_stored"))
    has_default = paths.select(F.col("file_path").alias("_default"), F.lit(True).alias("_at_default"))

    placed = join_unique(known, has_stored, "_stored", "url", counted=known)
    placed = join_unique(placed, has_default, "_default", "url", counted=known)
    lost = known.filter(F.col("_stored").isNotNull()).join(
        paths.withColumnRenamed("file_path", "_stored"), "_stored", "left_anti"
    )
    by_address = moved_by_address(lost.select("url"), files, mode)
    by_name = notes_by_name(files).withColumnRenamed("file_name", "_name")
    placed = join_unique(placed.join(by_address, "url", "left"), by_name, "_name", "url", counted=known)

    moved = F.when(F.col("_stored").isNotNull(), F.coalesce("moved_path", "named_path"))
    decided = materialize(placed.select(
        "url",
        F.when(F.col("_at_stored"), F.col("_stored"))
        .otherwise(F.coalesce(moved, F.col("_default"))).alias("target_path"),
        (F.coalesce("_at_stored", "_at_default", F.lit(False)) | moved.isNotNull()).alias("is_overwrite"),
    ), "paths")
    return items.join(decided, "url")
