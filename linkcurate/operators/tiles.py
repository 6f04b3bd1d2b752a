"""Cutting tall page images into tiles (geometry and file names only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkcurate.functions.urls import host_bucket, slug
from linkcurate.rules import MAX_TILES, TILE_HEIGHT


def tile_count(height: Column, tile_height: int = TILE_HEIGHT) -> Column:
    return F.greatest(F.ceil(height / tile_height), F.lit(1)).cast("int")


def tile_grid(images: DataFrame, tile_height: int = TILE_HEIGHT, max_tiles: int | None = None) -> DataFrame:
    """One row per tile of each image (`width`, `height`): `index, top, bottom, tile_height`."""
    count = tile_count(F.col("height"), tile_height)
    if max_tiles is not None:
        count = F.least(count, F.lit(max_tiles))
    top = F.col("index") * tile_height
    return (
        images.withColumn("index", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("top", top)
        .withColumn("bottom", F.least(top + tile_height, F.col("height")))
        .withColumn("tile_height", F.col("bottom") - F.col("top"))
    )


def tile_name(url: Column, index: Column) -> Column:
    return F.concat(
        slug(url), F.lit("_"), host_bucket(url).cast("string"),
        F.format_string("_tile_%02d.jpg", index),
    )


def tile_manifest(
    images: DataFrame, attachments: str, tile_height: int = TILE_HEIGHT, max_tiles: int = MAX_TILES
) -> DataFrame:
    """Tiles to store per page image (`url, width, height`): at most `max_tiles`, from the top."""
    grid = tile_grid(images, tile_height, max_tiles)
    return grid.select(
        "url",
        F.concat(F.lit(attachments.rstrip("/") + "/"), tile_name(F.col("url"), F.col("index"))).alias("path"),
        "index", "width", F.col("tile_height").cast("int").alias("height"),
    )


def tile_arrays(images: DataFrame, attachments: str, **kwargs) -> DataFrame:
    """`url, visual_tiles`, the manifest as one array per page (images have one row per `url`)."""
    rows = tile_manifest(images, attachments, **kwargs)
    tile = F.struct("index", "path", "width", "height")
    ordered = F.array_sort(F.collect_list(tile))
    return rows.groupBy("url").agg(
        F.transform(
            ordered,
            lambda t: F.struct(
                t["path"].alias("path"), t["index"].alias("index"),
                t["width"].alias("width"), t["height"].alias("height"),
            ),
        ).alias("visual_tiles")
    )
