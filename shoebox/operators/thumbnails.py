"""Which thumbnails to render, and where they would be read from or written to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import thumbs


def representatives(media: DataFrame) -> DataFrame:
    """One present media row per distinct hash, the lowest id.  Copies collapse
    map-side, so a hash shared by a third of the rows costs one row per task."""
    carried = F.struct("id", "folder_id", "absolute_path", "width", "height")
    return (
        media.where("is_present").groupBy("content_hash").agg(F.min_by(carried, "id").alias("_m")).select("content_hash", "_m.*")
    )


def with_settings(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """Attach the inherited thumbnail policy of each row's folder."""
    return rows.join(settings, "folder_id", "left")


def cache_lookup(rows: DataFrame, cached: DataFrame, side: int, global_base: str, dot_dir: str = thumbs.DOT_DIR) -> DataFrame:
    """Rows with ``cached_at``: the best-placed existing thumbnail or null.

    ``cached(path)`` lists existing thumbnails.  Each row asks for at most two
    paths; both are looked up in one join and the first hit wins.
    """
    bases = thumbs.read_bases(F.col("cache_mode"), F.col("cache_folder"), F.col("root_path"), global_base, dot_dir)
    asked = rows.select("content_hash", F.posexplode(bases).alias("_rank", "_base")).withColumn(
        "path", thumbs.join_path(F.col("_base"), thumbs.sharded_key(F.col("content_hash"), side))
    )
    found = asked.join(cached.select("path").distinct(), "path", "left_semi")
    best = found.groupBy("content_hash").agg(F.min_by("path", "_rank").alias("cached_at"))
    return rows.join(best, "content_hash", "left")


def render_list(
    media: DataFrame, settings: DataFrame, cached: DataFrame, side: int, global_base: str,
    dot_dir: str = thumbs.DOT_DIR, no_cache_read: bool = False,
) -> DataFrame:
    """Thumbnails to make: one row per distinct hash of a present file that has
    none at any place it would be read from."""
    rows = with_settings(representatives(media), settings)
    if not no_cache_read:
        rows = cache_lookup(rows, cached, side, global_base, dot_dir).where(F.col("cached_at").isNull())
    size = thumbs.scaled_size(F.col("width"), F.col("height"), side)
    return rows.withColumn("_size", size).select(
        "content_hash", "id", "absolute_path",
        F.col("_size.width").alias("thumb_width"), F.col("_size.height").alias("thumb_height"),
        "root_path", "cache_mode", "cache_folder", "cache_fallback",
    )
