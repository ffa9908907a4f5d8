"""Thumbnail planning expressions: sizes, keys, cache locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dot-directory an import keeps its own thumbnails in, and the folder that
# takes over in temporary mode.  Both are plain arguments everywhere.
DOT_DIR = ".thumbnails"
TEMP_BASE = "/tmp/.thumbnails"


def scaled_size(width: Column, height: Column, side: int) -> Column:
    """``(width, height)`` after scaling the longer side to ``side``; integer
    division, at least one pixel, small images are enlarged too."""
    w, h, s = width.cast("bigint"), height.cast("bigint"), F.lit(side).cast("bigint")

    def shorter(short: Column, long: Column) -> Column:
        product = short * s
        return F.greatest(F.lit(1).cast("bigint"), ((product - product % long) / long).cast("bigint"))

    wide = w > h
    size = F.struct(
        F.when(wide, s).otherwise(shorter(w, h)).cast("int").alias("width"),
        F.when(wide, shorter(h, w)).otherwise(s).cast("int").alias("height"),
    )
    return F.when((w > 0) & (h > 0), size)


def sharded_key(content_hash: Column, side: int) -> Column:
    """``aa/bb/<hash>_<side>.webp``; a short hash contributes what it has."""
    leaf = F.concat(content_hash, F.lit(f"_{side}.webp"))
    shards = F.array(F.substr(content_hash, F.lit(1), F.lit(2)), F.substr(content_hash, F.lit(3), F.lit(2)), leaf)
    return F.array_join(F.filter(shards, lambda part: part != ""), "/")


def join_path(base: Column, leaf: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), leaf)


def _own_folder(folder: Column, root: Column, dot_dir: str) -> Column:
    return F.coalesce(F.nullif(folder, F.lit("")), join_path(root, F.lit(dot_dir)))


def read_bases(mode: Column, folder: Column, root: Column, global_base: str, dot_dir: str = DOT_DIR) -> Column:
    """Cache folders to read from, best first.  An import with its own policy
    looks in its own folder before the global one."""
    own = F.when(mode.isNotNull() & (mode != "global"), _own_folder(folder, root, dot_dir))
    return F.array_compact(F.array(own, F.lit(global_base)))


def write_path(
    mode: Column, folder: Column, root: Column, fallback: Column, writable: Column, content_hash: Column, side: int,
    global_base: str, disable_cache: bool = False, temporary_cache: bool = False,
    dot_dir: str = DOT_DIR, temp_base: str = TEMP_BASE,
) -> Column:
    """Where a new thumbnail goes, null for nowhere.

    Order of precedence: temporary mode, caching disabled, the import's mode.  A
    custom folder that cannot be written falls back to the global one only when
    the import says so.  ``writable`` is a boolean column.
    """
    key = sharded_key(content_hash, side)
    if temporary_cache:
        return join_path(F.lit(temp_base), key)
    if disable_cache:
        return F.lit(None).cast("string")
    shared = join_path(F.lit(global_base), key)
    own = _own_folder(folder, root, dot_dir)
    mode = F.coalesce(mode, F.lit("global"))
    custom = F.when(own.isNull(), F.lit(None).cast("string")).when(writable, join_path(own, key)).when(
        F.coalesce(fallback, F.lit("disable")) == "global", shared
    )
    return F.when(mode == "disabled", F.lit(None).cast("string")).when(mode == "custom", custom).otherwise(shared)
