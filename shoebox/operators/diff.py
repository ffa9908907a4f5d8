"""Change detection between a file listing and the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.operators.skew import lookup_join


def unchanged(size: Column, mtime: Column, old_size: Column, old_mtime: Column, old_format: Column) -> Column:
    """Same size, same time (null equals null), and a format on record."""
    return F.coalesce(size == old_size, F.lit(False)) & mtime.eqNullSafe(old_mtime) & old_format.isNotNull()


def compare(listing: DataFrame, media: DataFrame) -> DataFrame:
    """One row per path known to either side, with an ``action``.

    One full outer join on the absolute path, which is unique on both sides:
    ``new``, ``changed``, ``restored`` (unchanged but marked missing before),
    ``same``, ``absent`` (present in the catalogue, not listed) or ``gone``
    (already missing).  All catalogue columns are carried, prefixed ``old_``, so
    nothing later needs to be joined back.
    """
    old = media.select(F.col("absolute_path").alias("path"), *[F.col(c).alias(f"old_{c}") for c in media.columns])
    both = listing.select("path", "size", "mtime", F.lit(True).alias("_listed")).join(old, "path", "full_outer")
    same = unchanged(
        F.col("size"), F.col("mtime"), F.col("old_file_size"), F.col("old_modified_at"), F.col("old_format")
    )
    was_present = F.coalesce("old_is_present", F.lit(True))
    action = (
        F.when(F.col("_listed").isNull(), F.when(was_present, "absent").otherwise("gone"))
        .when(F.col("old_id").isNull(), "new")
        .when(~same, "changed")
        .when(was_present, "same")
        .otherwise("restored")
    )
    return both.withColumn("action", action).drop("_listed")


def assign_folders(files: DataFrame, folders: DataFrame, root_id: Column, rows: int = 0) -> DataFrame:
    """``folder_id`` of each ``path``: the folder of its parent directory, else
    the import root.  One directory may hold a large share of the files.  ``rows`` is how
    many folders there are, where that is known."""
    known = folders.select(F.col("path").alias("_dir"), F.col("id").alias("_folder"))
    placed = lookup_join(files.withColumn("_dir", paths.parent_dir("path")), known, "_dir", "left", ["path"], rows)
    return placed.withColumn("folder_id", F.coalesce("_folder", root_id)).drop("_dir", "_folder")


def shielded(absent: DataFrame, unlisted: DataFrame) -> DataFrame:
    """Absent rows that lie below a directory that was not listed (failed,
    skipped, excluded): nothing is known about them.  Works on the directories
    of the absent rows, not on the rows."""
    keyed = absent.withColumn("_dir", paths.parent_dir("path"))
    climbs = keyed.select("_dir").distinct().select("_dir", F.explode(paths.ancestor_paths("_dir")).alias("path"))
    hidden = climbs.join(unlisted.select("path"), "path", "left_semi").select("_dir").distinct()
    return keyed.join(hidden, "_dir", "left_semi").drop("_dir")
