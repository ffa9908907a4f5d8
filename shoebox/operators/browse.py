"""Listings, counts, keyset pages and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import json_cols, paths
from shoebox.operators.hierarchy import subtree
from shoebox.schemas import FOLDER_COLUMNS, MEDIA_FILE_COLUMNS, SUMMARY_COLUMNS

SORT_KEYS = ("filename", "size", "date_created", "date_modified", "score")


def media_files(media: DataFrame) -> DataFrame:
    return media.select(*[F.col(c).cast("boolean") if c == "is_present" else F.col(c) for c in MEDIA_FILE_COLUMNS])


def summaries(media: DataFrame) -> DataFrame:
    return media.select(*SUMMARY_COLUMNS, F.lit(None).cast("float").alias("search_score"))


def parse_folders(raw: DataFrame) -> DataFrame:
    """Folder rows whose pattern lists arrive as JSON text; a bad list is empty."""
    lists = {"exclude", "include"}
    return raw.select(*[json_cols.string_list(F.col(c)).alias(c) if c in lists else F.col(c) for c in FOLDER_COLUMNS])


# scopes -------------------------------------------------------------------


def in_folder(media: DataFrame, folder_id: int) -> DataFrame:
    return media.where(F.col("folder_id") == F.lit(folder_id).cast("bigint"))


def in_subtree(media: DataFrame, tree: DataFrame, folder_id: int) -> DataFrame:
    """Media of a folder and all below; ``tree`` is the folder table or a closure.
    Media stand on the left of a semi-join: adaptive execution broadcasts a scope that
    proves small, and else splits the media of a hot folder."""
    scope = subtree(tree, folder_id).select(F.col("id").alias("folder_id"))
    return media.join(scope, "folder_id", "left_semi").select(*media.columns)


def in_path_scope(media: DataFrame, folders: DataFrame, folder_id: int) -> DataFrame:
    """The scope spelled as a path prefix: the folder, or any folder whose path
    starts with its path and a separator.  The root's path is a scalar subquery,
    so folders are filtered, not joined."""
    root_path = folders.where(F.col("id") == F.lit(folder_id).cast("bigint")).select("path").scalar()
    scope = folders.where(
        (F.col("id") == F.lit(folder_id).cast("bigint")) | F.startswith(F.col("path"), F.concat(root_path, F.lit("/")))
    ).select(F.col("id").alias("folder_id"))
    return media.join(scope, "folder_id", "left_semi").select(*media.columns)


def scoped(media: DataFrame, tree: DataFrame, folder_id: int, recursive: bool) -> DataFrame:
    return in_subtree(media, tree, folder_id) if recursive else in_folder(media, folder_id)


def hydrate(media: DataFrame, ids: DataFrame, tree: DataFrame, folder_id: int, recursive: bool) -> DataFrame:
    """Summaries of the wanted ``ids(id)`` inside a scope, by id."""
    wanted = scoped(media, tree, folder_id, recursive).join(ids.select("id"), "id", "left_semi")
    return summaries(wanted).orderBy("id")


# lookups ------------------------------------------------------------------


def by_id(media: DataFrame, media_id: int) -> DataFrame:
    return media_files(media.where(F.col("id") == F.lit(media_id).cast("bigint")))


def by_ids(media: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookups in bulk: the rows for every requested ``ids(id)``."""
    return media_files(media.join(ids.select("id"), "id", "left_semi"))


def by_relative_path(media: DataFrame, folder_id: int, relative_path: str) -> DataFrame:
    return media_files(in_folder(media, folder_id).where(F.col("relative_path") == relative_path))


def by_relative_paths(media: DataFrame, keys: DataFrame) -> DataFrame:
    return media_files(media.join(keys.select("folder_id", "relative_path"), ["folder_id", "relative_path"], "left_semi").select(*media.columns))


def folder_by_path(folders: DataFrame, path: str) -> DataFrame:
    return folders.where(F.col("path") == path)


def folders_by_paths(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    return folders.join(wanted.select("path"), "path", "left_semi").select(*folders.columns)


def root_folders(folders: DataFrame) -> DataFrame:
    return folders.where(F.col("parent_id").isNull())


def child_folders(folders: DataFrame, parent_id: int) -> DataFrame:
    return folders.where(F.col("parent_id") == F.lit(parent_id).cast("bigint")).orderBy("path")


def all_folders(folders: DataFrame) -> DataFrame:
    return folders.orderBy("path")


def configs(table: DataFrame, enabled_only: bool = True) -> DataFrame:
    return (table.where("enabled") if enabled_only else table).orderBy("name")


def present(media: DataFrame) -> DataFrame:
    return media.where("is_present")


# counts -------------------------------------------------------------------


def count_in_folder(media: DataFrame, folder_id: int) -> DataFrame:
    """Missing rows count too."""
    return in_folder(media, folder_id).agg(F.count(F.lit(1)).alias("n"))


def count_in_subtree(media: DataFrame, tree: DataFrame, folder_id: int) -> DataFrame:
    return in_subtree(media, tree, folder_id).agg(F.count(F.lit(1)).alias("n"))


def counts_by_folder(media: DataFrame) -> DataFrame:
    return media.groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))


def counts_by_subtree(media: DataFrame, tree: DataFrame) -> DataFrame:
    """Recursive counts of all folders at once.  Media collapse to one row per
    folder (combined map-side) before they meet the closure, and the closure
    side is grouped by ancestor the same way, so neither a hot folder nor the
    root gathers rows."""
    direct = counts_by_folder(media)
    return (
        tree.join(direct, "folder_id")
        .groupBy(F.col("ancestor_id").alias("folder_id"))
        .agg(F.sum("n").alias("n"))
    )


def distinct_hashes(rows: DataFrame) -> DataFrame:
    return rows.select("content_hash").distinct()


# order and pages ----------------------------------------------------------


def browse_order(key: str, descending: bool = False) -> list[Column]:
    """Sort columns.  Null sorts low; a missing score counts as zero; ties go by
    file name ascending, then id."""
    name = F.lower(paths.file_name("relative_path"))
    column = {
        "filename": name,
        "size": F.col("file_size"),
        "date_created": F.col("created_at"),
        "date_modified": F.col("modified_at"),
        "score": F.coalesce(F.col("search_score"), F.lit(0.0).cast("float")),
    }[key]
    first = column.desc_nulls_last() if descending else column.asc_nulls_first()
    return [first, name.asc(), F.col("id").asc()]


def rank_order() -> list[Column]:
    """Best score first, then path."""
    return [F.col("score").desc(), F.col("relative_path").asc(), F.col("id").asc()]


def sort_media(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    return rows.orderBy(*browse_order(key, descending))


def _after(media: DataFrame, after_id: int | None) -> DataFrame:
    return media if after_id is None else media.where(F.col("id") > after_id)


def page_of_folder(media: DataFrame, folder_id: int, after_id: int | None, size: int) -> DataFrame:
    """The next ``size`` rows after an id: a filter and a top-k, no full sort.  Ids are
    signed, so a first page has no bound: ``after_id`` is None."""
    return media_files(in_folder(_after(media, after_id), folder_id)).orderBy("id").limit(size)


def page_of_subtree(media: DataFrame, tree: DataFrame, folder_id: int, after_id: int | None, size: int) -> DataFrame:
    return media_files(in_subtree(_after(media, after_id), tree, folder_id)).orderBy("id").limit(size)


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(folder_id, n)``: by how much the number of media of a folder changes, from the
    rows that changed as they were and as they are.  Folders that keep theirs are absent."""
    held = lambda rows, sign: rows.select("folder_id", F.lit(sign).cast("bigint").alias("n"))
    signed = held(before, -1).unionByName(held(after, 1))
    return signed.groupBy("folder_id").agg(F.sum("n").alias("n")).where("n <> 0")


def counts_after(counts: DataFrame, changes: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Counts ``(folder_id, n)`` brought up to date by signed ``changes``; media are not read.
    With a closure they are counts of folders with all below, and a change counts for every
    folder above.  Folders left without media are dropped."""
    if tree is not None:
        up = tree.join(changes, "folder_id").select(F.col("ancestor_id").alias("folder_id"), "n")
        changes = up.groupBy("folder_id").agg(F.sum("n").alias("n"))
    both = counts.select("folder_id", "n").unionByName(changes.select("folder_id", "n"))
    return both.groupBy("folder_id").agg(F.sum("n").alias("n")).where("n <> 0")
