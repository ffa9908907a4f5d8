"""Scan an import: list, filter, diff, fingerprint, commit.

The listing and the catalogue meet once, in one full outer join on the unique
absolute path.  Its result is written to the checkpoint folder; everything after
works on the changed rows only, and the commit writes just those.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.operators import browse, changeset, diff, fingerprint, hierarchy
from shoebox.plans.progress import Progress
from shoebox.schemas import FOLDERS, MEDIA
from shoebox.session import checkpoint_root
from shoebox.sources import filetree, imports
from shoebox.sources.catalog import Catalog
from shoebox.sources.imports import with_clean_root

METRICS = (
    "root string, listed bigint, processed bigint, rejected bigint, restored bigint, missing bigint, unchanged bigint, version bigint, "
    "rejects string, reason string"
)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def root_folder(rule: dict, now) -> dict:
    thumbs = rule.get("thumbnails", {})
    return {
        "path": F.lit(rule["path"]),
        "recursive": F.lit(rule.get("recursive", True)),
        "scan_complete": F.lit(False),
        "exclude": F.lit(list(rule.get("exclude", []))).cast("array<string>"),
        "include": F.lit(list(rule.get("include", []))).cast("array<string>"),
        "thumbnail_cache_mode": F.lit(thumbs.get("cache_mode", "global")),
        "thumbnail_cache_folder": F.nullif(F.lit(thumbs.get("cache_folder", "")), F.lit("")),
        "thumbnail_cache_fallback": F.lit(thumbs.get("cache_fallback", "disable")),
        "parent_id": F.lit(None).cast("bigint"),
        "id": F.xxhash64(F.lit(rule["path"])),
        "created_at": now,
    }


def folders_after(folders: DataFrame, listing: DataFrame, directories: DataFrame, rule: dict, now) -> DataFrame:
    """Folders with the import root and every listed directory added and marked
    complete.  Directories that failed to list stay incomplete, so the next scan
    returns to them."""
    spark, root = folders.sparkSession, rule["path"]
    wanted = spark.range(1).select(*[c.alias(n) for n, c in root_folder(rule, now).items()]).select(*FOLDERS.names)
    with_root = changeset.insert_folders(folders, wanted)
    if not rule.get("recursive", True):
        done = with_root.where(F.col("path") == root).select("id")
        return hierarchy.set_scan_state(with_root, done, True)
    met = directories.where(F.col("status").isin("listed", "failed") & (F.col("path") != root)).select("path").distinct()
    lists = {n: F.lit(list(rule.get(n, []))).cast("array<string>") for n in ("exclude", "include")}
    derived = hierarchy.derive_folders(met, with_root, now, **lists)
    grown = with_root.unionByName(derived.select(*with_root.columns))
    listed = directories.where(F.col("status") == "listed").select("path").distinct()
    return hierarchy.set_scan_state(grown, grown.join(listed, "path", "left_semi").select("id"), True)


def changed_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """Folders that are new or whose scan state differs."""
    before = old.select("id", F.col("scan_complete").alias("_was"))
    return new.join(before, "id", "left").where(~F.col("scan_complete").eqNullSafe(F.col("_was"))).select(*new.columns)


def media_changes(
    compared: DataFrame, folders: DataFrame, unlisted: DataFrame, rule: dict, now, algorithm: str = fingerprint.SHA256, counter=None,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: full new media rows for everything that changes."""
    root = rule["path"]
    todo = compared.where(F.col("action").isin("new", "changed"))
    printed = stored(fingerprint.fingerprint_files(todo.drop("format"), algorithm, counter), "fingerprints")
    good = printed.where(F.col("error").isNull())
    root_id = F.lit(None).cast("bigint")
    fresh = diff.assign_folders(good.where(F.col("action") == "new"), folders, root_id)
    old = good.where(F.col("action") == "changed").withColumn("folder_id", F.col("old_folder_id"))
    upserts = fresh.unionByName(old.select(*fresh.columns)).select(
        F.coalesce("old_id", F.xxhash64("path")).alias("id"),
        "folder_id",
        F.coalesce("old_relative_path", paths.relative_to("path", F.lit(root))).alias("relative_path"),
        F.col("path").alias("absolute_path"), "content_hash", "width", "height", "format",
        F.col("size").alias("file_size"), F.col("mtime").alias("modified_at"),
        F.coalesce("old_created_at", now).alias("created_at"), F.lit(True).alias("is_present"),
        F.lit(None).cast("timestamp_ntz").alias("missing_since"),
    )
    carried = [F.col(f"old_{c}").alias(c) for c in MEDIA.names if c not in ("is_present", "missing_since")]
    restored = compared.where(F.col("action") == "restored").select(
        *carried, F.lit(True).alias("is_present"), F.lit(None).cast("timestamp_ntz").alias("missing_since")
    )
    absent = compared.where(F.col("action") == "absent")
    if not rule.get("recursive", True):
        absent = absent.where(paths.parent_dir("path") == root)
    known_gone = absent.join(diff.shielded(absent, unlisted).select("path"), "path", "left_anti")
    missing = known_gone.select(*carried, F.lit(False).alias("is_present"), now.alias("missing_since"))
    names = MEDIA.names
    rows = upserts.select(*names).unionByName(restored.select(*names)).unionByName(missing.select(*names))
    return rows, printed.where(F.col("error").isNotNull()).select("path", "error")


def scan_import(
    spark: SparkSession, catalog: Catalog, rule: dict, now, mode: str = "strict", heif: bool = False,
    algorithm: str = fingerprint.SHA256, progress: Callable[[dict], None] | None = None, every: int = 5_000,
) -> DataFrame:
    """Scan one import into the catalogue; a one-row frame of counts.  Its ``rejects`` names
    a folder with the files that failed and why, null if none did.  ``algorithm`` is the same for
    all scans of a catalogue.  ``progress`` is told of every ``every`` files while
    the scan runs (``progress.Progress``)."""
    with Progress(spark, progress, every) as told:
        return _scan(spark, catalog, with_clean_root(rule), now, mode, heif, algorithm, told.counters)


def _scan(spark, catalog, rule, now, mode, heif, algorithm, counters) -> DataFrame:
    root = rule["path"]
    folders, media = catalog.read("folders"), catalog.read("media")
    # folders finished by an earlier, interrupted scan are not entered again
    here = folders.where(F.col("path") == root).select("id").first()
    skip = None
    if here is not None:
        below = hierarchy.subtree(folders, here.id).where(F.col("id") != here.id)
        skip = folders.where("scan_complete").join(below, "id", "left_semi").select("path")
    listing, directories = filetree.list_tree(
        spark, root, rule.get("recursive", True), rule.get("exclude", []), rule.get("include", []), mode, skip, heif, counters["listed"]
    )
    new_folders = stored(folders_after(folders, listing, directories, rule, now), "folders")
    # a root that exists but cannot be listed is "failed" and shields its media
    unlisted = directories.where(F.col("status") != "listed").select("path")
    unlisted = unlisted.unionByName(listing.where(F.col("error").isNotNull()).select("path"))
    readable = listing.where(F.col("error").isNull())
    scope = media.where(F.startswith(F.col("absolute_path"), F.lit(root.rstrip("/") + "/")))
    # unchanged rows are counted as they pass and go no further
    action = F.col("action")
    watched, seen = changeset.counted(
        diff.compare(readable, scope), f"diff-{uuid.uuid4().hex}",
        listed=~action.isin("absent", "gone"), same=action == "same", restored=action == "restored",
    )
    compared = stored(watched.where(~action.isin("same", "gone")), "diff")
    rows, rejects = media_changes(compared, new_folders, unlisted, rule, now, algorithm, counters["fingerprinted"])
    changed = stored(changeset.checked_media(rows), "media-changes")
    changeset.check_new_ids(changed, media)
    grown = stored(changed_folders(folders, new_folders), "folder-changes")
    version = catalog.commit(changes={"folders": grown, "media": changed})
    # these read small written tables
    tally = changed.agg(F.count_if("is_present").alias("there"), F.count_if(~F.col("is_present")).alias("gone")).first()
    failures = rejects.unionByName(listing.where(F.col("error").isNotNull()).select("path", "error"))
    folder = f"{checkpoint_root(spark)}/rejects-{uuid.uuid4().hex}"
    failures.write.parquet(folder)
    failed = spark.read.schema(failures.schema).parquet(folder).count()
    counts = seen.get
    return spark.createDataFrame(
        [(root, counts["listed"], tally.there - counts["restored"], failed, counts["restored"], tally.gone, counts["same"], version, folder if failed else None, None)],
        METRICS,
    )


def rescan_import(spark: SparkSession, catalog: Catalog, rule: dict, now, **options) -> DataFrame:
    """Forget which folders are complete, then scan everything; the counts say how many
    folders were ``reset``."""
    rule = with_clean_root(rule)
    folders, reset = catalog.read("folders"), 0
    here = folders.where(F.col("path") == rule["path"]).select("id").first()
    if here is not None:
        below = stored(hierarchy.subtree(folders, here.id), "reset")
        reset = folders.where("scan_complete").join(below, "id", "left_semi").count()
        catalog.commit({"folders": stored(hierarchy.set_scan_state(folders, below, False), "folders")})
    return scan_import(spark, catalog, rule, now, **options).withColumn("reset", F.lit(reset).cast("bigint"))


def scan_all(spark: SparkSession, catalog: Catalog, rules: list[dict], now, **options) -> DataFrame:
    """Scan, in order, the imports that are new or incomplete.  Imports without a path
    and those that no task can reach are left alone, with a row that says why."""
    rules = [with_clean_root(r) for r in rules]
    named = spark.createDataFrame([(n, r["path"]) for n, r in enumerate(rules)], "n int, path string")
    found = filetree.existing_dirs(named.where("path <> ''"))
    good, bad = imports.reachable(named, found)
    reasons = {r.n: r.reason for r in bad.collect()}
    # one row per import, and those came from the driver
    asked = {r.n for r in imports.needing_scan(good, catalog.read("folders")).collect()}
    total = spark.createDataFrame([(rules[n]["path"], *[None] * 8, why) for n, why in sorted(reasons.items())], METRICS)
    for n, rule in enumerate(rules):
        if n in asked:
            total = total.unionByName(scan_import(spark, catalog, rule, now, **options))
    return total


def purge(catalog: Catalog) -> int:
    """Drop missing media for good, with their values and work items; how many went."""
    held = catalog.read("media")
    media = browse.present(held)
    gone = held.count() - media.count()
    catalog.commit({
        "media": media,
        "values": changeset.cascade_media(catalog.read("values"), media),
        "work_items": changeset.cascade_media(catalog.read("work_items"), media),
    })
    return gone
