"""Keep the catalogue current from a feed of file-change events.

Events are rows written by whatever watches the files.  Each micro-batch is
collapsed to one change per path, resolved against the import rules and
committed under its batch number, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import paths, times
from shoebox.operators import changes, changeset, diff, fingerprint, hierarchy
from shoebox.operators.skew import dealt
from shoebox.plans.ingest import stored
from shoebox.schemas import CHANGE_EVENTS, MEDIA, timestamp
from shoebox.sources import filetree
from shoebox.sources.catalog import Catalog, StaleCatalog
from shoebox.sources.imports import with_clean_root
from shoebox.streaming import settle

# how often a batch is applied anew because another writer has committed meanwhile
COMMIT_ATTEMPTS = 5


def read_events(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Event files as a stream."""
    reader = spark.readStream.schema(CHANGE_EVENTS)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


def read_watched(spark: SparkSession, imports: list[dict], feeds: dict[str, str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The events of several imports as one stream, each import with the feed
    that covers it.  An import whose feed cannot be read is reported and the
    others go on; a non-recursive import sees only its top level."""
    streams, problems = None, []
    for rule in imports:
        try:
            events = read_events(spark, feeds[rule["path"]])
        except Exception as problem:
            problems.append((rule["path"], str(problem)))
            continue
        root = F.lit(with_clean_root(rule)["path"])
        mine = events.where(paths.is_under("path", root) & paths.within_depth("path", root, rule.get("recursive", True)))
        streams = mine if streams is None else streams.unionByName(mine)
    return streams, problems


def print_files(upserts: DataFrame) -> DataFrame:
    """Stat and fingerprint files by path; unreadable ones come back with ``error``."""
    # spread by path, as a burst often comes from one directory
    spread = upserts.select("path").repartition("path")
    found = spread.mapInPandas(filetree.stat_files, filetree.STAT_SCHEMA)
    kept = stored(
        found.select("path", "size", times.from_epoch(F.col("mtime_s")).alias("mtime"), "error"), "stats"
    )
    printed = fingerprint.fingerprint_files(kept.where(F.col("error").isNull()).drop("error"))
    return printed.unionByName(kept.where(F.col("error").isNotNull()), allowMissingColumns=True)


def apply_batch(
    events: DataFrame, catalog: Catalog, rules: list[dict], now, stream: str, batch: int,
    printer: Callable[[DataFrame], DataFrame] = print_files, order: str = "remove_wins", heif: bool = False,
) -> dict:
    """Apply one batch of events, as ``apply_changes`` does."""
    collapsed = changes.collapse(changes.classify(events, heif), order)
    return apply_changes(collapsed, catalog, rules, now, stream, batch, printer, heif)


def apply_changes(
    collapsed: DataFrame, catalog: Catalog, rules: list[dict], now, stream: str, batch: int,
    printer: Callable[[DataFrame], DataFrame] = print_files, heif: bool = False,
) -> dict:
    """Apply changes ``(path, kind)``, one a path; counts and the folders touched.

    Upserts replace or add media rows, removes mark rows missing.  A file that
    cannot be read is counted and left alone.
    """
    spark = collapsed.sparkSession
    if catalog.has_batch(stream, batch):
        none = spark.createDataFrame([], "folder_id bigint")
        return {"upserted": 0, "missing": 0, "failed": 0, "folders": none, "replayed": True}
    rules = [with_clean_root(r) for r in rules]
    resolved = stored(changes.resolve(collapsed, rules), "resolved")

    folders = catalog.read("folders")
    imports = spark.createDataFrame(
        [
            (r["path"], list(r.get("exclude", [])), list(r.get("include", [])), t.get("cache_mode", "global"),
             t.get("cache_folder") or None, t.get("cache_fallback", "disable"))
            for r, t in ((r, r.get("thumbnails", {})) for r in {r["path"]: r for r in rules}.values())
        ],
        "root string, exclude array<string>, include array<string>, mode string, folder string, fallback string",
    )
    # at most one row per import rule, and those came from the driver
    roots = F.broadcast(imports).join(folders.select(F.col("path").alias("root"), F.col("id").alias("root_id")), "root")
    live = stored(resolved.join(F.broadcast(roots.select("root", "root_id")), "root"), "live")

    # tables lie in ranges of their key, so a batch from one corner of a tree reads the files of that corner
    ends = live.agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count(F.lit(1)).alias("n")).first()

    # missing parents appear as complete folders under their import; only folders above the batch's files are looked up
    files = live.where(F.col("kind") == "upsert").select("path", "root", F.lit(False).alias("is_dir"))
    met = stored(hierarchy.directories_of(files, F.col("root"), "root"), "directories")
    n_met = met.count()
    tops = imports.select(F.explode(F.array("root", paths.parent_dir("root"))).alias("path"))
    near = stored(folders.select("path", "id").join(dealt(met.select("path").unionByName(tops), n_met), "path", "left_semi"), "near-folders")
    n_near = near.count()
    fresh = stored(
        hierarchy.derive_folders(
            met.join(F.broadcast(imports), "root"), dealt(near, n_near), now, scan_complete=True, exclude=F.col("exclude"), include=F.col("include"),
            thumbnail_cache_mode=F.col("mode"), thumbnail_cache_folder=F.col("folder"), thumbnail_cache_fallback=F.col("fallback"),
        ).dropDuplicates(["path"]),
        "folders",
    )
    near_or_fresh = near.unionByName(fresh.select("path", "id"))

    upserts = live.where((F.col("kind") == "upsert") & paths.is_supported("path", heif))
    printed = stored(printer(upserts.select("path")), "fingerprints")
    ok = printed.where(F.col("error").isNull()).join(dealt(live.drop("kind", "rule_no"), ends.n), "path")
    placed = diff.assign_folders(ok, near_or_fresh, F.col("root_id"), n_near + n_met)

    old = catalog.read("media").where(F.col("absolute_path").between(F.lit(ends.low), F.lit(ends.high)))
    held = old.join(dealt(live.select(F.col("path").alias("absolute_path"), "kind"), ends.n), "absolute_path")
    keep = held.select("absolute_path", F.col("id").alias("_id"), F.col("folder_id").alias("_folder"),
                       F.col("relative_path").alias("_relative"), F.col("created_at").alias("_created"))
    written = (
        placed.withColumn("absolute_path", F.col("path")).join(dealt(keep, ends.n), "absolute_path", "left").select(
            F.coalesce("_id", F.xxhash64("absolute_path")).alias("id"), F.coalesce("_folder", "folder_id").alias("folder_id"),
            F.coalesce("_relative", "relative_path").alias("relative_path"), "absolute_path", "content_hash", "width", "height",
            "format", F.col("size").alias("file_size"), F.col("mtime").alias("modified_at"),
            F.coalesce("_created", now).alias("created_at"), F.lit(True).alias("is_present"),
            F.lit(None).cast("timestamp_ntz").alias("missing_since"),
        )
    )
    gone = held.where(F.col("kind") == "remove").select(
        *[{"is_present": F.lit(False), "missing_since": now}.get(c, F.col(c)).alias(c) for c in MEDIA.names]
    )
    rows = stored(changeset.checked_media(written.select(*MEDIA.names).unionByName(gone)), "media-changes")
    catalog.commit(changes={"folders": fresh, "media": rows}, stream=stream, batch=batch)
    tally = rows.agg(F.count_if("is_present").alias("up"), F.count_if(~F.col("is_present")).alias("gone")).first()
    return {
        "upserted": tally.up, "missing": tally.gone, "failed": printed.where(F.col("error").isNotNull()).count(),
        "folders": changes.affected_folders(rows), "replayed": False,
    }


def run(
    events: DataFrame, catalog: Catalog, rules: list[dict], now: Column | Callable[[], Column] | None, checkpoint: str, name: str = "changes",
    trigger: dict | None = None, printer: Callable[[DataFrame], DataFrame] = print_files, order: str = "remove_wins",
    debounce: str | None = None, delay: str = "2 seconds", keep: str = "1 hour", report: Callable[[dict], None] | None = None,
):
    """Start the stream.  Without ``debounce`` the trigger is the debounce: 500 ms of
    events make one batch unless told otherwise, and batches are applied in the order they
    come.  With it, bursts of events closer together than that are one change whatever
    batches they come in, and an older event never undoes a newer one (``settle.settled``).
    Every batch is stamped with the time it is applied at; ``now`` may give the time
    instead, once for all or, as a function, batch by batch.  A batch that is replayed
    after its commit changes nothing, stamps included.  Other writers may commit between batches,
    or during one, which is then applied anew to what they left.  ``report`` gets
    each batch's counts, those of stale changes among them."""
    feed = settle.settled(events, debounce, delay, keep, order) if debounce else events

    def sink(batch: DataFrame, batch_id: int) -> None:
        if now is None:
            stamp = timestamp(datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"))
        else:
            stamp = now() if callable(now) else now
        stale = 0
        if debounce:
            # read twice, and the state behind it must not be run twice
            batch = stored(batch, "settled")
            stale = batch.where("stale").count()
            batch = settle.latest_of_each(batch)
        else:
            batch = changes.collapse(changes.classify(batch), order)
        for attempt in range(1, COMMIT_ATTEMPTS + 1):
            catalog.refresh()
            try:
                done = apply_changes(batch, catalog, rules, stamp, name, batch_id, printer)
                break
            except StaleCatalog:
                if attempt == COMMIT_ATTEMPTS:
                    raise
        if report:
            report({"batch": batch_id, "stale": stale, **{k: done[k] for k in ("upserted", "missing", "failed", "replayed")}})

    writer = feed.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(sink)
    return writer.trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
