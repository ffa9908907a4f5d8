"""Table changes as pure functions: old rows and a change set in, new rows out.

Every change set has unique keys.  The table is always the left side, so a small
change set is broadcast by size and the table is not shuffled at all; a large
one meets it in a sort-merge join on a unique key, which cannot be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

MEDIA_KEY = ["folder_id", "relative_path"]
UPDATED_BY_SCAN = ["absolute_path", "content_hash", "width", "height", "format", "file_size", "modified_at"]


def update_where(table: DataFrame, hits: DataFrame, key: list[str], **new: Column) -> DataFrame:
    """Set columns on the rows whose key is in ``hits``; ``hits`` may carry more
    columns, visible to the expressions under their own names prefixed ``new_``."""
    extra = [c for c in hits.columns if c not in key]
    side = hits.select(*key, *[F.col(c).alias(f"new_{c}") for c in extra], F.lit(True).alias("_hit"))
    joined = table.join(side, key, "left")
    return joined.select(
        *[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns]
    )


def delete_where(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key), key, "left_anti").select(*table.columns)


def missing_from(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table does not hold.  The table is first cut down to
    the keys in question, so the anti-join is between two sets no larger than
    ``rows``."""
    held = table.select(*key).join(rows.select(*key), key, "left_semi")
    return rows.join(held, key, "left_anti")


def checked_media(rows: DataFrame) -> DataFrame:
    """The rows themselves; writing one without a folder fails the job."""
    lost = F.raise_error(F.concat(F.lit("media row without a folder: "), F.col("absolute_path"))).cast("bigint")
    return rows.withColumn("folder_id", F.when(F.col("folder_id").isNull(), lost).otherwise(F.col("folder_id"))).select(*rows.columns)


def check_new_ids(rows: DataFrame, table: DataFrame, key: str = "absolute_path") -> None:
    """New ids are 64-bit hashes.  Fail if a changed row has the id of another row, new
    or old; the table is read for ids only, and two rows at most reach the driver."""
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).where("n > 1").select("id", "a", "b")
    held = table.select("id", F.col(key).alias("b")).join(rows.select("id", F.col(key).alias("a")), "id").where("a <> b").select("id", "a", "b")
    clash = twice.unionByName(held).limit(1).collect()
    if clash:
        raise ValueError(f"id {clash[0].id} belongs to {clash[0].a} and {clash[0].b}")


def upsert_media(media: DataFrame, changes: DataFrame, now: Column, key: list[str] | None = None) -> DataFrame:
    """Insert or replace by key.  A replaced row keeps its id and creation time;
    either way the row is present afterwards.  New ids are hashes of the path."""
    key = key or MEDIA_KEY
    replaced = [c for c in [*MEDIA_KEY, *UPDATED_BY_SCAN] if c not in key]
    values = {c: F.col(f"new_{c}") for c in replaced} | {"is_present": F.lit(True), "missing_since": F.lit(None).cast("timestamp_ntz")}
    return merged(media, changes.select(*key, *replaced), key, values, {"id": F.xxhash64("absolute_path"), "created_at": now})


def merged(table: DataFrame, changes: DataFrame, key: list[str], values: dict[str, Column], first: dict[str, Column]) -> DataFrame:
    """Insert or replace by key in one full outer join.  A row in ``changes`` sets
    ``values`` (its other columns are visible as ``new_...``); a row new to the table also
    gets ``first``, expressions over the columns as set."""
    extra = [c for c in changes.columns if c not in key]
    side = changes.select(*key, *[F.col(c).alias(f"new_{c}") for c in extra], F.lit(True).alias("_hit"))
    joined = table.withColumn("_held", F.lit(True)).join(side, key, "full_outer")
    put = joined.select(
        *[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns], "_held"
    )
    return put.select(*[F.when(F.col("_held").isNull(), first[c]).otherwise(F.col(c)).alias(c) if c in first else F.col(c) for c in table.columns])


def mark_missing(media: DataFrame, listed: DataFrame, scope: Column, now: Column) -> DataFrame:
    """Present rows inside ``scope`` (a predicate on media) that ``listed(absolute_path)``
    lacks become missing; nothing else about them changes."""
    seen = listed.select("absolute_path").withColumn("_seen", F.lit(True))
    joined = media.join(seen, "absolute_path", "left")
    gone = scope & F.col("_seen").isNull() & F.coalesce("is_present", F.lit(True))
    return joined.select(
        *[
            F.when(gone, {"is_present": F.lit(False), "missing_since": now}[c]).otherwise(F.col(c)).alias(c)
            if c in ("is_present", "missing_since") else F.col(c)
            for c in media.columns
        ]
    )


def mark_missing_by_key(media: DataFrame, keys: DataFrame, now: Column, key: list[str] | None = None) -> DataFrame:
    """Unconditional: an already missing row gets the new time."""
    key = key or MEDIA_KEY
    return update_where(media, keys.select(*key), key, is_present=F.lit(False), missing_since=now)


def mark_present_by_key(media: DataFrame, keys: DataFrame, key: list[str] | None = None) -> DataFrame:
    key = key or MEDIA_KEY
    return update_where(
        media, keys.select(*key), key, is_present=F.lit(True), missing_since=F.lit(None).cast("timestamp_ntz")
    )


def purge_missing(media: DataFrame) -> DataFrame:
    return media.where(F.coalesce("is_present", F.lit(True)))


def cascade_media(child: DataFrame, media: DataFrame) -> DataFrame:
    """Values or work items whose media row survives."""
    return child.join(media.select(F.col("id").alias("media_file_id")), "media_file_id", "left_semi").select(*child.columns)


def cascade_folders(folders: DataFrame, media: DataFrame, tree: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove ``deleted(id)`` folders with all below them, and their media."""
    doomed = (
        tree.join(deleted.select(F.col("id").alias("ancestor_id")), "ancestor_id", "left_semi")
        .select(F.col("folder_id").alias("id")).distinct()
    )
    left = folders.join(doomed, "id", "left_anti").select(*folders.columns)
    kept = media.join(doomed.select(F.col("id").alias("folder_id")), "folder_id", "left_anti").select(*media.columns)
    return left, kept


def insert_folders(folders: DataFrame, new: DataFrame) -> DataFrame:
    """Add folders whose path is not there yet; existing rows win."""
    return folders.unionByName(missing_from(folders, new, ["path"]).select(*folders.columns))


def get_or_create_folders(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(path, id)`` for every wanted folder, existing id or new one."""
    known = folders.select("path", F.col("id").alias("known_id")).join(wanted.select("path"), "path", "left_semi")
    return wanted.join(known, "path", "left").select("path", F.coalesce("known_id", "id").alias("id"))


def insert_configs(table: DataFrame, new: DataFrame) -> DataFrame:
    """Names are unique; a repeated name fails the job."""
    clash = new.join(table.select("name").withColumn("_held", F.lit(True)), "name", "left")
    checked = clash.withColumn(
        "name", F.when(F.col("_held"), F.raise_error(F.concat(F.lit("config exists: "), F.col("name"))).cast("string")).otherwise(F.col("name"))
    )
    once = checked.groupBy("name").agg(
        F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in table.columns if c != "name"]
    )
    unique = once.withColumn(
        "name", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("config given twice: "), F.col("name"))).cast("string")).otherwise(F.col("name"))
    )
    return table.unionByName(unique.select(*table.columns))


def counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """Attach row counts that are filled in by whichever job consumes ``df``; no
    extra pass over the data."""
    seen = Observation(name)
    measured = [F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).alias(label) for label, test in counts.items()]
    return df.observe(seen, *measured), seen
