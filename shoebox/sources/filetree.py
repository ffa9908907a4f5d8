"""Listing a file tree and reading file bytes, spread over the executors.

The tree must be visible to every executor (a shared mount).  Directories are
expanded level by level; each level is a written table in the shared checkpoint
folder, so a lost executor repeats one level's listing at most.
"""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import paths, times
from shoebox.session import checkpoint_root

# executors get the helpers below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCAN_SCHEMA = "path string, is_dir boolean, descend boolean, status string, error string"
STAT_SCHEMA = "path string, is_dir boolean, size bigint, mtime_s bigint, error string"
BATCH = 20_000
# Enough work per task to pay for it.
DIRS_PER_TASK = 64
FILES_PER_TASK = 2_000


def _text(path) -> str:
    import os

    return os.fsencode(path).decode("utf-8", "replace")


def _scan_directories(batches):
    """One row per entry; names only, so a huge directory costs no stat calls here."""
    import os

    import pandas as pd

    def frame(rows):
        return pd.DataFrame(rows, columns=["path", "is_dir", "descend", "status", "error"])

    for pdf in batches:
        for folder in pdf["path"]:
            rows = []
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        rows.append((_text(entry.path), entry.is_dir(), entry.is_dir(follow_symlinks=False), "entry", None))
                        if len(rows) >= BATCH:
                            yield frame(rows)
                            rows = []
                rows.append((folder, True, False, "listed", None))
            except OSError as problem:
                rows.append((folder, True, False, "failed", str(problem)))
            yield frame(rows)


def existing_dirs(folders: DataFrame) -> DataFrame:
    """Those of ``folders(path)`` that a task can see."""

    def seen(batches):
        import os

        for pdf in batches:
            yield pdf[[os.path.isdir(p) for p in pdf["path"]]]

    return folders.select("path").mapInPandas(seen, "path string")


def stat_files(batches, counter=None):
    import os

    import pandas as pd

    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                found = os.stat(path)
                if os.path.isfile(path):
                    # a time before 1970 counts as unknown
                    seconds = int(found.st_mtime) if found.st_mtime >= 0 else None
                    rows.append((path, False, found.st_size, seconds, None))
            except OSError as problem:
                rows.append((path, False, None, None, str(problem)))
        if counter is not None:
            counter[0].add(len(rows))
            counter[1].add(sum(r[2] or 0 for r in rows))
        yield pd.DataFrame(rows, columns=["path", "is_dir", "size", "mtime_s", "error"]).astype(
            {"size": "Int64", "mtime_s": "Int64"}
        )


def _tasks(spark: SparkSession, n: int, per_task: int) -> int:
    return max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // per_task))))


def list_tree(
    spark: SparkSession, root: str, recursive: bool = True, exclude=(), include=(), mode: str = "strict",
    skip: DataFrame | None = None, heif: bool = False, counter=None,
) -> tuple[DataFrame, DataFrame]:
    """``(listing, directories)`` of an import.

    ``listing`` holds the supported files ``(path, is_dir, size, mtime)`` and an
    ``error`` for those that could not be read.  ``directories(path, status)``
    says for each directory met whether it was listed, failed, excluded or
    skipped because ``skip(path)`` names it.  Rejected directories are never
    opened.  The root is always admitted.  ``counter`` is a pair of accumulators, of files
    and of bytes.
    """
    work = f"{checkpoint_root(spark)}/listing-{uuid.uuid4().hex}"
    frontier = spark.createDataFrame([(root,)], "path string")
    exclude, include = list(exclude), list(include)
    level, levels, n_dirs, n_files = 0, [], 1, 0
    keep = (F.col("status") == "entry") & ~F.col("is_dir") & paths.is_supported("path", heif)
    while True:
        target = f"{work}/level={level}"
        found = frontier.repartition(_tasks(spark, n_dirs, DIRS_PER_TASK), "path").mapInPandas(_scan_directories, SCAN_SCHEMA)
        admitted = paths.is_admitted("path", exclude, include, mode)
        judged = found.withColumn(
            "status", F.when((F.col("status") == "entry") & ~admitted, "excluded").otherwise(F.col("status"))
        )
        if skip is not None:
            named = skip.select("path").distinct().withColumn("_skip", F.lit(True))
            judged = judged.join(named, "path", "left").withColumn(
                "status",
                F.when((F.col("status") == "entry") & F.col("is_dir") & F.col("_skip"), "skipped").otherwise(F.col("status")),
            ).drop("_skip")
        # a level is written once and read back: the frontier never grows a lineage
        judged.write.mode("overwrite").parquet(target)
        written = spark.read.schema(SCAN_SCHEMA).parquet(target)
        levels.append(target)
        enter = (F.col("status") == "entry") & F.col("descend")
        frontier = written.where(enter).select("path")
        found = written.agg(F.count_if(enter).alias("dirs"), F.count_if(keep).alias("files")).first()
        n_dirs, n_files = found.dirs, n_files + found.files
        if not recursive or n_dirs == 0:
            break
        level += 1
    entries = spark.read.schema(SCAN_SCHEMA).parquet(*levels)
    states = entries.where(F.col("is_dir") & F.col("status").isin("listed", "failed", "excluded", "skipped"))
    # a symbolic link to a directory is met but not entered
    linked = entries.where(F.col("is_dir") & ~F.col("descend") & (F.col("status") == "entry")).withColumn("status", F.lit("listed"))
    directories = states.unionByName(linked).select("path", "status", "error")
    if not recursive:
        directories = directories.where(F.col("path") == root)
    files = entries.where(keep).select("path")
    # stat calls are the slow part on a network mount: spread them by path, so
    # the files of one huge directory are shared out as well
    listing = (
        files.repartition(_tasks(spark, n_files, FILES_PER_TASK), "path")
        .mapInPandas(lambda batches: stat_files(batches, counter), STAT_SCHEMA)
        .withColumn("mtime", times.from_epoch(F.col("mtime_s")))
        .select("path", "is_dir", "size", "mtime", "error")
    )
    stored = f"{work}/files"
    listing.write.mode("overwrite").parquet(stored)
    return spark.read.schema(listing.schema).parquet(stored), directories


def read_bytes(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of a whole tree through the built-in binary source:
    the quick way when no name starts with ``_`` or ``.`` (the source skips those)
    and single files fit in memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
