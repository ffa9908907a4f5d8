"""Import rules: defaults, reachability, and which imports need a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.schemas import IMPORT_RULES


def with_clean_root(rule: dict) -> dict:
    """The rule with its root as paths are compared: ``/x/`` and ``/x//`` are ``/x``."""
    return {**rule, "path": paths.clean(rule["path"])}


def import_rules(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Configured imports with defaults filled in.  ``blacklist`` is an older name
    of ``exclude``."""
    rows = []
    for number, entry in enumerate(entries, start=1):
        thumbs = entry.get("thumbnails", {})
        rows.append((
            number, paths.clean(entry.get("path", "")), entry.get("recursive", True), entry.get("flatten", False),
            entry.get("exclude", entry.get("blacklist", [])), entry.get("include", []),
            thumbs.get("cache_mode", "global"), thumbs.get("cache_folder", ""), thumbs.get("cache_fallback", "disable"),
        ))
    return spark.createDataFrame(rows, IMPORT_RULES)


def reachable(rules: DataFrame, existing_dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split imports into usable ones and rejects with a reason, given the
    directories that exist (``path``)."""
    seen = existing_dirs.select("path").distinct().withColumn("_exists", F.lit(True))
    checked = rules.join(seen, "path", "left")
    reason = F.when(F.col("path") == "", "no path configured").when(F.col("_exists").isNull(), "not reachable")
    judged = checked.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(*rules.columns)
    return good, judged.where(F.col("reason").isNotNull()).select(*rules.columns, "reason")


def needing_scan(rules: DataFrame, folders: DataFrame) -> DataFrame:
    """Imports with no folder yet, or one whose scan is incomplete."""
    done = folders.where("scan_complete").select("path")
    return rules.join(done, "path", "left_anti").select(*rules.columns)
