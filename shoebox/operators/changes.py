"""Change events: classify, collapse, resolve, apply.  Used by batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.operators.skew import lookup_join


def change_kind(heif: bool = False) -> Column:
    """What an event means for its path: upsert, remove, or null for nothing.

    Create and modify mean upsert while the path exists, else remove; remove
    means remove; access and heartbeats are ignored; anything else goes by existence.
    Existing directories and existing unsupported files are skipped.
    """
    skipped = F.col("path_exists") & (F.col("is_dir") | ~paths.is_supported("path", heif))
    by_existence = F.when(F.col("path_exists"), "upsert").otherwise("remove")
    ignored = F.col("event_kind").isin("access", "heartbeat", "error")
    return F.when(skipped | ignored, None).when(F.col("event_kind") == "remove", "remove").when(F.col("event_kind").isNotNull(), by_existence)


def classify(events: DataFrame, heif: bool = False) -> DataFrame:
    """Keep events that matter, with ``kind`` upsert or remove."""
    return events.withColumn("kind", change_kind(heif)).where(F.col("kind").isNotNull())


def collapse(changes: DataFrame, order: str = "remove_wins") -> DataFrame:
    """One change per path.  A remove anywhere in the batch wins, or with
    ``order='latest'`` the last event does.  Both aggregate map-side, so a path
    with a third of all events is no burden."""
    if order == "latest":
        last = F.max_by("kind", F.struct("ts", "event_id"))
        return changes.groupBy("path").agg(last.alias("kind"))
    removed = F.bool_or(F.col("kind") == "remove")
    return changes.groupBy("path").agg(F.when(removed, "remove").otherwise("upsert").alias("kind"))


def debounce(changes: DataFrame, gap: str = "500 milliseconds", watermark: str | None = None) -> DataFrame:
    """Event-time debounce: events of a path closer together than ``gap`` form one
    change, remove winning.  With a watermark it runs as a stream."""
    timed = changes
    if watermark:
        # watermarks want an instant; keep the session zone at UTC
        timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    window = F.session_window("ts", gap)
    removed = F.bool_or(F.col("kind") == "remove")
    return timed.groupBy("path", window.alias("w")).agg(
        F.when(removed, "remove").otherwise("upsert").alias("kind"), F.count(F.lit(1)).alias("n_events")
    ).select("path", "kind", "n_events", F.col("w.start").cast("timestamp_ntz").alias("first_ts"))


def match_rules(changes: DataFrame, rules: DataFrame, given: bool = False) -> DataFrame:
    """Attach the columns of the longest import rule above each path (unique
    paths), its normalised ``path`` renamed ``root``; the later rule on ties, nulls when
    none matches.

    Every path asks for its own prefixes in an equi-join, so many rules cost no
    pairwise comparison, and the best answer is an aggregate on the path, by
    which collapsed changes are partitioned already.  An import root is a prefix of
    every path below it, so the join spreads hot prefixes; rules ``given`` by the driver
    as a list are few and are broadcast instead.
    """
    carried = [c for c in rules.columns if c != "path"]
    rules = rules.withColumn("path", paths.normalize("path"))
    rule = F.struct(F.col("path").alias("root"), *carried)
    best = rules.groupBy(F.col("path").alias("_prefix")).agg(F.max_by(rule, "rule_no").alias("_rule"))
    prefixes = F.concat(F.array(F.lit(""), F.lit("/")), paths.ancestor_paths("path"))
    wanted = changes.select("*", F.explode(prefixes).alias("_prefix"))
    asked = wanted.join(F.broadcast(best), "_prefix", "left") if given else lookup_join(wanted, best, "_prefix", "left", ["path"])
    others = [c for c in changes.columns if c != "path"]
    depth = F.when(F.col("_rule").isNotNull(), F.length("_prefix"))
    found = asked.groupBy("path").agg(
        F.max_by("_rule", depth).alias("_rule"), *[F.any_value(c).alias(c) for c in others]
    )
    return found.select(*changes.columns, "_rule.root", *[f"_rule.{c}" for c in carried])


def resolve(changes: DataFrame, rules: list[dict], mode: str = "strict", apply_rules: bool = True) -> DataFrame:
    """Attach ``root``, ``rule_no`` and ``relative_path`` (relative to the import
    root); drop paths under no import and those the import's lists reject.
    ``rules`` holds dicts with ``rule_no, path, exclude, include``."""
    table = changes.sparkSession.createDataFrame(
        [(r["rule_no"], r["path"], list(r.get("exclude", [])), list(r.get("include", []))) for r in rules],
        "rule_no int, path string, exclude array<string>, include array<string>",
    )
    placed = match_rules(changes, table, given=True).where(F.col("root").isNotNull())
    if apply_rules:
        placed = placed.where(paths.survives_pruning("path", F.col("root"), F.col("exclude"), F.col("include"), mode))
    return placed.drop("exclude", "include").withColumn("relative_path", paths.relative_to("path", F.col("root")))


def affected_folders(resolved: DataFrame) -> DataFrame:
    return resolved.select("folder_id").distinct()
