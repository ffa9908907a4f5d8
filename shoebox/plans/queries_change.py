"""Registered queries: table changes, annotation work, change events."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.operators import annotate, changes, changeset, diff, fingerprint, hierarchy
from shoebox.plans import annotation, ingest
from shoebox.plans.ingest import stored
from shoebox.plans.queries_browse import LIBRARY, RULES, SCOPE, SUBTREE, SUMMARY, _fresh_catalog
from shoebox.plans.registry import query
from shoebox.schemas import timestamp
from shoebox.session import checkpoint_root, checkpointed
from shoebox.sources import filetree
from shoebox.sources.fixtures import NOW
from shoebox.streaming import changes as stream
from shoebox.streaming import settle

_MEDIA_OUT = ["id", "folder_id", "relative_path", "absolute_path", "content_hash", "width", "height", "format",
              "file_size", "modified_at", "is_present", "missing_since"]


def _upserts(fx):
    """Changed and new files of the later listing, with a stand-in fingerprint."""
    files = diff.compare(fx.listing(), fx.media()).where(F.col("action").isin("new", "changed"))
    placed = diff.assign_folders(files, fx.tree_keys(), F.lit(LIBRARY).cast("bigint"))
    return placed.select(
        "folder_id", F.substr("path", F.lit(6)).alias("relative_path"), F.col("path").alias("absolute_path"),
        F.sha2("path", 256).alias("content_hash"), F.length("path").cast("int").alias("width"), F.lit(1).alias("height"),
        fingerprint.format_of("path").alias("format"), F.col("size").alias("file_size"), F.col("mtime").alias("modified_at"),
    )


_SQL_UPSERTS = """
, ups AS (
  SELECT f.id AS folder_id, substr(l.path, 6) AS relative_path, l.path AS absolute_path, sha256(l.path) AS content_hash,
         CAST(length(l.path) AS INTEGER) AS width, 1 AS height,
         CASE lower(regexp_extract(l.path, '[^/]+\\.([^./]*)$', 1)) WHEN 'jpg' THEN 'jpeg' WHEN '' THEN NULL
              ELSE lower(regexp_extract(l.path, '[^/]+\\.([^./]*)$', 1)) END AS format, l.size AS file_size, l.mtime AS modified_at
  FROM fx_listing l JOIN fx_tree f ON f.path = regexp_replace(l.path, '/[^/]*$', '')
  LEFT JOIN fx_media m ON m.absolute_path = l.path
  WHERE m.id IS NULL OR NOT (coalesce(l.size = m.file_size, FALSE) AND l.mtime IS NOT DISTINCT FROM m.modified_at AND m.format IS NOT NULL)
)
"""


@query(
    "I1_upsert_media",
    _SQL_UPSERTS
    + """
    SELECT m.id, coalesce(u.folder_id, m.folder_id) AS folder_id, coalesce(u.relative_path, m.relative_path) AS relative_path,
           coalesce(u.absolute_path, m.absolute_path) AS absolute_path, coalesce(u.content_hash, m.content_hash) AS content_hash,
           CASE WHEN u.folder_id IS NULL THEN m.width ELSE u.width END AS width,
           CASE WHEN u.folder_id IS NULL THEN m.height ELSE u.height END AS height,
           CASE WHEN u.folder_id IS NULL THEN m.format ELSE u.format END AS format,
           CASE WHEN u.folder_id IS NULL THEN m.file_size ELSE u.file_size END AS file_size,
           CASE WHEN u.folder_id IS NULL THEN m.modified_at ELSE u.modified_at END AS modified_at,
           u.folder_id IS NOT NULL OR m.is_present AS is_present,
           CASE WHEN u.folder_id IS NULL THEN m.missing_since END AS missing_since
    FROM fx_media m FULL JOIN ups u ON u.folder_id = m.folder_id AND u.relative_path = m.relative_path
    """,
)
def i1(fx):
    # a scan writes its change set before it merges it
    after = changeset.upsert_media(fx.media(), stored(_upserts(fx), "upserts"), timestamp(NOW))
    fresh = F.col("created_at") == timestamp(NOW)
    # ids of new rows are hashes, which the SQL side cannot compute
    return after.select(F.when(~fresh, F.col("id")).alias("id"), *_MEDIA_OUT[1:])


@query(
    "I2_mark_missing",
    f"""
    SELECT id, is_present AND absolute_path IN (SELECT path FROM fx_listing) AS is_present,
           CASE WHEN is_present AND absolute_path NOT IN (SELECT path FROM fx_listing) THEN TIMESTAMP '{NOW}' ELSE missing_since END AS missing_since
    FROM fx_media
    """,
)
def i2(fx):
    listed = fx.listing().select(F.col("path").alias("absolute_path"))
    return changeset.mark_missing(fx.media(), listed, F.lit(True), timestamp(NOW)).select("id", "is_present", "missing_since")


def _keys_of(fx, kind):
    """Keys of the media that events of one kind name."""
    named = fx.events().where(F.col("event_kind") == kind).select(F.col("path").alias("absolute_path")).distinct()
    return fx.media().join(named, "absolute_path", "left_semi").select("folder_id", "relative_path")


@query(
    "I3_mark_missing_by_path",
    f"""
    SELECT id, is_present AND NOT hit AS is_present, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE missing_since END AS missing_since
    FROM (SELECT *, absolute_path IN (SELECT path FROM fx_events WHERE event_kind = 'remove') AS hit FROM fx_media)
    """,
)
def i3(fx):
    after = changeset.mark_missing_by_key(fx.media(), _keys_of(fx, "remove"), timestamp(NOW))
    return after.select("id", "is_present", "missing_since")


@query(
    "I4_mark_present_by_path",
    """
    SELECT id, is_present OR hit AS is_present, CASE WHEN NOT hit THEN missing_since END AS missing_since
    FROM (SELECT *, absolute_path IN (SELECT path FROM fx_events WHERE event_kind = 'create') AS hit FROM fx_media)
    """,
)
def i4(fx):
    return changeset.mark_present_by_key(fx.media(), _keys_of(fx, "create")).select("id", "is_present", "missing_since")


@query("I5_purge_missing", "SELECT id FROM fx_media WHERE is_present")
def i5(fx):
    return changeset.purge_missing(fx.media()).select("id")


@query(
    "I6_cascade_media",
    """
    SELECT 'value' AS part, id FROM fx_values WHERE media_file_id IN (SELECT id FROM fx_media WHERE is_present)
    UNION ALL SELECT 'item', id FROM fx_work_items WHERE media_file_id IN (SELECT id FROM fx_media WHERE is_present)
    """,
)
def i6(fx):
    left = changeset.purge_missing(fx.media())
    parts = {"value": fx.values(), "item": fx.work_items()}
    kept = [changeset.cascade_media(rows, left).select(F.lit(name).alias("part"), "id") for name, rows in parts.items()]
    return kept[0].unionByName(kept[1])


@query(
    "I6_cascade_folders",
    """
    , doomed AS (SELECT folder_id FROM fx_closure c JOIN fx_tree f ON f.id = c.ancestor_id JOIN nation ON n_nationkey + 100 = f.id WHERE n_regionkey = 2)
    SELECT 'folder' AS part, id FROM fx_tree WHERE id NOT IN (SELECT folder_id FROM doomed)
    UNION ALL SELECT 'media', id FROM fx_media WHERE folder_id NOT IN (SELECT folder_id FROM doomed)
    """,
)
def i6_folders(fx):
    folders = fx.tree_keys()
    deleted = fx.table("nation").where("n_regionkey = 2").select((F.col("n_nationkey") + 100).cast("bigint").alias("id"))
    kept, media = changeset.cascade_folders(folders, fx.media(), hierarchy.closure(folders), deleted)
    return kept.select(F.lit("folder").alias("part"), "id").unionByName(media.select(F.lit("media").alias("part"), "id"))


@query(
    "I7_delete_by_path",
    "SELECT id FROM fx_media WHERE absolute_path NOT IN (SELECT path FROM fx_events WHERE event_kind = 'remove')",
)
def i7(fx):
    return changeset.delete_where(fx.media(), _keys_of(fx, "remove"), changeset.MEDIA_KEY).select("id")


@query(
    "I8_insert_folders",
    """
    SELECT id, path FROM fx_tree
    UNION ALL SELECT NULL, concat('/lib/new/', s_name) FROM supplier
    """,
)
def i8(fx):
    new = fx.table("supplier").select(F.concat(F.lit("/lib/new/"), "s_name").alias("path"))
    again = fx.tree_keys().select("path")
    wanted = new.unionByName(again).select(F.xxhash64("path").alias("id"), F.lit(1).cast("bigint").alias("parent_id"), "path")
    after = changeset.insert_folders(fx.tree_keys(), wanted)
    return after.select(F.when(F.col("id") != F.xxhash64("path"), F.col("id")).alias("id"), "path")


@query("I9_set_scan_complete", "SELECT id, scan_complete OR id IN (SELECT 1000 + o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS scan_complete FROM fx_folders")
def i9(fx):
    ids = fx.table("orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") + 1000).alias("id"))
    folders = fx.folders_raw().select("id", "path", "scan_complete")
    return hierarchy.set_scan_state(folders, ids, True).select("id", "scan_complete")


@query(
    "I10_upsert_values",
    f"""
    , new AS (SELECT doc_id + 1 AS media_file_id, 1 AS searchable_config_id, concat('{{"chars":', n_chars, '}}') AS value_json FROM documents)
    SELECT coalesce(v.media_file_id, n.media_file_id) AS media_file_id, coalesce(n.value_json, v.value_json) AS value_json,
           coalesce(v.created_at, TIMESTAMP '{NOW}') AS created_at, CASE WHEN n.media_file_id IS NULL THEN v.updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at
    FROM fx_values v FULL JOIN new n ON n.media_file_id = v.media_file_id
    """,
)
def i10(fx):
    new = fx.table("documents").select(
        (F.col("doc_id") + 1).alias("media_file_id"), F.lit(1).cast("bigint").alias("searchable_config_id"),
        F.concat(F.lit('{"chars":'), F.col("n_chars").cast("string"), F.lit("}")).alias("value_json"),
    )
    after = annotate.upsert_values(fx.values(), new, timestamp(NOW))
    return after.select("media_file_id", "value_json", "created_at", "updated_at")


@query(
    "I11_delete_values",
    """
    SELECT 'media' AS part, id FROM fx_values WHERE media_file_id NOT IN (SELECT id FROM fx_media WHERE NOT is_present)
    UNION ALL SELECT 'config', id FROM fx_values WHERE id % 5 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
    """,
)
def i11(fx):
    gone = fx.media().where(~F.col("is_present")).select("id")
    configs = fx.table("nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("id"))
    by_media = annotate.delete_values_of_media(fx.values(), gone).select(F.lit("media").alias("part"), "id")
    spread = fx.values().withColumn("searchable_config_id", F.col("id") % 5)
    by_config = annotate.delete_values_of_configs(spread, configs).select(F.lit("config").alias("part"), "id")
    return by_media.unionByName(by_config)


@query(
    "I12_insert_configs",
    "SELECT name, kind, enabled FROM fx_configs UNION ALL SELECT DISTINCT concat('lang-', lang), 'tags', TRUE FROM documents",
)
def i12(fx):
    new = fx.table("documents").select("lang").distinct().select(
        F.xxhash64("lang").alias("id"), F.concat(F.lit("lang-"), "lang").alias("name"), F.lit("tags").alias("kind"),
        F.lit(True).alias("enabled"), F.lit("{}").alias("options"), timestamp(NOW).alias("created_at"),
    )
    return changeset.insert_configs(fx.configs(), new).select("name", "kind", "enabled")


# annotation work ----------------------------------------------------------

_REQUESTS = [("tagger", '{"model_name":"m0"}'), ("classifier", '{"model_name":"m1"}')]


@query(
    "I13_enqueue",
    f"""
    , req(job_kind, params_json) AS (VALUES ('tagger', '{{"model_name":"m0"}}'), ('classifier', '{{"model_name":"m1"}}'))
    SELECT media_file_id, job_kind, params_json, status, created_at FROM fx_work_items
    UNION ALL
    SELECT m.id, r.job_kind, r.params_json, 'pending', TIMESTAMP '{NOW}' FROM fx_media m, req r
    WHERE m.is_present AND NOT EXISTS (
      SELECT 1 FROM fx_work_items w WHERE w.media_file_id = m.id AND w.job_kind = r.job_kind AND w.params_json = r.params_json AND w.status = 'pending')
    """,
)
def i13(fx):
    after = annotate.enqueue(fx.work_items(), fx.media(), _REQUESTS, timestamp(NOW))
    return after.select("media_file_id", "job_kind", "params_json", "status", "created_at")


_RUNNABLE = "SELECT w.* FROM fx_work_items w JOIN fx_media m ON m.id = w.media_file_id WHERE w.status = 'pending' AND m.is_present"


@query("E9_runnable_items", f"SELECT id, job_kind, created_at FROM ({_RUNNABLE})")
def e9(fx):
    return annotate.runnable(fx.work_items(), fx.media()).select("id", "job_kind", "created_at")


@query("G5_next_batch", f"SELECT id, media_file_id, job_kind, created_at FROM ({_RUNNABLE}) ORDER BY created_at, id LIMIT 64")
def g5(fx):
    return annotate.next_batch(fx.work_items(), fx.media(), 64).select("id", "media_file_id", "job_kind", "created_at")


@query(
    "I14_claim",
    f"""
    , batch AS (SELECT id FROM ({_RUNNABLE}) ORDER BY created_at, id LIMIT 64)
    SELECT id, CASE WHEN id IN (SELECT id FROM batch) THEN 'running' ELSE status END AS status,
           CASE WHEN id IN (SELECT id FROM batch) THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM fx_work_items
    """,
)
def i14(fx):
    after = annotate.claim(fx.work_items(), fx.media(), 64, timestamp(NOW))
    return after.select("id", "status", "updated_at")


@query(
    "I15_record_done",
    f"SELECT id, CASE WHEN status = 'running' THEN 'done' ELSE status END AS status, CASE WHEN status = 'running' THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM fx_work_items",
)
def i15(fx):
    items = fx.work_items()
    after = annotate.complete(items, items.where(F.col("status") == "running"), timestamp(NOW))
    return after.select("id", "status", "updated_at")


@query(
    "I16_record_failed",
    """
    SELECT id, CASE WHEN bad THEN 'failed' ELSE status END AS status, attempts + CASE WHEN bad THEN 1 ELSE 0 END AS attempts,
           CASE WHEN bad THEN 'unknown job kind: mystery' END AS error
    FROM (SELECT *, status = 'running' AND job_kind = 'mystery' AS bad FROM fx_work_items)
    """,
)
def i16(fx):
    items = fx.work_items()
    bad = annotate.unknown_kinds(items.where(F.col("status") == "running"))
    return annotate.fail(items, bad, timestamp(NOW)).select("id", "status", "attempts", "error")


@query("F5_backlog", "SELECT count(*) AS n FROM fx_work_items WHERE status IN ('pending', 'running')")
def f5(fx):
    return annotate.backlog(fx.work_items())


@query("F5_backlog_by_kind", "SELECT job_kind, count(*) AS n FROM fx_work_items WHERE status IN ('pending', 'running') GROUP BY job_kind")
def f5_kind(fx):
    return annotate.backlog_by_kind(fx.work_items())


@query(
    "M3_annotate",
    """
    , run AS (SELECT w.id, w.media_file_id, w.job_kind, m.relative_path, m.file_size, m.format FROM fx_work_items w JOIN fx_media m ON m.id = w.media_file_id WHERE w.status = 'running'),
    out AS (SELECT *, CASE WHEN job_kind = 'mystery' THEN 'unknown job kind: mystery' WHEN format IS NULL THEN 'no format' END AS problem FROM run)
    SELECT w.id, CASE WHEN o.id IS NULL THEN w.status WHEN o.problem IS NULL THEN 'done' ELSE 'failed' END AS status, o.problem AS error,
           CASE WHEN o.id IS NOT NULL AND o.problem IS NULL THEN concat('{"size":', o.file_size, '}')
                WHEN o.id IS NULL OR o.problem IS NOT NULL THEN v.value_json END AS value_json
    FROM fx_work_items w LEFT JOIN out o ON o.id = w.id LEFT JOIN fx_values v ON v.media_file_id = w.media_file_id
    """,
)
def m3(fx):
    """Run a stand-in model over every running item; a row without format fails."""

    def model(pdf):
        if pdf["format"].isna().any():
            raise ValueError("no format")
        return pdf["file_size"].map(lambda n: '{"size":%d}' % n)

    now, media = timestamp(NOW), fx.media()
    items = fx.work_items().withColumn("searchable_config_id", F.lit(1).cast("bigint"))
    running = items.where(F.col("status") == "running")
    outcomes = checkpointed(annotate.run_models(running, media, model))
    after, values = annotate.record(items, fx.values(), outcomes, annotate.unknown_kinds(running), now)
    return after.join(values.select("media_file_id", "value_json"), "media_file_id", "left").select("id", "status", "error", "value_json")


@query(
    "M3_annotate_by_kind",
    """
    SELECT w.id, CASE job_kind WHEN 'classifier' THEN CASE WHEN file_size % 3 = 0 THEN 'divisible' END WHEN 'visionlanguage' THEN 'no model for kind: visionlanguage' END AS error,
           CASE WHEN job_kind = 'tagger' THEN concat('{"size":', file_size, '}')
                WHEN job_kind = 'classifier' AND file_size % 3 <> 0 THEN concat('{"class":', file_size % 3, '}') END AS value_json
    FROM fx_work_items w JOIN fx_media m ON m.id = w.media_file_id WHERE w.status = 'running' AND job_kind <> 'mystery'
    """,
)
def m3_by_kind(fx):
    """Running items, each by the model of its kind; one kind has none."""

    def tagger():
        return lambda pdf: pdf["file_size"].map(lambda n: '{"size":%d}' % n)

    def classifier():
        def model(pdf):
            if (pdf["file_size"] % 3 == 0).any():
                raise ValueError("divisible")
            return pdf["file_size"].map(lambda n: '{"class":%d}' % (n % 3))

        return model

    items = fx.work_items().withColumn("searchable_config_id", F.lit(1).cast("bigint"))
    models = {"tagger": tagger, "classifier": classifier}
    return annotate.run_models(items.where(F.col("status") == "running"), fx.media(), models).select("id", "error", "value_json")


@query(
    "M3_annotation_job",
    f"""
    SELECT m.id AS media_file_id, CASE WHEN format IS NULL THEN 'failed' ELSE 'done' END AS status, CASE WHEN format IS NULL THEN 'no format' END AS error,
           CASE WHEN format IS NOT NULL THEN concat('{{"size":', file_size, '}}') END AS value_json
    FROM fx_media m WHERE is_present AND folder_id IN {SUBTREE.format(SCOPE)}
    """,
)
def m3_job(fx):
    """Work asked for a folder and all below it, claimed, run and recorded by commits."""

    def model(pdf):
        if pdf["format"].isna().any():
            raise ValueError("no format")
        return pdf["file_size"].map(lambda n: '{"size":%d}' % n)

    now, catalog = timestamp(NOW), _fresh_catalog(fx)
    catalog.commit({"media": fx.media(), "folders": fx.folders()})
    request = [("tagger", '{"model_name":"m0"}')]
    asked = annotation.enqueue(catalog, request, now, SCOPE, config_id=7)
    annotation.run_batch(catalog, model, asked // 2 + 1, now)
    annotation.run_batch(catalog, model, asked, now)
    items = catalog.read("work_items").select("media_file_id", "status", "error")
    return items.join(catalog.read("values").select("media_file_id", "value_json"), "media_file_id", "left")


# change events ------------------------------------------------------------

_CLASSIFIED = """
, classified AS (
  SELECT *, CASE WHEN event_kind = 'remove' OR NOT path_exists THEN 'remove' ELSE 'upsert' END AS kind FROM fx_events
  WHERE event_kind <> 'access' AND NOT (path_exists AND (is_dir OR
        lower(regexp_extract(path, '[^/]+\\.([^./]*)$', 1)) NOT IN ('jpg','jpeg','png','webp','gif','bmp','tiff','avif')))
)
"""
_COLLAPSED = _CLASSIFIED + ", collapsed AS (SELECT path, CASE WHEN bool_or(kind = 'remove') THEN 'remove' ELSE 'upsert' END AS kind FROM classified GROUP BY path)"


@query("L2_classify_events", _CLASSIFIED + "SELECT event_id, path, kind FROM classified")
def l2(fx):
    return changes.classify(fx.events()).select("event_id", "path", "kind")


@query("F4_collapse_remove_wins", _COLLAPSED + "SELECT path, kind FROM collapsed")
def f4(fx):
    return changes.collapse(changes.classify(fx.events()))


@query("F4_collapse_latest", _CLASSIFIED + "SELECT path, arg_max(kind, (ts, event_id)) AS kind FROM classified GROUP BY path")
def f4_latest(fx):
    return changes.collapse(changes.classify(fx.events()), order="latest")


@query(
    "L1_debounce_event_time",
    _CLASSIFIED
    + """
    , marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM classified WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked)
    SELECT path, CASE WHEN bool_or(kind = 'remove') THEN 'remove' ELSE 'upsert' END AS kind, count(*) AS n_events, min(ts) AS first_ts
    FROM numbered GROUP BY path, session
    """,
)
def l1(fx):
    return changes.debounce(changes.classify(fx.events()), "6 hours")


_RESOLVED = (
    _COLLAPSED
    + """
, resolved AS (
  SELECT path, kind, CASE WHEN starts_with(path, '/lib/ASIA/') THEN 2 ELSE 1 END AS rule_no,
         CASE WHEN starts_with(path, '/lib/ASIA/') THEN substr(path, 11) ELSE substr(path, 6) END AS relative_path
  FROM collapsed WHERE starts_with(path, '/lib/ASIA/') OR NOT (starts_with(path, '/lib/EUROPE/') OR contains(path, 'ASIA/NATION_1'))
)
"""
)


@query("L4_resolve", _RESOLVED + "SELECT path, kind, CAST(rule_no AS INTEGER) AS rule_no, relative_path FROM resolved")
def l4(fx):
    found = changes.resolve(changes.collapse(changes.classify(fx.events())), RULES)
    return found.select("path", "kind", "rule_no", "relative_path")


@query(
    "F9_affected_folders",
    _COLLAPSED + "SELECT DISTINCT folder_id FROM collapsed JOIN fx_media ON absolute_path = path",
)
def f9(fx):
    hit = changes.collapse(changes.classify(fx.events())).withColumnRenamed("path", "absolute_path")
    return changes.affected_folders(fx.media().join(hit, "absolute_path"))


def _printer(upserts):
    """Stand-in fingerprints for paths that exist only in the tables."""
    return upserts.select(
        "path", F.length("path").cast("bigint").alias("size"), timestamp(NOW).alias("mtime"),
        fingerprint.format_of("path").alias("format"), F.sha2("path", 256).alias("content_hash"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("error"),
    )


_APPLIED = f"""
SELECT {SUMMARY.replace("created_at, ", "").replace("content_hash", "CASE WHEN kind = 'upsert' THEN sha256(absolute_path) ELSE content_hash END AS content_hash")
        .replace("width, height, format, file_size", '''CASE WHEN kind = 'upsert' THEN NULL ELSE width END AS width, CASE WHEN kind = 'upsert' THEN NULL ELSE height END AS height,
        CASE WHEN kind <> 'upsert' OR kind IS NULL THEN format WHEN lower(format_ext) = 'jpg' THEN 'jpeg' ELSE lower(format_ext) END AS format,
        CASE WHEN kind = 'upsert' THEN length(absolute_path) ELSE file_size END AS file_size''')
        .replace("modified_at", f"CASE WHEN kind = 'upsert' THEN TIMESTAMP '{NOW}' ELSE modified_at END AS modified_at")
        .replace("is_present, missing_since", f"CASE kind WHEN 'upsert' THEN TRUE WHEN 'remove' THEN FALSE ELSE is_present END AS is_present, CASE kind WHEN 'upsert' THEN NULL WHEN 'remove' THEN TIMESTAMP '{NOW}' ELSE missing_since END AS missing_since")}
FROM (SELECT m.*, c.kind, regexp_extract(m.absolute_path, '[^/]+\\.([^./]*)$', 1) AS format_ext FROM fx_media m LEFT JOIN collapsed c ON c.path = m.absolute_path)
"""


@query("L5_apply_stream", _COLLAPSED + _APPLIED)
def l5(fx):
    """Events read as a stream and committed batch by batch to a fresh catalogue."""
    spark, now = fx.spark, timestamp(NOW)
    work = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    # several files and batches; the events of a path stay together
    fx.events().repartition(6, "path").write.parquet(f"{work}/events")
    catalog = _fresh_catalog(fx)
    catalog.commit({"folders": fx.folders(), "media": fx.media()})
    rules = [{"rule_no": 1, "path": "/lib"}]
    feed = stream.read_events(spark, f"{work}/events", per_batch=3)
    running = stream.run(feed, catalog, rules, now, f"{work}/progress", trigger={"availableNow": True}, printer=_printer)
    running.awaitTermination()
    return catalog.read("media").drop("created_at")


def _feed_out_of_order(fx, work):
    """Event files that do not go by time, and a last one that only moves the clock."""
    fx.events().repartition(5, F.xxhash64("event_id")).write.parquet(f"{work}/events")
    beat = fx.spark.range(1).select(
        F.lit(-1).cast("bigint").alias("event_id"), timestamp("2100-01-01 00:00:00").alias("ts"), F.lit("").alias("path"),
        F.lit("heartbeat").alias("event_kind"), F.lit(False).alias("path_exists"), F.lit(False).alias("is_dir"),
    )
    # the file source takes files by their time
    time.sleep(0.05)
    beat.coalesce(1).write.mode("append").parquet(f"{work}/events")
    return stream.read_events(fx.spark, f"{work}/events", per_batch=2)


_BURSTS = (
    _CLASSIFIED
    + """
, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM classified WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM marked),
bursts AS (
  SELECT path, burst, CASE WHEN bool_or(kind = 'remove') THEN 'remove' ELSE 'upsert' END AS kind, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts
  FROM numbered GROUP BY path, burst)
"""
)


@query("L1_debounce_stream", _BURSTS + "SELECT path, kind, n_events, first_ts, last_ts FROM bursts")
def l1_stream(fx):
    """Bursts that lie in several files and batches, each passed on once."""
    work = f"{checkpoint_root(fx.spark)}/settle-{uuid.uuid4().hex}"
    # as far out of order as the events go, so that nothing is late
    out = settle.settled(_feed_out_of_order(fx, work), "6 hours", delay="4000 days", keep="1 day")
    writer = out.writeStream.format("parquet").option("path", f"{work}/settled").option("checkpointLocation", f"{work}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.schema(out.schema).parquet(f"{work}/settled").select("path", "kind", "n_events", "first_ts", "last_ts")


def _applied_out_of_order(fx, order):
    spark, now = fx.spark, timestamp(NOW)
    work = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    catalog = _fresh_catalog(fx)
    catalog.commit({"folders": fx.folders(), "media": fx.media()})
    feed = _feed_out_of_order(fx, work)
    # events are later than the watermark allows, so bursts are corrected
    running = stream.run(
        feed, catalog, [{"rule_no": 1, "path": "/lib"}], now, f"{work}/progress", trigger={"availableNow": True}, printer=_printer, order=order,
        debounce="6 hours", delay="1 hour", keep="4000 days",
    )
    running.awaitTermination()
    # a file that went after it was printed keeps that print, which batches decide
    shown = [F.when(F.col("is_present"), F.col(c)).alias(c) for c in ("content_hash", "width", "height", "format", "file_size", "modified_at")]
    return catalog.read("media").select("id", "folder_id", "relative_path", "absolute_path", "is_present", "missing_since", *shown)


_SHOWN = "SELECT id, folder_id, relative_path, absolute_path, is_present, missing_since, " + ", ".join(
    f"CASE WHEN is_present THEN {c} END AS {c}" for c in ("content_hash", "width", "height", "format", "file_size", "modified_at")
) + f" FROM ({_APPLIED})"


@query("L5_stream_order_latest", _CLASSIFIED + ", collapsed AS (SELECT path, arg_max(kind, (ts, event_id)) AS kind FROM classified GROUP BY path)" + _SHOWN)
def l5_latest(fx):
    """Events in any order and batch give what the newest of each path says."""
    return _applied_out_of_order(fx, "latest")


@query("L5_stream_order_bursts", _BURSTS + ", collapsed AS (SELECT path, arg_max(kind, last_ts) AS kind FROM bursts GROUP BY path)" + _SHOWN)
def l5_bursts(fx):
    """The same where a remove wins within a burst."""
    return _applied_out_of_order(fx, "remove_wins")


@query(
    "M1_fingerprint_content",
    """
    SELECT concat('/docs/', source, '/', doc_id, CASE WHEN lang = 'en' THEN '.JPG' WHEN lang = 'de' THEN '.png' ELSE '' END) AS path,
           sha256(text) AS content_hash, CAST(NULL AS INTEGER) AS width, CAST(NULL AS INTEGER) AS height,
           CASE WHEN lang = 'en' THEN 'jpeg' WHEN lang = 'de' THEN 'png' END AS format
    FROM documents
    """,
)
def m1(fx):
    """Documents as files: whole contents hashed; no header fits, so no dimensions."""
    lang = F.col("lang")
    ext = F.when(lang == "en", ".JPG").when(lang == "de", ".png").otherwise("")
    path = F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), ext)
    files = fx.table("documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    return fingerprint.fingerprint_content(files)


_PICTURE = "unhex(concat('89504E470D0A1A0A0000000D49484452', printf('%08X', page_id % 90 + 1), printf('%08X', page_id % 70 + 2), '0802000000'))"


def _write_files(batches):
    """Write rows of (path, content) as files."""
    import os

    import pandas as pd

    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as out:
                out.write(content)
        yield pd.DataFrame({"n": [len(pdf)]})


@query(
    "I17_ingest_files",
    f"""
    , files AS (
      SELECT concat('d', page_id % 7, '/', page_id, CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.gif' ELSE '.PNG' END) AS relative_path, page_id,
             CASE WHEN page_id % 3 = 1 THEN encode(html) ELSE {_PICTURE} || encode(html) END AS content
      FROM pages)
    SELECT relative_path, CAST(octet_length(content) AS BIGINT) AS file_size, sha256(content) AS content_hash,
           CAST(CASE WHEN page_id % 3 <> 1 THEN page_id % 90 + 1 END AS INTEGER) AS width,
           CAST(CASE WHEN page_id % 3 <> 1 THEN page_id % 70 + 2 END AS INTEGER) AS height,
           CASE WHEN page_id % 3 = 1 THEN 'gif' ELSE 'png' END AS format, TRUE AS is_present,
           (SELECT count(*) FROM files) AS unchanged
    FROM files
    """,
)
def i17_ingest(fx):
    """Pages as files, some with a picture's header: written by the executors, scanned,
    and scanned again after the folders' states are reset."""
    spark, now = fx.spark, timestamp(NOW)
    root = re.sub("^file:/+", "/", f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}")
    n = F.col("page_id")
    name = F.concat(
        F.lit(f"{root}/d"), (n % 7).cast("string"), F.lit("/"), n.cast("string"), F.when(n % 3 == 0, ".png").when(n % 3 == 1, ".gif").otherwise(".PNG")
    )
    size = F.concat(F.lpad(F.hex(n % 90 + 1), 8, "0"), F.lpad(F.hex(n % 70 + 2), 8, "0"))
    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), size, F.lit("0802000000")))
    html = F.encode("html", "UTF-8")
    content = F.when(n % 3 == 1, html).otherwise(F.concat(header, html))
    fx.table("pages").select(name.alias("path"), content.alias("content")).repartition("path").mapInPandas(_write_files, "n bigint").agg(F.sum("n")).collect()
    catalog, rule = _fresh_catalog(fx), {"path": f"{root}/"}
    ingest.scan_import(spark, catalog, rule, now)
    again = ingest.rescan_import(spark, catalog, rule, now).first()
    media = catalog.read("media").select("relative_path", "file_size", "content_hash", "width", "height", "format", "is_present")
    return media.withColumn("unchanged", F.lit(again.unchanged))


_TREE_PIECE, _TREE_CHILDREN = 700, 4


@query(
    "M1_tree_hash",
    f"""
    , body AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
    node AS (
      SELECT doc_id, 0 AS level, i AS no, greatest((strlen(h) // 2 + {_TREE_PIECE - 1}) // {_TREE_PIECE}, 1) AS n,
             sha256(unhex('00' || substr(h, 2 * {_TREE_PIECE} * i + 1, 2 * {_TREE_PIECE}))) AS digest
      FROM (SELECT *, unnest(range(greatest((strlen(h) // 2 + {_TREE_PIECE - 1}) // {_TREE_PIECE}, 1))) AS i FROM body)
      UNION ALL
      SELECT doc_id, level + 1, no // {_TREE_CHILDREN}, (n + {_TREE_CHILDREN - 1}) // {_TREE_CHILDREN}, sha256(unhex('01' || string_agg(digest, '' ORDER BY no)))
      FROM node WHERE n > 1 GROUP BY doc_id, level, no // {_TREE_CHILDREN}, n)
    SELECT concat('d', doc_id % 5, '/', doc_id, '.png') AS relative_path, CAST(strlen(h) // 2 AS BIGINT) AS file_size, digest AS content_hash,
           CAST(NULL AS INTEGER) AS width
    FROM node JOIN body USING (doc_id) WHERE n = 1
    """,
)
def m1_tree(fx):
    """Texts of very unequal length as files, scanned with the hash that several tasks share."""
    spark, now = fx.spark, timestamp(NOW)
    root = re.sub("^file:/+", "/", f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}")
    n = F.col("doc_id")
    name = F.concat(F.lit(f"{root}/d"), (n % 5).cast("string"), F.lit("/"), n.cast("string"), F.lit(".png"))
    files = fx.table("documents").select(name.alias("path"), F.encode("text", "UTF-8").alias("content"))
    files.repartition("path").mapInPandas(_write_files, "n bigint").agg(F.sum("n")).collect()
    listing, _ = filetree.list_tree(spark, root)
    found = fingerprint.fingerprint_files(listing.drop("error"), fingerprint.TREE, piece=_TREE_PIECE, children=_TREE_CHILDREN)
    return found.select(paths.relative_to("path", F.lit(root)).alias("relative_path"), F.col("size").alias("file_size"), "content_hash", "width")


@query(
    "A8_scan_all",
    """
    SELECT concat('d', page_id % 2) AS import, count(*) AS processed, CAST(NULL AS VARCHAR) AS reason FROM pages GROUP BY 1
    UNION ALL SELECT 'gone', NULL, 'not reachable' UNION ALL SELECT '', NULL, 'no path configured'
    """,
)
def a8_scan_all(fx):
    """Pages as the files of two imports, scanned beside one without a path and one that is not there."""
    spark, now = fx.spark, timestamp(NOW)
    root = re.sub("^file:/+", "/", f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}")
    n = F.col("page_id")
    name = F.concat(F.lit(f"{root}/d"), (n % 2).cast("string"), F.lit("/"), n.cast("string"), F.lit(".gif"))
    files = fx.table("pages").select(name.alias("path"), F.encode("html", "UTF-8").alias("content"))
    files.repartition("path").mapInPandas(_write_files, "n bigint").agg(F.sum("n")).collect()
    rules = [{"path": p} for p in ("", f"{root}/gone", *(f"{root}/d{k}" for k in range(2)))]
    report = ingest.scan_all(spark, _fresh_catalog(fx), rules, now)
    return report.select(F.regexp_replace("root", "^.*/", "").alias("import"), "processed", "reason")
