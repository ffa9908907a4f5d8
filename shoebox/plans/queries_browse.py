"""Registered queries: tables, projections, filters, counts, orderings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shoebox.functions import json_cols, paths
from shoebox.operators import browse, changes, changeset, diff, hierarchy
from shoebox.operators.skew import with_position
from shoebox.plans.registry import query
from shoebox.schemas import MEDIA, timestamp
from shoebox.session import checkpoint_root
from shoebox.sources import imports
from shoebox.sources.catalog import Catalog
from shoebox.sources.fixtures import NOW

FOLDER, SCOPE, LIBRARY = 1005, 12, 1
EXCLUDE, INCLUDE = ["ASIA/NATION_1", "/lib/EUROPE"], ["NATION_", "/lib/AFRICA"]

MEDIA_FILE = "id, folder_id, relative_path, absolute_path, content_hash, width, height, format, file_size, is_present, missing_since"
SUMMARY = "id, folder_id, relative_path, absolute_path, content_hash, width, height, format, file_size, created_at, modified_at, is_present, missing_since"
SUBTREE = "(SELECT folder_id FROM fx_closure WHERE ancestor_id = {})"
IN_LIBRARY, IN_SCOPE = SUBTREE.format(LIBRARY), SUBTREE.format(SCOPE)


def _fresh_catalog(fx) -> Catalog:
    return Catalog(fx.spark, f"{checkpoint_root(fx.spark)}/catalog-{uuid.uuid4().hex}")


# tables -------------------------------------------------------------------


@query("A3_catalog_scan", f"SELECT {SUMMARY} FROM fx_media")
def a3(fx):
    catalog = _fresh_catalog(fx)
    catalog.commit({"media": fx.media()})
    return catalog.read("media")


@query(
    "A4_catalog_write_touched",
    f"""
    SELECT {SUMMARY.replace("is_present, missing_since", "is_present AND NOT hit AS is_present")},
           CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE missing_since END AS missing_since
    FROM (SELECT {SUMMARY}, absolute_path IN (SELECT path FROM fx_events WHERE event_kind = 'remove') AS hit FROM fx_media)
    """,
)
def a4(fx):
    """Commit everything, then the rows that change."""
    catalog, now = _fresh_catalog(fx), timestamp(NOW)
    media = fx.media()
    catalog.commit({"media": media})
    removed = fx.events().where(F.col("event_kind") == "remove").select(F.col("path").alias("absolute_path")).distinct()
    rows = changeset.mark_missing_by_key(
        catalog.read("media").join(removed, "absolute_path", "left_semi"), removed, now, ["absolute_path"]
    ).select(*MEDIA.names)
    catalog.commit(changes={"media": rows})
    return catalog.read("media")


@query(
    "A6_json_ids",
    """
    SELECT o_orderkey, UNNEST(CAST(CAST(concat('[', o_orderkey, ', ', o_custkey, ']') AS JSON) AS BIGINT[])) AS id FROM orders
    """,
)
def a6(fx):
    text = F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit("]"))
    return fx.table("orders").select("o_orderkey", F.explode(json_cols.id_list(text)).alias("id"))


def _customer_imports(fx):
    """One import per customer folder; furniture customers forgot their path."""
    path = F.when(F.col("segment") == "FURNITURE", "").otherwise(F.col("path"))
    return fx.tree().where(F.col("segment").isNotNull()).select(F.col("id").cast("int").alias("rule_no"), path.alias("path"))


@query(
    "A8_reachable_imports",
    """
    , dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM fx_listing),
    rules AS (SELECT CAST(id AS INTEGER) AS rule_no, CASE WHEN segment = 'FURNITURE' THEN '' ELSE path END AS path
              FROM fx_tree WHERE segment IS NOT NULL)
    SELECT rule_no, r.path, CASE WHEN r.path = '' THEN 'no path configured' WHEN d.path IS NULL THEN 'not reachable' END AS reason
    FROM rules r LEFT JOIN dirs d ON d.path = r.path
    """,
)
def a8(fx):
    dirs = fx.listing().select(paths.parent_dir("path").alias("path"))
    good, bad = imports.reachable(_customer_imports(fx), dirs)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query(
    "A9_imports_needing_scan",
    """
    , rules AS (SELECT CAST(id AS INTEGER) AS rule_no, CASE WHEN segment = 'FURNITURE' THEN '' ELSE path END AS path
                FROM fx_tree WHERE segment IS NOT NULL)
    SELECT rule_no, path FROM rules r
    WHERE NOT EXISTS (SELECT 1 FROM fx_folders f WHERE f.path = r.path AND f.scan_complete)
    """,
)
def a9(fx):
    return imports.needing_scan(_customer_imports(fx), fx.folders_raw().select("path", "scan_complete"))


# projections --------------------------------------------------------------


@query("B1_media_file", f"SELECT {MEDIA_FILE} FROM fx_media")
def b1(fx):
    return browse.media_files(fx.media())


@query("B2_media_summary", f"SELECT {SUMMARY}, CAST(NULL AS DOUBLE) AS search_score FROM fx_media")
def b2(fx):
    return browse.summaries(fx.media()).withColumn("search_score", F.col("search_score").cast("double"))


@query(
    "B3_folder_json_lists",
    """
    SELECT id, parent_id, path, recursive, scan_complete,
           CASE exclude WHEN '["private","/lib/x"]' THEN 'private|/lib/x' ELSE '' END AS exclude,
           CASE include WHEN '["Customer"]' THEN 'Customer' ELSE '' END AS include,
           thumbnail_cache_mode, thumbnail_cache_folder, thumbnail_cache_fallback
    FROM fx_folders
    """,
)
def b3(fx):
    parsed = browse.parse_folders(fx.folders_raw())
    return parsed.withColumn("exclude", F.array_join("exclude", "|")).withColumn("include", F.array_join("include", "|"))


# filters ------------------------------------------------------------------

_EXT = "lower(regexp_extract(path, '[^/]+\\.([^./]*)$', 1))"
_SUPPORTED = "('jpg','jpeg','png','webp','gif','bmp','tiff','avif')"


@query(
    "C1_supported_extension",
    f"SELECT path, {_EXT} AS extension, {_EXT} IN {_SUPPORTED} AS supported FROM fx_listing",
)
def c1(fx):
    return fx.listing().select(
        "path", paths.extension("path").alias("extension"), paths.is_supported("path").alias("supported")
    )


def _sql_match(path: str, patterns: list[str]) -> str:
    tests = [f"{path} = '{p}'" if p.startswith("/") else f"contains({path}, '{p}')" for p in patterns]
    return "(" + " OR ".join(tests) + ")"


@query("C2_exclude", f"SELECT path, {_sql_match('path', EXCLUDE)} AS excluded FROM fx_listing")
def c2(fx):
    return fx.listing().select("path", paths.is_excluded("path", EXCLUDE).alias("excluded"))


@query("C3_include", f"SELECT path, {_sql_match('path', INCLUDE)} AS included, TRUE AS included_by_empty FROM fx_listing")
def c3(fx):
    return fx.listing().select(
        "path", paths.is_included("path", F.lit(INCLUDE)).alias("included"),
        paths.is_included("path", F.array().cast("array<string>")).alias("included_by_empty"),
    )


@query(
    "C4_exclude_beats_include",
    f"SELECT path, size FROM fx_listing WHERE NOT {_sql_match('path', EXCLUDE)} AND {_sql_match('path', INCLUDE)}",
)
def c4(fx):
    return fx.listing().where(paths.is_admitted("path", EXCLUDE, INCLUDE)).select("path", "size")


_PREFIXES = """
, dirs AS (SELECT DISTINCT path FROM fx_listing),
steps AS (
  SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS prefix
  FROM (SELECT path, UNNEST(range(2, len(string_split(path, '/')) + 1)) AS i FROM dirs)
)
"""


@query(
    "C5_directory_pruning",
    _PREFIXES
    + f"""
    SELECT 'exclude' AS lists, path, size FROM fx_listing WHERE path NOT IN (
      SELECT path FROM steps WHERE length(prefix) > length('/lib') AND {_sql_match('prefix', EXCLUDE)})
    UNION ALL SELECT 'both', path, size FROM fx_listing WHERE path NOT IN (
      SELECT path FROM steps WHERE length(prefix) > length('/lib') AND ({_sql_match('prefix', EXCLUDE)} OR NOT {_sql_match('prefix', INCLUDE)}))
    """,
)
def c5(fx):
    """Both rule sets in one pass over the listing."""
    lists = [
        F.when(paths.survives_pruning("path", F.lit("/lib"), EXCLUDE, include), F.lit(name))
        for name, include in (("exclude", []), ("both", INCLUDE))
    ]
    return fx.listing().select(F.explode(F.array_compact(F.array(*lists))).alias("lists"), "path", "size")


@query(
    "C6_skip_complete_subfolders",
    _PREFIXES
    + f"""
    SELECT path, size FROM fx_listing WHERE path NOT IN (
      SELECT s.path FROM steps s JOIN fx_folders f ON f.path = s.prefix
      WHERE f.scan_complete AND f.id <> {LIBRARY} AND f.id IN {IN_LIBRARY})
    """,
)
def c6(fx):
    folders = fx.folders_raw().select("id", "parent_id", "path", "scan_complete")
    kept = hierarchy.prune_complete(fx.listing(), folders, folders, LIBRARY, "/lib")
    return kept.select("path", "size")


@query(
    "C7_folder_rows_by_id",
    f"SELECT {SUMMARY}, row_number() OVER (ORDER BY id) AS position FROM fx_media WHERE folder_id = {FOLDER}",
)
def c7(fx):
    rows = browse.in_folder(fx.media(), FOLDER).select(*browse.SUMMARY_COLUMNS)
    return with_position(rows, [F.col("id")])


@query("C8_folder_rows", f"SELECT {MEDIA_FILE} FROM fx_media WHERE folder_id = {FOLDER}")
def c8(fx):
    return browse.media_files(browse.in_folder(fx.media(), FOLDER))


@query("C9_lookup_by_id", f"SELECT {MEDIA_FILE} FROM fx_media WHERE id IN (SELECT value::BIGINT FROM (SELECT user_id * 2 AS value FROM events))")
def c9(fx):
    """Every id the event feed asks for."""
    return browse.by_ids(fx.media(), fx.table("events").select((F.col("user_id") * 2).alias("id")))


@query(
    "C10_lookup_by_path",
    f"""
    SELECT {MEDIA_FILE} FROM fx_media m WHERE EXISTS (
      SELECT 1 FROM fx_listing l JOIN fx_tree f ON f.path = regexp_replace(l.path, '/[^/]*$', '')
      WHERE f.id = m.folder_id AND substr(l.path, 6) = m.relative_path)
    """,
)
def c10(fx):
    """Every (folder, relative path) the later listing holds."""
    listed = diff.assign_folders(fx.listing().select("path"), fx.tree_keys(), F.lit(LIBRARY).cast("bigint"))
    keys = listed.select("folder_id", paths.relative_to("path", F.lit("/lib")).alias("relative_path"))
    return browse.by_relative_paths(fx.media(), keys)


@query(
    "C11_folder_by_path",
    "SELECT id, parent_id, path FROM fx_tree WHERE path IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM fx_listing)",
)
def c11(fx):
    wanted = fx.listing().select(paths.parent_dir("path").alias("path"))
    return browse.folders_by_paths(fx.tree_keys(), wanted)


@query("C12_root_folders", "SELECT id, path FROM fx_folders WHERE parent_id IS NULL")
def c12(fx):
    return browse.root_folders(fx.tree_keys()).select("id", "path")


@query(
    "C13_child_folders",
    "SELECT id, path, row_number() OVER (ORDER BY path) AS position FROM fx_folders WHERE parent_id = 102",
)
def c13(fx):
    rows = browse.child_folders(fx.tree_keys(), 102).select("id", "path")
    return with_position(rows, [F.col("path")])


@query(
    "C14_configs_by_name",
    """
    SELECT 'enabled' AS part, name, kind, row_number() OVER (ORDER BY name) AS position FROM fx_configs WHERE enabled
    UNION ALL SELECT 'all', name, kind, row_number() OVER (ORDER BY name) FROM fx_configs
    """,
)
def c14(fx):
    parts = []
    for label, only in (("enabled", True), ("all", False)):
        rows = browse.configs(fx.configs(), only).select(F.lit(label).alias("part"), "name", "kind")
        parts.append(with_position(rows, [F.col("name")]))
    return parts[0].unionByName(parts[1])


@query("C15_present_targets", f"SELECT {MEDIA_FILE} FROM fx_media WHERE is_present")
def c15(fx):
    return browse.media_files(browse.present(fx.media()))


@query(
    "C16_unchanged",
    """
    SELECT l.path, coalesce(l.size = m.file_size, FALSE) AND l.mtime IS NOT DISTINCT FROM m.modified_at AND m.format IS NOT NULL AS unchanged
    FROM fx_listing l JOIN fx_media m ON m.absolute_path = l.path
    """,
)
def c16(fx):
    both = fx.listing().join(fx.media().withColumnRenamed("absolute_path", "path"), "path")
    same = diff.unchanged(*[F.col(c) for c in ("size", "mtime", "file_size", "modified_at", "format")])
    return both.select("path", same.alias("unchanged"))


# joins --------------------------------------------------------------------

_ACTION = """
CASE WHEN l.path IS NULL THEN CASE WHEN m.is_present THEN 'absent' ELSE 'gone' END
     WHEN m.id IS NULL THEN 'new'
     WHEN NOT (coalesce(l.size = m.file_size, FALSE) AND l.mtime IS NOT DISTINCT FROM m.modified_at AND m.format IS NOT NULL) THEN 'changed'
     WHEN m.is_present THEN 'same' ELSE 'restored' END
"""


@query(
    "E1_listing_vs_catalog",
    f"SELECT coalesce(l.path, m.absolute_path) AS path, m.id AS old_id, {_ACTION} AS action FROM fx_listing l FULL JOIN fx_media m ON m.absolute_path = l.path",
)
def e1(fx):
    return diff.compare(fx.listing(), fx.media()).select("path", "old_id", "action")


@query("E2_subtree_summaries", f"SELECT {SUMMARY}, row_number() OVER (ORDER BY id) AS position FROM fx_media WHERE folder_id IN {IN_LIBRARY}")
def e2(fx):
    rows = browse.in_subtree(fx.media(), fx.tree_keys(), LIBRARY).select(*browse.SUMMARY_COLUMNS)
    return with_position(rows, [F.col("id")])


@query("E3_subtree_semi", f"SELECT {MEDIA_FILE} FROM fx_media WHERE folder_id IN {IN_SCOPE}")
def e3(fx):
    return browse.media_files(browse.in_subtree(fx.media(), fx.tree_keys(), SCOPE))


@query(
    "E4_hydrate_ids",
    f"""
    SELECT 'recursive' AS scope, {SUMMARY} FROM fx_media WHERE folder_id IN {IN_LIBRARY} AND id IN (SELECT user_id * 2 FROM events)
    UNION ALL
    SELECT 'direct', {SUMMARY} FROM fx_media WHERE folder_id = {FOLDER} AND id IN (SELECT o_orderkey FROM orders)
    """,
)
def e4(fx):
    media, tree = fx.media(), fx.tree_keys()
    wanted = fx.table("events").select((F.col("user_id") * 2).alias("id"))
    every = fx.table("orders").select(F.col("o_orderkey").alias("id"))
    below = browse.hydrate(media, wanted, tree, LIBRARY, True).withColumn("scope", F.lit("recursive"))
    here = browse.hydrate(media, every, tree, FOLDER, False).withColumn("scope", F.lit("direct"))
    return below.unionByName(here).drop("search_score")


@query(
    "E5_path_scope",
    f"""
    SELECT {MEDIA_FILE} FROM fx_media WHERE folder_id IN (
      SELECT f.id FROM fx_tree f, (SELECT path FROM fx_tree WHERE id = {SCOPE}) r
      WHERE f.id = {SCOPE} OR starts_with(f.path, concat(r.path, '/')))
    """,
)
def e5(fx):
    return browse.media_files(browse.in_path_scope(fx.media(), fx.tree_keys(), SCOPE))


RULES = [
    {"rule_no": 1, "path": "/lib", "exclude": EXCLUDE, "include": []},
    {"rule_no": 2, "path": "/lib/ASIA", "exclude": [], "include": ["NATION_"]},
    {"rule_no": 3, "path": "", "exclude": [], "include": []},
    {"rule_no": 4, "path": "/gone", "exclude": [], "include": []},
]


@query(
    "E8_longest_import",
    """
    , rules(rule_no, root) AS (VALUES (1, '/lib'), (2, '/lib/ASIA'), (3, ''), (4, '/gone'), (5, '/lib/EUROPE'))
    SELECT path, CAST(arg_max(rule_no, (length(root), rule_no)) AS INTEGER) AS rule_no
    FROM fx_listing JOIN rules ON root = '' OR path = root OR starts_with(path, concat(root, '/')) GROUP BY path
    """,
)
def e8(fx):
    number = paths.longest_rule("path", [*[(r["rule_no"], r["path"]) for r in RULES], (5, "/lib/EUROPE//")])
    return fx.listing().select("path", number.alias("rule_no"))


@query(
    "E8_longest_import_many_rules",
    """
    , hits AS (
      SELECT l.path, f.id, length(f.path) AS n FROM fx_listing l JOIN fx_tree f ON starts_with(l.path, concat(f.path, '/'))
    )
    SELECT path, CAST(arg_max(id, n) AS INTEGER) AS rule_no FROM hits GROUP BY path
    """,
)
def e8_many(fx):
    """Every folder is an import root: matched by prefix, not pair by pair."""
    rules = fx.tree_keys().select(F.col("id").cast("int").alias("rule_no"), "path")
    return changes.match_rules(fx.listing().select("path"), rules).select("path", "rule_no")


@query(
    "E10_insert_if_absent",
    """
    , wanted AS (
      SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM fx_listing
      UNION SELECT concat('/lib/new/', s_name) FROM supplier
    )
    SELECT w.path, f.id AS known_id FROM wanted w LEFT JOIN fx_tree f ON f.path = w.path
    """,
)
def e10(fx):
    held = fx.listing().select(paths.parent_dir("path").alias("path")).distinct()
    other = fx.table("supplier").select(F.concat(F.lit("/lib/new/"), "s_name").alias("path"))
    wanted = held.union(other).distinct().withColumn("id", F.xxhash64("path"))
    got = changeset.get_or_create_folders(fx.tree_keys(), wanted)
    return got.select("path", F.when(F.col("id") != F.xxhash64("path"), F.col("id")).alias("known_id"))


@query(
    "E11_folder_of_file",
    f"""
    SELECT l.path, coalesce(f.id, {LIBRARY}) AS folder_id
    FROM fx_listing l LEFT JOIN (SELECT id, path FROM fx_tree WHERE segment IS DISTINCT FROM 'BUILDING') f
      ON f.path = regexp_replace(l.path, '/[^/]*$', '')
    """,
)
def e11(fx):
    known = fx.tree().where(~F.col("segment").eqNullSafe(F.lit("BUILDING")))
    return diff.assign_folders(fx.listing().select("path"), known, F.lit(LIBRARY).cast("bigint")).select("path", "folder_id")


@query("E12_not_listed", "SELECT id, absolute_path FROM fx_media WHERE absolute_path NOT IN (SELECT path FROM fx_listing)")
def e12(fx):
    listed = fx.listing().select(F.col("path").alias("absolute_path"))
    return fx.media().join(listed, "absolute_path", "left_anti").select("id", "absolute_path")


# counts -------------------------------------------------------------------


@query("F1_count_folder", "SELECT folder_id, count(*) AS n FROM fx_media GROUP BY folder_id")
def f1(fx):
    return browse.counts_by_folder(fx.media())


@query("F1_count_one_folder", f"SELECT count(*) AS n FROM fx_media WHERE folder_id = {FOLDER}")
def f1_one(fx):
    return browse.count_in_folder(fx.media(), FOLDER)


@query(
    "F2_count_recursive",
    "SELECT c.ancestor_id AS folder_id, count(*) AS n FROM fx_media m JOIN fx_closure c ON c.folder_id = m.folder_id GROUP BY 1",
)
def f2(fx):
    return browse.counts_by_subtree(fx.media(), hierarchy.closure(fx.tree_keys()))


@query("F2_count_one_subtree", f"SELECT count(*) AS n FROM fx_media WHERE folder_id IN {IN_SCOPE}")
def f2_one(fx):
    return browse.count_in_subtree(fx.media(), fx.tree_keys(), SCOPE)


@query(
    "F7_ingest_metrics",
    f"""
    , acts AS (SELECT {_ACTION} AS action FROM fx_listing l FULL JOIN fx_media m ON m.absolute_path = l.path)
    SELECT count(*) FILTER (action NOT IN ('absent', 'gone')) AS listed,
           count(*) FILTER (action IN ('new', 'changed')) AS to_process,
           count(*) FILTER (action = 'restored') AS restored, count(*) FILTER (action = 'absent') AS missing,
           count(*) FILTER (action = 'same') AS unchanged
    FROM acts
    """,
)
def f7(fx):
    a = F.col("action")
    return diff.compare(fx.listing(), fx.media()).agg(
        F.count_if(~a.isin("absent", "gone")).alias("listed"), F.count_if(a.isin("new", "changed")).alias("to_process"),
        F.count_if(a == "restored").alias("restored"), F.count_if(a == "absent").alias("missing"),
        F.count_if(a == "same").alias("unchanged"),
    )


@query("F8_distinct_hashes", "SELECT DISTINCT content_hash FROM fx_media")
def f8(fx):
    return browse.distinct_hashes(fx.media())


@query(
    "F10_rows_affected",
    """
    SELECT (SELECT count(*) FROM fx_media WHERE is_present AND absolute_path NOT IN (SELECT path FROM fx_listing)) AS marked_missing,
           (SELECT count(*) FROM fx_media WHERE NOT is_present) AS purged,
           (SELECT count(*) FROM fx_tree WHERE id IN (SELECT folder_id FROM fx_closure WHERE ancestor_id = 1)) AS folders_reset
    """,
)
def f10(fx):
    """Counts observed by the job that writes each change; no counting pass."""
    now, media = timestamp(NOW), fx.media()
    listed = fx.listing().select(F.col("path").alias("absolute_path"))
    marked = changeset.mark_missing(media, listed, F.lit(True), now)
    folders = fx.folders_raw().select("id", "parent_id", "path", "scan_complete")
    scope = hierarchy.subtree(folders, LIBRARY)
    reset = folders.join(scope, "id", "left_semi")
    jobs = {
        "marked_missing": (marked, F.col("missing_since") == now),
        "purged": (media, ~F.col("is_present")),
        "folders_reset": (reset, F.lit(True)),
    }
    seen = {}
    for name, (rows, test) in jobs.items():
        watched, observation = changeset.counted(rows, f"{name}-{uuid.uuid4().hex}", n=test)
        watched.write.format("noop").mode("overwrite").save()
        seen[name] = observation.get["n"]
    return fx.spark.createDataFrame([tuple(seen.values())], ", ".join(f"{name} bigint" for name in seen))


# orderings ----------------------------------------------------------------

_NAME = "lower(regexp_extract(relative_path, '[^/]*$'))"
_SCORE = "CAST(CASE WHEN width % 7 = 0 THEN NULL ELSE width % 5 END AS DOUBLE)"
_SORTS = {
    "filename": _NAME, "size": "file_size", "date_created": "created_at", "date_modified": "modified_at",
    "score": "coalesce(search_score, 0)",
}


def _scored(fx):
    score = F.when(F.col("width") % 7 != 0, (F.col("width") % 5).cast("float"))
    size = F.when(F.col("format").isNotNull(), F.col("file_size"))
    return browse.summaries(fx.media()).withColumn("search_score", score).withColumn("file_size", size)


def _register_sort(key: str, descending: bool):
    way = "DESC NULLS LAST" if descending else "ASC NULLS FIRST"
    sql = f"""
    SELECT id, search_score, file_size, row_number() OVER (ORDER BY {_SORTS[key]} {way}, {_NAME}, id) AS position
    FROM (SELECT id, relative_path, created_at, modified_at, {_SCORE} AS search_score,
                 CASE WHEN format IS NOT NULL THEN file_size END AS file_size FROM fx_media)
    """

    @query(f"G1_sort_{key}_{'desc' if descending else 'asc'}", sql)
    def g1(fx):
        ordered = with_position(browse.sort_media(_scored(fx), key, descending))
        return ordered.select("id", F.col("search_score").cast("double").alias("search_score"), "file_size", "position")


for _key in browse.SORT_KEYS:
    for _descending in (False, True):
        _register_sort(_key, _descending)


@query(
    "G3_page_of_folder",
    f"SELECT {MEDIA_FILE}, row_number() OVER (ORDER BY id) AS position FROM (SELECT * FROM fx_media WHERE folder_id = {FOLDER} AND id > 50 ORDER BY id LIMIT 5)",
)
def g3(fx):
    return with_position(browse.page_of_folder(fx.media(), FOLDER, 50, 5), [F.col("id")])


@query(
    "G4_page_of_subtree",
    f"SELECT {MEDIA_FILE}, row_number() OVER (ORDER BY id) AS position FROM (SELECT * FROM fx_media WHERE folder_id IN {IN_LIBRARY} AND id > 50 ORDER BY id LIMIT 100)",
)
def g4(fx):
    page = browse.page_of_subtree(fx.media(), fx.tree_keys(), LIBRARY, 50, 100)
    return with_position(page, [F.col("id")])


@query("G6_all_folders_by_path", "SELECT id, path, row_number() OVER (ORDER BY path) AS position FROM fx_tree")
def g6(fx):
    return with_position(browse.all_folders(fx.tree_keys()).select("id", "path"), [F.col("path")])


_COUNTED_AFTER = """
, after AS (
  SELECT folder_id FROM fx_media WHERE is_present
  UNION ALL SELECT f.id FROM fx_listing l JOIN fx_tree f ON f.path = regexp_replace(l.path, '/[^/]*$', '') WHERE l.path NOT IN (SELECT absolute_path FROM fx_media))
"""


@query(
    "F2_counts_maintained",
    _COUNTED_AFTER + """
    SELECT folder_id, 'own' AS scope, count(*) AS n FROM after GROUP BY folder_id
    UNION ALL SELECT ancestor_id, 'below', count(*) FROM after JOIN fx_closure USING (folder_id) GROUP BY ancestor_id
    """,
)
def f2_maintained(fx):
    """Counts of all folders after missing media are purged and new files come, from the
    rows that went and came."""
    media, tree = fx.media(), hierarchy.closure(fx.tree_keys())
    own, below = browse.counts_by_folder(media), browse.counts_by_subtree(media, tree)
    purged = media.where(~F.col("is_present"))
    new = fx.listing().join(media.select(F.col("absolute_path").alias("path")), "path", "left_anti")
    placed = diff.assign_folders(new, fx.tree_keys(), F.lit(LIBRARY).cast("bigint"))
    for change in (browse.count_changes(purged, purged.limit(0)), browse.count_changes(placed.limit(0), placed)):
        own, below = browse.counts_after(own, change), browse.counts_after(below, change, tree)
    return own.withColumn("scope", F.lit("own")).unionByName(below.withColumn("scope", F.lit("below")))
