"""Registered queries: the folder tree and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.functions import json_cols, paths, text, times
from shoebox.operators import annotate, hierarchy
from shoebox.operators.skew import with_position
from shoebox.plans.registry import query
from shoebox.schemas import timestamp
from shoebox.sources.fixtures import NOW

_NAME = "regexp_extract(path, '[^/]*$')"


@query("D1_subtree_closure", "SELECT ancestor_id, folder_id, CAST(depth AS INTEGER) AS depth FROM fx_closure")
def d1(fx):
    return hierarchy.closure(fx.tree_keys())


@query("H1_union_all_recursion", "SELECT ancestor_id, folder_id, CAST(depth AS INTEGER) AS depth FROM fx_closure")
def h1(fx):
    return hierarchy.closure_recursive(fx.tree_keys())


@query("D2_root_of_folder", "SELECT folder_id, root_id FROM fx_roots")
def d2(fx):
    return hierarchy.roots(hierarchy.closure(fx.tree_keys()))


@query("D3_hide_unreachable", "SELECT id, path FROM fx_tree JOIN fx_roots ON folder_id = id WHERE root_id IN (SELECT id FROM fx_tree WHERE parent_id IS NULL AND path <> '/gone')")
def d3(fx):
    folders = fx.tree_keys()
    reachable = folders.where(F.col("parent_id").isNull() & (F.col("path") != "/gone")).select(F.col("id").alias("root_id"))
    return hierarchy.hide_unreachable(folders, hierarchy.closure(folders), reachable).select("id", "path")


@query(
    "D4_name_filter",
    f"""
    SELECT id, path FROM fx_tree WHERE id IN (
      SELECT ancestor_id FROM fx_closure c JOIN fx_tree f ON f.id = c.folder_id WHERE contains(lower({_NAME}), lower('R#00000001')))
    """,
)
def d4(fx):
    folders = fx.tree_keys()
    return hierarchy.name_filter(folders, hierarchy.closure(folders), "R#00000001").select("id", "path")


_TREE_SQL = """
, walk AS (
  SELECT id, path, 0 AS depth, [concat(lower(regexp_extract(path, '[^/]*$')), chr(1), path)] AS sort_key, path AS root FROM fx_tree WHERE parent_id IS NULL
  UNION ALL
  SELECT f.id, f.path, w.depth + 1, list_append(w.sort_key, concat(lower(regexp_extract(f.path, '[^/]*$')), chr(1), f.path)), w.root
  FROM walk w JOIN fx_tree f ON f.parent_id = w.id
)
"""


@query(
    "D5_folder_tree_listing",
    _TREE_SQL + "SELECT id, path, CAST(depth AS INTEGER) AS depth, row_number() OVER (ORDER BY sort_key) AS position FROM walk",
)
def d5(fx):
    folders = fx.tree_keys()
    ordered = hierarchy.tree_order(folders, hierarchy.closure(folders)).select("id", "path", "depth", "sort_key")
    return with_position(ordered, [F.col("sort_key")]).drop("sort_key")


@query(
    "D5_folder_tree_flattened",
    _TREE_SQL + "SELECT id, path, CAST(depth AS INTEGER) AS depth FROM walk WHERE depth = 0 OR root NOT IN (SELECT path FROM fx_tree WHERE path = '/lib')",
)
def d5_flat(fx):
    folders = fx.tree_keys()
    flat = folders.where(F.col("path") == "/lib").select("path")
    return hierarchy.tree_order(folders, hierarchy.closure(folders), flat).select("id", "path", "depth")


@query(
    "D6_inherit_settings",
    """
    SELECT x.folder_id, x.root_id, r.path AS root_path, coalesce(r.thumbnail_cache_mode, 'global') AS cache_mode,
           coalesce(r.thumbnail_cache_folder, '') AS cache_folder, r.thumbnail_cache_fallback AS cache_fallback
    FROM fx_roots x JOIN fx_folders r ON r.id = x.root_id
    """,
)
def d6(fx):
    folders = fx.folders_raw()
    return hierarchy.inherited_settings(folders)


_DERIVED = """
, dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM {source}),
steps AS (
  SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS path
  FROM (SELECT path, UNNEST(range(2, len(string_split(path, '/')) + 1)) AS i FROM dirs)
)
SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent_path, FALSE AS recursive, {complete} AS scan_complete
FROM steps WHERE path NOT IN (SELECT path FROM fx_tree WHERE segment IS NULL)
"""


def _derive(fx, listing, complete):
    """Customer folders are unknown here, so they must be derived."""
    known = fx.tree().where(F.col("segment").isNull()).select("id", "parent_id", "path")
    dirs = hierarchy.directories_of(listing, "/lib")
    new = hierarchy.derive_folders(dirs, known, timestamp(NOW), scan_complete=complete)
    every = known.select("id", F.col("path").alias("parent_path")).unionByName(
        new.select("id", F.col("path").alias("parent_path"))
    )
    return new.join(every.withColumnRenamed("id", "parent_id"), "parent_id").select("path", "parent_path", "recursive", "scan_complete")


@query("D7_derive_folders", _DERIVED.format(source="fx_listing", complete="FALSE"))
def d7(fx):
    return _derive(fx, fx.listing(), False)


@query("D8_derive_parents_of_changes", _DERIVED.format(source="fx_events", complete="TRUE"))
def d8(fx):
    return _derive(fx, fx.events().select("path", F.lit(False).alias("is_dir")), True)


@query(
    "D9_mark_subtree_state",
    "SELECT id, path, CASE WHEN id IN (SELECT folder_id FROM fx_closure WHERE ancestor_id = 12) THEN FALSE ELSE scan_complete END AS scan_complete FROM fx_folders",
)
def d9(fx):
    folders = fx.folders_raw().select("id", "parent_id", "path", "scan_complete")
    scope = hierarchy.subtree(folders, 12)
    return hierarchy.set_scan_state(folders, scope, False).select("id", "path", "scan_complete")


@query(
    "D10_mark_listed_complete",
    """
    , dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM fx_listing),
    steps AS (
      SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS path
      FROM (SELECT path, UNNEST(range(2, len(string_split(path, '/')) + 1)) AS i FROM dirs)
    )
    SELECT id, path, scan_complete OR path IN (SELECT path FROM steps) OR path = '/lib' AS scan_complete FROM fx_folders
    """,
)
def d10(fx):
    folders = fx.folders_raw().select("id", "parent_id", "path", "scan_complete")
    return hierarchy.complete_directories(folders, fx.listing(), "/lib").select("id", "path", "scan_complete")


# scalar functions ---------------------------------------------------------


@query("J1_lower", "SELECT id, lower(relative_path) AS lowered FROM fx_media")
def j1(fx):
    return fx.media().select("id", F.lower("relative_path").alias("lowered"))


@query(
    "J2_split_whitespace",
    r"""
    SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, chr(10))) AS tokens_md5 FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(text,
        '[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS t
      FROM (SELECT doc_id, lower(text) AS text FROM documents))
    """,
)
def j2(fx):
    found = text.tokens(F.col("text"))
    return fx.table("documents").select("doc_id", found.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", "\n").cast("binary")).alias("tokens_md5")
    )


@query(
    "J3_trim_contains_equals",
    "SELECT doc_id, length(trim(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')) AS trimmed_chars, contains(lower(text), 'license') AS has_word, text = trim(text) AS same FROM documents",
)
def j3(fx):
    body = F.col("text")
    return fx.table("documents").select(
        "doc_id", F.length(text.trimmed(body)).cast("bigint").alias("trimmed_chars"),
        F.contains(F.lower(body), F.lit("license")).alias("has_word"), (body == F.trim(body)).alias("same"),
    )


@query(
    "J4_prefix_concat",
    "SELECT id, starts_with(path, '/lib/ASIA/') AS below, concat(path, '/x') AS joined FROM fx_tree",
)
def j4(fx):
    return fx.tree_keys().select(
        "id", F.startswith(F.col("path"), F.concat(F.lit("/lib/ASIA"), F.lit("/"))).alias("below"),
        F.concat("path", F.lit("/x")).alias("joined"),
    )


@query("J5_json_elements_to_int", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS first_id, event_id AS second_id FROM events""")
def j5(fx):
    listed = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), F.col("event_id").cast("string"), F.lit("]"))
    ids = json_cols.id_list(listed)
    return fx.table("events").select("event_id", F.get(ids, 0).alias("first_id"), F.get(ids, 1).alias("second_id"))


@query("J6_fixed_now", f"SELECT id, CASE WHEN is_present THEN TIMESTAMP '{NOW}' ELSE missing_since END AS stamped FROM fx_media")
def j6(fx):
    return fx.media().select("id", F.when(F.col("is_present"), timestamp(NOW)).otherwise(F.col("missing_since")).alias("stamped"))


@query(
    "J7_path_parts",
    """
    SELECT path, substr(path, 6) AS relative, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name,
           lower(regexp_extract(path, '[^/]+\\.([^./]*)$', 1)) AS extension, path = '/lib/ASIA' OR starts_with(path, '/lib/ASIA/') AS under
    FROM fx_listing
    """,
)
def j7(fx):
    return fx.listing().select(
        "path", paths.relative_to("path", F.lit("/lib")).alias("relative"), paths.parent_dir("path").alias("parent"),
        paths.file_name("path").alias("name"), paths.extension("path").alias("extension"),
        paths.is_under("path", F.lit("/lib/ASIA")).alias("under"),
    )


_ODD = """
SELECT event_id, CASE event_type WHEN 'click' THEN concat('{"model_name":"m', user_id, '"}') WHEN 'view' THEN 'not json'
  WHEN 'error' THEN NULL WHEN 'signup' THEN concat('{"model_name":', user_id, '}') ELSE props END AS params,
  CASE event_type WHEN 'click' THEN concat('m', user_id) ELSE 'unknown' END AS model FROM events
"""


@query("J8_json_field_default", f"SELECT event_id, model FROM ({_ODD})")
def j8(fx):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    params = (
        F.when(kind == "click", F.concat(F.lit('{"model_name":"m'), user, F.lit('"}'))).when(kind == "view", "not json")
        .when(kind == "signup", F.concat(F.lit('{"model_name":'), user, F.lit("}"))).when(kind != "error", F.col("props"))
    )
    return fx.table("events").select("event_id", annotate.model_name(params).alias("model"))


@query("J9_json_build", """SELECT DISTINCT event_type, concat('{"model_name":"', event_type, '"}') AS params FROM events""")
def j9(fx):
    return fx.table("events").select("event_type", annotate.model_params(F.col("event_type")).alias("params")).distinct()


@query("J10_whole_seconds", "SELECT event_id, date_trunc('second', CAST(ts AS TIMESTAMP)) AS mtime FROM events")
def j10(fx):
    return fx.table("events").select("event_id", times.whole_seconds(F.col("ts")).alias("mtime"))


@query(
    "J11_parse_kind",
    """
    , kinds AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN concat('vector:', o_custkey) WHEN '2-HIGH' THEN 'tags'
                  WHEN '3-MEDIUM' THEN 'classification' WHEN '5-LOW' THEN 'text' ELSE concat('vector:x', o_custkey) END AS raw, o_orderpriority, o_custkey FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'vector' WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN raw END AS kind,
           CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS dims FROM kinds
    """,
)
def j11(fx):
    p, n = F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    raw = (
        F.when(p == "1-URGENT", F.concat(F.lit("vector:"), n)).when(p == "2-HIGH", "tags").when(p == "3-MEDIUM", "classification")
        .when(p == "5-LOW", "text").otherwise(F.concat(F.lit("vector:x"), n))
    )
    return fx.table("orders").select("o_orderkey", text.parse_kind(raw).alias("k")).select("o_orderkey", "k.kind", "k.dims")


@query("H1_climbed", "SELECT folder_id, arg_max(ancestor_id, depth) AS root_id, max(depth) AS depth FROM fx_closure GROUP BY folder_id")
def h1_climbed(fx):
    """Roots and depths by doubling pointers."""
    return hierarchy.climbed(fx.tree_keys())


_TREE_AFTER = """
, after AS (
  SELECT t.id, CASE WHEN t.id >= 1000 AND t.id % 5 = 1 THEN n.parent_id ELSE t.parent_id END AS parent_id
  FROM fx_tree t LEFT JOIN fx_tree n ON n.id = t.parent_id WHERE NOT (t.id >= 1000 AND t.id % 7 = 0)
  UNION ALL SELECT 50000000 + id, id FROM fx_tree WHERE parent_id = 1),
climb AS (
  SELECT id AS ancestor_id, id AS folder_id, 0 AS depth FROM after
  UNION ALL
  SELECT f.parent_id, c.folder_id, c.depth + 1 FROM climb c JOIN after f ON f.id = c.ancestor_id WHERE f.parent_id IS NOT NULL)
"""


@query("D1_closure_maintained", _TREE_AFTER + "SELECT ancestor_id, folder_id, CAST(depth AS INTEGER) AS depth FROM climb")
def d1_maintained(fx):
    """A closure after folders went, moved up one level, and came."""
    tree = fx.tree_keys()
    customer = F.col("id") >= 1000
    gone, moves = customer & (F.col("id") % 7 == 0), customer & (F.col("id") % 5 == 1) & (F.col("id") % 7 != 0)
    above = tree.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("_up"))
    top = F.regexp_replace("path", "/[^/]+/([^/]+)$", "/$1")
    moved = tree.where(moves).join(above, "parent_id").select("id", F.col("_up").alias("parent_id"), top.alias("path"))
    made = tree.where("parent_id = 1").select((F.col("id") + 50000000).alias("id"), F.col("id").alias("parent_id"), F.concat("path", F.lit("/NEW")).alias("path"))
    new = moved.unionByName(made)
    now = tree.where(~gone & ~moves).unionByName(new)
    return hierarchy.closure_after(hierarchy.closure(tree), now, tree.where(gone | moves), new)
