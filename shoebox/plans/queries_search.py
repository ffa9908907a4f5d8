"""Registered queries: search and thumbnails."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoebox.functions import text, thumbs
from shoebox.operators import browse, hierarchy, pathindex, search, thumbnails
from shoebox.operators.skew import with_position
from shoebox.plans.ingest import stored
from shoebox.plans.queries_browse import FOLDER, IN_LIBRARY, IN_SCOPE, LIBRARY, SCOPE, SUMMARY
from shoebox.plans.registry import query
from shoebox.sources.fixtures import GLOBAL_CACHE

QUERY = "  Customer .PNG _1 "
_LOW = "lower(relative_path)"
_SCORE = (
    f"(CASE WHEN contains({_LOW}, 'customer') THEN 1.0 ELSE 0.0 END + CASE WHEN contains({_LOW}, '.png') THEN 1.0 ELSE 0.0 END"
    f" + CASE WHEN contains({_LOW}, '_1') THEN 1.0 ELSE 0.0 END)::DOUBLE"
)
_FILENAME = f"(SELECT id AS media_id, {_SCORE} AS score FROM fx_media WHERE {_SCORE} > 0)"
_LABELS = "(SELECT media_file_id AS media_id, 2.5::DOUBLE AS score FROM fx_values WHERE value_json = '{\"label\":1}')"
_BAG = f"(SELECT * FROM {_FILENAME} UNION ALL SELECT * FROM {_LABELS})"
_TOTAL = f"(SELECT media_id, sum(score) AS score FROM {_BAG} GROUP BY media_id)"
_RANK = "row_number() OVER (ORDER BY score DESC, relative_path, id) AS position"


def _as_double(rows, column="score"):
    return rows.withColumn(column, F.col(column).cast("double"))


def _labels(fx):
    """A scorer that gives a fixed amount to media with a good label."""

    def found(media, text_query):
        good = fx.values().where(F.col("value_json") == '{"label":1}')
        return good.select(F.col("media_file_id").alias("media_id"), F.lit(2.5).cast("float").alias("score"))

    return search.FrameScorer("labels", "classification", found)


@query("K1_filename_scorer", f"SELECT media_id, score FROM {_FILENAME}")
def k1(fx):
    return _as_double(search.contributions(fx.media(), [search.FILENAME], QUERY))


@query("H2_union_of_contributions", f"SELECT media_id, score FROM {_BAG}")
def h2(fx):
    return _as_double(search.contributions(fx.media(), [search.FILENAME, _labels(fx)], QUERY))


@query("F3_sum_of_scores", f"SELECT media_id, score FROM {_TOTAL}")
def f3(fx):
    return _as_double(search.total_scores(search.contributions(fx.media(), [search.FILENAME, _labels(fx)], QUERY)))


@query("E7_scores_join_summaries", f"SELECT {SUMMARY}, score FROM fx_media JOIN {_TOTAL} ON media_id = id")
def e7(fx):
    return _as_double(search.score_media(fx.media(), [search.FILENAME, _labels(fx)], QUERY)).select(*browse.SUMMARY_COLUMNS, "score")


@query("G2_search_rank", f"SELECT id, relative_path, score, {_RANK} FROM fx_media JOIN {_TOTAL} ON media_id = id")
def g2(fx):
    hits = search.score_media(fx.media(), [search.FILENAME, _labels(fx)], QUERY).select("id", "relative_path", "score")
    return _as_double(with_position(hits, browse.rank_order()))


@query("K2_multi_scorer_search", f"SELECT {SUMMARY}, score FROM fx_media JOIN {_TOTAL} ON media_id = id WHERE folder_id IN {IN_LIBRARY}")
def k2(fx):
    registry = search.Registry.with_defaults()
    registry.register(_labels(fx))
    scorers = search.active_scorers(registry, ["filename", "labels", "other"], ["labels", "filename"])
    return _as_double(search.search(fx.media(), fx.tree_keys(), LIBRARY, True, QUERY, scorers))


@query(
    "K3_scoped_search",
    f"""
    SELECT 'recursive' AS scope, id, score FROM fx_media JOIN {_FILENAME} ON media_id = id WHERE folder_id IN {IN_SCOPE}
    UNION ALL SELECT 'direct', id, score FROM fx_media JOIN {_FILENAME} ON media_id = id WHERE folder_id = {FOLDER}
    """,
)
def k3(fx):
    media, tree = fx.media(), fx.tree_keys()
    below = search.search(media, tree, SCOPE, True, QUERY, [search.FILENAME], ranked=False)
    here = search.search(media, tree, FOLDER, False, QUERY, [search.FILENAME], ranked=False)
    parts = [rows.select(F.lit(name).alias("scope"), "id", "score") for name, rows in (("recursive", below), ("direct", here))]
    return _as_double(parts[0].unionByName(parts[1]))


INDEXED_QUERY = " CUSTOMER#0000 asia/ moved/  .PNG"
_MOVED = "CASE WHEN id % 5 = 0 THEN concat('moved/', relative_path) ELSE relative_path END"
_INDEXED = """
, moved AS (SELECT id, folder_id, {moved} AS relative_path FROM fx_media WHERE id % 7 <> 0),
scored AS (
  SELECT id AS media_id, folder_id,
         ((contains(lower(relative_path), 'customer#0000'))::INT + (contains(lower(relative_path), 'asia/'))::INT
          + (contains(lower(relative_path), 'moved/'))::INT + (contains(lower(relative_path), '.png'))::INT)::DOUBLE AS score
  FROM moved)
""".format(moved=_MOVED)


def _indexed(fx):
    """Media after some files went and some moved, and an index that was told of these alone."""
    media = fx.media()
    now = media.where("id % 7 <> 0").withColumn("relative_path", F.expr(_MOVED))
    index = stored(pathindex.laid_out(pathindex.postings(media)), "path-index")
    changed = F.expr("id % 7 = 0 OR id % 5 = 0")
    told = stored(pathindex.laid_out(pathindex.changes(media.where(changed), now.where(changed))), "path-index-changes")
    return now, index.unionByName(told)


@query("K1_path_index", _INDEXED + "SELECT media_id, score FROM scored WHERE score > 0")
def k1_index(fx):
    """The file-name scorer from the postings of its runs, kept current by a change set."""
    return _as_double(pathindex.found(_indexed(fx)[1], INDEXED_QUERY))


@query("K3_path_index", _INDEXED + f"SELECT media_id AS id, score FROM scored WHERE score > 0 AND folder_id IN {IN_SCOPE}")
def k3_index(fx):
    """A recursive search whose file-name scorer reads the index."""
    now, index = _indexed(fx)
    hits = search.search(now, fx.tree_keys(), SCOPE, True, INDEXED_QUERY, [pathindex.scorer(index)], ranked=False)
    return _as_double(hits.select("id", "score"))


_BY_SCORE = "row_number() OVER (ORDER BY score DESC, lower(regexp_extract(relative_path, '[^/]*$')), id) AS position"


@query("K4_summaries_by_score", f"SELECT id, score AS search_score, {_BY_SCORE} FROM fx_media JOIN {_FILENAME} ON media_id = id WHERE folder_id IN {IN_LIBRARY}")
def k4(fx):
    hits = search.search(fx.media(), fx.tree_keys(), LIBRARY, True, QUERY, [search.FILENAME], ranked=False)
    rows = search.as_summaries(hits, sort=False).select("id", "relative_path", "search_score")
    ordered = with_position(rows, browse.browse_order("score", descending=True))
    return _as_double(ordered, "search_score").select("id", "search_score", "position")


@query("M2_custom_scorers", "SELECT media_id, sum(score) AS score FROM (SELECT id AS media_id, 1.0::DOUBLE AS score FROM fx_media UNION ALL SELECT id, 1.0 FROM fx_media WHERE is_present) GROUP BY media_id")
def m2(fx):
    """Two constant scorers, one of each form."""
    registry = search.Registry()
    registry.register(search.RowScorer("alpha", "text", lambda q: F.lit(1.0).cast("float")))
    registry.register(
        search.FrameScorer("beta", "text", lambda m, q: m.where("is_present").select(F.col("id").alias("media_id"), F.lit(1.0).alias("score")))
    )
    scorers = search.active_scorers(registry, ["alpha", "beta"], ["alpha", "beta"])
    return _as_double(search.total_scores(search.contributions(fx.media(), scorers, "x")))


@query(
    "E6_active_scorers",
    "SELECT name, row_number() OVER (ORDER BY name) AS position FROM fx_configs WHERE enabled AND name IN (SELECT concat('scorer-', source) FROM documents)",
)
def e6(fx):
    """Which requested scorers are enabled, by name."""
    wanted = fx.table("documents").select(F.concat(F.lit("scorer-"), "source").alias("name"))
    return with_position(search.active_configs(fx.configs(), wanted).select("name"), [F.col("name")])


# thumbnails ---------------------------------------------------------------

SIDE = 512


@query(
    "N1_thumbnail_size",
    """
    SELECT id, CAST(CASE WHEN width > height THEN 512 ELSE greatest(1, CAST(width AS BIGINT) * 512 // height) END AS INTEGER) AS width,
           CAST(CASE WHEN width > height THEN greatest(1, CAST(height AS BIGINT) * 512 // width) ELSE 512 END AS INTEGER) AS height FROM fx_media
    """,
)
def n1(fx):
    return fx.media().select("id", thumbs.scaled_size(F.col("width"), F.col("height"), SIDE).alias("s")).select("id", "s.width", "s.height")


_KEY = "concat(substr(content_hash, 1, 2), '/', substr(content_hash, 3, 2), '/', content_hash, '_512.webp')"


@query("N2_sharded_key", f"SELECT id, {_KEY} AS cache_key FROM fx_media")
def n2(fx):
    return fx.media().select("id", thumbs.sharded_key(F.col("content_hash"), SIDE).alias("cache_key"))


def _policy(fx):
    """Media with a policy that varies by customer segment."""
    segment = F.col("segment")
    mode = F.when(segment == "BUILDING", "custom").when(segment == "FURNITURE", "disabled").when(segment == "MACHINERY", "global").when(segment == "HOUSEHOLD", "odd")
    folder = F.when(F.length("path") % 2 == 0, F.lit("/cache/own"))
    return fx.tree().where(segment.isNotNull()).select(
        "id", "path", mode.alias("mode"), folder.alias("folder"), F.md5(F.col("path").cast("binary")).alias("content_hash"),
        F.when(F.col("id") % 2 == 0, "global").when(F.col("id") % 3 == 0, "disable").alias("fallback"), (F.col("id") % 5 != 0).alias("writable"),
    )


_POLICY = f"""
, policy AS (
  SELECT id, path, CASE segment WHEN 'BUILDING' THEN 'custom' WHEN 'FURNITURE' THEN 'disabled' WHEN 'MACHINERY' THEN 'global' WHEN 'HOUSEHOLD' THEN 'odd' END AS mode,
         CASE WHEN length(path) % 2 = 0 THEN '/cache/own' END AS folder, md5(path) AS content_hash,
         CASE WHEN id % 2 = 0 THEN 'global' WHEN id % 3 = 0 THEN 'disable' END AS fallback, id % 5 <> 0 AS writable
  FROM fx_tree WHERE segment IS NOT NULL
)
"""


@query(
    "N3_read_locations",
    _POLICY
    + f"""
    SELECT id, CAST(1 AS INTEGER) AS priority, coalesce(folder, concat(path, '/.thumbnails')) AS base FROM policy WHERE mode <> 'global'
    UNION ALL SELECT id, CAST(CASE WHEN mode <> 'global' THEN 2 ELSE 1 END AS INTEGER), '{GLOBAL_CACHE}' FROM policy
    """,
)
def n3(fx):
    bases = thumbs.read_bases(F.col("mode"), F.col("folder"), F.col("path"), GLOBAL_CACHE)
    return _policy(fx).select("id", F.posexplode(bases).alias("p", "base")).select("id", (F.col("p") + 1).alias("priority"), "base")


@query(
    "N4_write_location",
    _POLICY
    + f"""
    SELECT id, CASE WHEN mode = 'disabled' THEN NULL
                    WHEN mode = 'custom' AND writable THEN concat(coalesce(folder, concat(path, '/.thumbnails')), '/', {_KEY})
                    WHEN mode = 'custom' AND coalesce(fallback, 'disable') <> 'global' THEN NULL
                    ELSE concat('{GLOBAL_CACHE}/', {_KEY}) END AS target,
           concat('/tmp/.thumbnails/', {_KEY}) AS temporary_target, CAST(NULL AS VARCHAR) AS disabled_target
    FROM policy
    """,
)
def n4(fx):
    given = [F.col(c) for c in ("mode", "folder", "path", "fallback", "writable", "content_hash")]
    return _policy(fx).select(
        "id", thumbs.write_path(*given, SIDE, GLOBAL_CACHE).alias("target"),
        thumbs.write_path(*given, SIDE, GLOBAL_CACHE, disable_cache=True, temporary_cache=True).alias("temporary_target"),
        thumbs.write_path(*given, SIDE, GLOBAL_CACHE, disable_cache=True).alias("disabled_target"),
    )


_REPS = f"(SELECT content_hash, min(id) AS id FROM fx_media WHERE is_present GROUP BY content_hash)"


@query(
    "N5_render_list",
    f"""
    , settings AS (SELECT x.folder_id, r.path AS root_path FROM fx_roots x JOIN fx_tree r ON r.id = x.root_id)
    SELECT m.content_hash, m.id, m.absolute_path, s.root_path,
           CAST(CASE WHEN width > height THEN 512 ELSE greatest(1, CAST(width AS BIGINT) * 512 // height) END AS INTEGER) AS thumb_width,
           CAST(CASE WHEN width > height THEN greatest(1, CAST(height AS BIGINT) * 512 // width) ELSE 512 END AS INTEGER) AS thumb_height
    FROM fx_media m JOIN {_REPS} r ON r.id = m.id JOIN settings s ON s.folder_id = m.folder_id
    WHERE concat('{GLOBAL_CACHE}/', {_KEY.replace("content_hash", "m.content_hash")}) NOT IN (SELECT path FROM fx_cached)
      AND concat(s.root_path, '/.thumbnails/', {_KEY.replace("content_hash", "m.content_hash")}) NOT IN (SELECT path FROM fx_cached)
    """,
)
def n5(fx):
    folders = fx.folders_raw()
    settings = hierarchy.inherited_settings(folders)
    todo = thumbnails.render_list(fx.media(), settings, fx.cached(SIDE), SIDE, GLOBAL_CACHE)
    return todo.select("content_hash", "id", "absolute_path", "root_path", "thumb_width", "thumb_height")


@query(
    "N5_cache_hits",
    f"""
    , settings AS (SELECT x.folder_id, r.path AS root_path FROM fx_roots x JOIN fx_tree r ON r.id = x.root_id),
    asked AS (
      SELECT m.content_hash, concat(s.root_path, '/.thumbnails/', {_KEY.replace("content_hash", "m.content_hash")}) AS own,
             concat('{GLOBAL_CACHE}/', {_KEY.replace("content_hash", "m.content_hash")}) AS shared
      FROM fx_media m JOIN {_REPS} r ON r.id = m.id JOIN settings s ON s.folder_id = m.folder_id)
    SELECT content_hash, CASE WHEN own IN (SELECT path FROM fx_cached) THEN own WHEN shared IN (SELECT path FROM fx_cached) THEN shared END AS cached_at FROM asked
    """,
)
def n5_hits(fx):
    folders = fx.folders_raw()
    settings = hierarchy.inherited_settings(folders)
    rows = thumbnails.with_settings(thumbnails.representatives(fx.media()), settings)
    return thumbnails.cache_lookup(rows, fx.cached(SIDE), SIDE, GLOBAL_CACHE).select("content_hash", "cached_at")
