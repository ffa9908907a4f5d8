"""Catalogue-shaped views over the test tables.

Orders stand for files and customers for the folders that hold them; nations and
regions are the levels above.  ``FIXTURE_SQL`` states the same views as common
table expressions for the SQL check.  No view drops rows except by a condition
on the data that gives it its meaning (a later listing lacks some files).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.functions.json_cols import string_list
from shoebox.schemas import timestamp
from shoebox.session import checkpoint_root

EXTENSIONS = [".jpg", ".JPEG", ".png", ".webp", ".gif", ".bmp", ".tiff", ".avif", ".txt", ""]
MISSING_SINCE = "2024-01-01 00:00:00"
NOW = "2024-07-01 00:00:00"
GLOBAL_CACHE = "/cache/global"


# The folder table is written once per application and data folder, as a
# catalogue would hold it; everything else is derived on the fly.
_WRITTEN_TREES: dict[tuple[str, str], str] = {}


class Fixtures:
    """The views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def tree(self) -> DataFrame:
        """``(id, parent_id, path, segment)``; only customer folders have a segment."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _WRITTEN_TREES:
            path = f"{checkpoint_root(self.spark)}/fixture-tree-{uuid.uuid4().hex}"
            self._derive_tree().write.parquet(path)
            _WRITTEN_TREES[key] = path
        schema = "id bigint, parent_id bigint, path string, segment string"
        return self.spark.read.schema(schema).parquet(_WRITTEN_TREES[key])

    def _derive_tree(self) -> DataFrame:
        region, nation, customer = self.table("region"), self.table("nation"), self.table("customer")
        top = self.spark.createDataFrame([(1, None, "/lib"), (2, None, "/gone")], "id bigint, parent_id bigint, path string")
        r = region.select(
            (F.col("r_regionkey") + 10).cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("parent_id"),
            F.concat(F.lit("/lib/"), "r_name").alias("path"),
        )
        named = nation.join(region, nation.n_regionkey == region.r_regionkey)
        npath = F.concat(F.lit("/lib/"), "r_name", F.lit("/"), "n_name")
        n = named.select(
            (F.col("n_nationkey") + 100).cast("bigint").alias("id"), (F.col("n_regionkey") + 10).cast("bigint").alias("parent_id"),
            npath.alias("path"),
        )
        c = customer.join(named, customer.c_nationkey == named.n_nationkey).select(
            (F.col("c_custkey") + 1000).cast("bigint").alias("id"), (F.col("c_nationkey") + 100).cast("bigint").alias("parent_id"),
            F.concat(npath, F.lit("/"), "c_name").alias("path"), F.col("c_mktsegment").alias("segment"),
        )
        blank = F.lit(None).cast("string")
        tree = c
        for level in (top, r, n):
            tree = tree.unionByName(level.withColumn("segment", blank))
        return tree

    def folders_raw(self) -> DataFrame:
        """Folders with their pattern lists as JSON text, some of it broken."""
        root = F.col("parent_id").isNull()
        return self.tree().select(
            "id", "parent_id", "path",
            root.alias("recursive"), (F.col("id") % 3 == 0).alias("scan_complete"),
            F.when(F.col("segment") == "BUILDING", '["private","/lib/x"]').when(F.col("segment") == "FURNITURE", "not json")
            .when(F.col("segment") == "MACHINERY", '["a",1]').otherwise("[]").alias("exclude"),
            F.when(F.col("segment") == "HOUSEHOLD", '["Customer"]').when(F.col("segment") == "AUTOMOBILE", '{"a":1}').otherwise("[]").alias("include"),
            F.when(F.col("id") == 1, "custom").alias("thumbnail_cache_mode"),
            F.when(F.col("id") == 1, "").alias("thumbnail_cache_folder"),
            F.when(F.col("id") == 1, "global").otherwise("disable").alias("thumbnail_cache_fallback"),
            timestamp("2024-01-01 00:00:00").alias("created_at"),
        )

    def folders(self) -> DataFrame:
        raw = self.folders_raw()
        return raw.withColumn("exclude", string_list(F.col("exclude"))).withColumn("include", string_list(F.col("include")))

    def tree_keys(self) -> DataFrame:
        """Folders without their settings: ``(id, parent_id, path)``."""
        return self.tree().select("id", "parent_id", "path")

    def _files(self) -> DataFrame:
        """Media rows with the order they stand for: orders meet folders once."""
        orders, f = self.table("orders"), self.tree_keys().select(F.col("id").alias("folder_id"), "path")
        key = F.col("o_orderkey")
        ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (key % 10 + 1).cast("int"))
        joined = orders.withColumn("folder_id", F.col("o_custkey") + 1000).join(f, "folder_id").withColumn("ext", ext)
        leaf = F.concat(F.lit("/img_"), key.cast("string"), "ext")
        present = F.col("o_orderstatus") != "F"
        return joined.select(
            (key + 1).alias("id"), "folder_id",
            F.concat(F.substr("path", F.lit(6)), leaf).alias("relative_path"), F.concat("path", leaf).alias("absolute_path"),
            F.md5((key % 1000).cast("string").cast("binary")).alias("content_hash"),
            (1 + key % 4000).cast("int").alias("width"), (1 + key % 3000).cast("int").alias("height"),
            F.when(key % 11 != 0, F.substr("ext", F.lit(2))).alias("format"),
            F.floor("o_totalprice").cast("bigint").alias("file_size"),
            F.col("o_orderdate").alias("modified_at"),
            (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
            present.alias("is_present"), F.when(~present, timestamp(MISSING_SINCE)).alias("missing_since"),
            "o_orderstatus", "o_orderpriority",
        )

    def media(self) -> DataFrame:
        return self._files().drop("o_orderstatus", "o_orderpriority")

    def listing(self) -> DataFrame:
        """A later listing: urgent open orders' files are gone, high-priority ones
        changed size, and every customer folder gained a file."""
        kept = self._files().where(~((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")))
        size = F.when(F.col("o_orderpriority") == "2-HIGH", F.col("file_size") + 1).otherwise(F.col("file_size"))
        old = kept.select(F.col("absolute_path").alias("path"), F.lit(False).alias("is_dir"), size.alias("size"), F.col("modified_at").alias("mtime"))
        new = self.tree().where(F.col("segment").isNotNull()).select(
            F.concat("path", F.lit("/new_"), F.col("id").cast("string"), F.lit(".png")).alias("path"), F.lit(False).alias("is_dir"),
            F.col("id").alias("size"), timestamp("2024-06-01 00:00:00").alias("mtime"),
        )
        return old.unionByName(new)

    def events(self) -> DataFrame:
        m = self.media().select((F.col("id") - 1).alias("user_id"), F.col("absolute_path").alias("path"))
        kind = F.col("event_type")
        return self.table("events").join(m, "user_id").select(
            "event_id", "ts", "path",
            F.when(kind == "signup", "create").when(kind == "click", "modify").when(kind == "error", "remove")
            .when(kind == "view", "access").otherwise("other").alias("event_kind"),
            (F.col("value") >= 20).alias("path_exists"), (F.col("event_id") % 29 == 0).alias("is_dir"),
        )

    def work_items(self) -> DataFrame:
        key = F.col("o_orderkey")
        n = (key % 4).cast("int")
        s = (key % 5).cast("int")
        return self.table("orders").select(
            (key + 1).alias("id"), (key + 1).alias("media_file_id"), F.lit(None).cast("bigint").alias("searchable_config_id"),
            F.when(n == 0, "tagger").when(n == 1, "classifier").when(n == 2, "visionlanguage").otherwise("mystery").alias("job_kind"),
            F.concat(F.lit('{"model_name":"m'), (key % 3).cast("string"), F.lit('"}')).alias("params_json"),
            F.when(s == 0, "running").when(s == 1, "done").when(s == 2, "failed").otherwise("pending").alias("status"),
            F.lit(0).cast("bigint").alias("attempts"), F.lit(None).cast("string").alias("error"),
            F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        )

    def values(self) -> DataFrame:
        doc = F.col("doc_id")
        stamp = timestamp("2024-01-01 00:00:00")
        return self.table("labels").select(
            (doc + 1).alias("id"), (doc + 1).alias("media_file_id"), F.lit(1).cast("bigint").alias("searchable_config_id"),
            F.concat(F.lit('{"label":'), F.col("quality").cast("string"), F.lit("}")).alias("value_json"),
            stamp.alias("created_at"), stamp.alias("updated_at"),
        )

    def configs(self) -> DataFrame:
        """One scorer configuration per document source; some are switched off."""
        source = F.col("source")
        return self.table("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
            F.xxhash64("source").alias("id"), F.concat(F.lit("scorer-"), source).alias("name"), F.lit("text").alias("kind"),
            (~F.endswith(source, F.lit("3"))).alias("enabled"), F.lit("{}").alias("options"),
            timestamp("2024-01-01 00:00:00").alias("created_at"),
        )

    def cached(self, side: int = 512) -> DataFrame:
        """Existing thumbnails: png files in the import's own folder and, with webp
        files, in the global one."""
        h = F.col("content_hash")
        key = F.concat(F.substr(h, F.lit(1), F.lit(2)), F.lit("/"), F.substr(h, F.lit(3), F.lit(2)), F.lit("/"), h, F.lit(f"_{side}.webp"))
        media = self.media()
        png, webp = F.endswith(F.col("absolute_path"), F.lit(".png")), F.endswith(F.col("absolute_path"), F.lit(".webp"))
        own = media.where(png).select(F.concat(F.lit("/lib/.thumbnails/"), key).alias("path"))
        shared = media.where(png | webp).select(F.concat(F.lit(f"{GLOBAL_CACHE}/"), key).alias("path"))
        return own.unionByName(shared).distinct()


FIXTURE_SQL = """
fx_tree AS (
  SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, '/lib' AS path, CAST(NULL AS VARCHAR) AS segment
  UNION ALL SELECT CAST(2 AS BIGINT), CAST(NULL AS BIGINT), '/gone', NULL
  UNION ALL SELECT CAST(10 + r_regionkey AS BIGINT), CAST(1 AS BIGINT), concat('/lib/', r_name), NULL FROM region
  UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(10 + n_regionkey AS BIGINT), concat('/lib/', r_name, '/', n_name), NULL
    FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT CAST(1000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), concat('/lib/', r_name, '/', n_name, '/', c_name), c_mktsegment
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
fx_folders AS (
  SELECT id, parent_id, path, parent_id IS NULL AS recursive, id % 3 = 0 AS scan_complete,
         CASE segment WHEN 'BUILDING' THEN '["private","/lib/x"]' WHEN 'FURNITURE' THEN 'not json' WHEN 'MACHINERY' THEN '["a",1]' ELSE '[]' END AS exclude,
         CASE segment WHEN 'HOUSEHOLD' THEN '["Customer"]' WHEN 'AUTOMOBILE' THEN '{"a":1}' ELSE '[]' END AS include,
         CASE WHEN id = 1 THEN 'custom' END AS thumbnail_cache_mode,
         CASE WHEN id = 1 THEN '' END AS thumbnail_cache_folder,
         CASE WHEN id = 1 THEN 'global' ELSE 'disable' END AS thumbnail_cache_fallback,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM fx_tree
),
fx_media AS (
  SELECT o_orderkey + 1 AS id, f.id AS folder_id,
         concat(substr(f.path, 6), '/img_', CAST(o_orderkey AS VARCHAR), ext.e) AS relative_path,
         concat(f.path, '/img_', CAST(o_orderkey AS VARCHAR), ext.e) AS absolute_path,
         md5(CAST(o_orderkey % 1000 AS VARCHAR)) AS content_hash,
         CAST(1 + o_orderkey % 4000 AS INTEGER) AS width, CAST(1 + o_orderkey % 3000 AS INTEGER) AS height,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE substr(ext.e, 2) END AS format,
         CAST(floor(o_totalprice) AS BIGINT) AS file_size,
         CAST(o_orderdate AS TIMESTAMP) AS modified_at, CAST(o_orderdate + INTERVAL 1 DAY AS TIMESTAMP) AS created_at,
         o_orderstatus <> 'F' AS is_present,
         CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-01-01 00:00:00' END AS missing_since
  FROM orders JOIN fx_tree f ON f.id = 1000 + o_custkey
  JOIN (VALUES (0,'.jpg'),(1,'.JPEG'),(2,'.png'),(3,'.webp'),(4,'.gif'),(5,'.bmp'),(6,'.tiff'),(7,'.avif'),(8,'.txt'),(9,'')) AS ext(k, e)
    ON ext.k = o_orderkey % 10
),
fx_listing AS (
  SELECT absolute_path AS path, FALSE AS is_dir,
         CASE WHEN o_orderpriority = '2-HIGH' THEN file_size + 1 ELSE file_size END AS size, modified_at AS mtime
  FROM fx_media JOIN orders ON id = o_orderkey + 1 WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
  UNION ALL
  SELECT concat(path, '/new_', CAST(id AS VARCHAR), '.png'), FALSE, id, TIMESTAMP '2024-06-01 00:00:00' FROM fx_tree WHERE segment IS NOT NULL
),
fx_events AS (
  SELECT e.event_id, CAST(e.ts AS TIMESTAMP) AS ts, m.absolute_path AS path,
         CASE e.event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'modify' WHEN 'error' THEN 'remove'
                           WHEN 'view' THEN 'access' ELSE 'other' END AS event_kind,
         e.value >= 20 AS path_exists, e.event_id % 29 = 0 AS is_dir
  FROM events e JOIN fx_media m ON m.id = e.user_id + 1
),
fx_work_items AS (
  SELECT o_orderkey + 1 AS id, o_orderkey + 1 AS media_file_id, CAST(NULL AS BIGINT) AS searchable_config_id,
         CASE o_orderkey % 4 WHEN 0 THEN 'tagger' WHEN 1 THEN 'classifier' WHEN 2 THEN 'visionlanguage' ELSE 'mystery' END AS job_kind,
         concat('{"model_name":"m', CAST(o_orderkey % 3 AS VARCHAR), '"}') AS params_json,
         CASE o_orderkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE 'pending' END AS status,
         CAST(0 AS BIGINT) AS attempts, CAST(NULL AS VARCHAR) AS error,
         CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at
  FROM orders
),
fx_values AS (
  SELECT l.doc_id + 1 AS id, l.doc_id + 1 AS media_file_id, CAST(1 AS BIGINT) AS searchable_config_id,
         concat('{"label":', CAST(l.quality AS VARCHAR), '}') AS value_json,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM labels l
),
fx_configs AS (
  SELECT concat('scorer-', source) AS name, 'text' AS kind, source NOT LIKE '%3' AS enabled, '{}' AS options,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM documents GROUP BY source
),
fx_cached AS (
  SELECT DISTINCT path FROM (
    SELECT concat('/lib/.thumbnails/', substr(content_hash,1,2), '/', substr(content_hash,3,2), '/', content_hash, '_512.webp') AS path
    FROM fx_media WHERE absolute_path LIKE '%.png'
    UNION ALL
    SELECT concat('/cache/global/', substr(content_hash,1,2), '/', substr(content_hash,3,2), '/', content_hash, '_512.webp')
    FROM fx_media WHERE absolute_path LIKE '%.png' OR absolute_path LIKE '%.webp')
),
fx_closure AS (
  SELECT id AS ancestor_id, id AS folder_id, 0 AS depth FROM fx_tree
  UNION ALL
  SELECT f.parent_id, c.folder_id, c.depth + 1 FROM fx_closure c JOIN fx_tree f ON f.id = c.ancestor_id WHERE f.parent_id IS NOT NULL
),
fx_roots AS (SELECT folder_id, arg_max(ancestor_id, depth) AS root_id FROM fx_closure GROUP BY folder_id)
"""
