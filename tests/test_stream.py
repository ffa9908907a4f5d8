import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from shoebox.operators import changes, skew
from shoebox.plans import ingest
from shoebox.schemas import CHANGE_EVENTS
from shoebox.sources.catalog import Catalog
from shoebox.streaming import changes as stream

from test_ingest import media_of, put

START = dt.datetime(2024, 6, 1)


def events(spark, rows):
    full = [(i, START + dt.timedelta(seconds=i), p, k, e, d) for i, (p, k, e, d) in enumerate(rows)]
    return spark.createDataFrame(full, CHANGE_EVENTS)


def kinds(df):
    return {r.path: r.kind for r in df.collect()}


def test_classify(spark):
    got = changes.classify(events(spark, [
        ("/a.png", "create", True, False), ("/b.png", "create", False, False), ("/c.png", "modify", True, False),
        ("/d.png", "modify", False, False), ("/e.png", "remove", True, False), ("/f.png", "access", True, False),
        ("/g.png", "other", True, False), ("/h.png", "any", False, False), ("/i", "create", True, True),
        ("/j.txt", "modify", True, False), ("/k.txt", "remove", False, False), ("/l.png", "access", False, False)]))
    assert kinds(got) == {"/a.png": "upsert", "/b.png": "remove", "/c.png": "upsert", "/d.png": "remove", "/e.png": "remove",
                          "/g.png": "upsert", "/h.png": "remove", "/k.txt": "remove"}


def test_collapse(spark):
    batch = changes.classify(events(spark, [
        ("/a.png", "remove", False, False), ("/a.png", "create", True, False), ("/b.png", "create", True, False), ("/b.png", "modify", True, False)]))
    assert kinds(changes.collapse(batch)) == {"/a.png": "remove", "/b.png": "upsert"}
    assert kinds(changes.collapse(batch, "latest")) == {"/a.png": "upsert", "/b.png": "upsert"}


def test_rules_resolve(spark):
    listed = spark.createDataFrame([("/lib/a/x.png",), ("/lib/ab/x.png",), ("/library/x.png",), ("/gone/x.png",)], "path string").withColumn("kind", F.lit("upsert"))
    rules = [{"rule_no": 1, "path": "/lib"}, {"rule_no": 2, "path": "/lib/a", "exclude": ["zzz"]}, {"rule_no": 3, "path": "/gone", "exclude": ["x.png"]},
             {"rule_no": 4, "path": "/lib/a"}]
    found = changes.resolve(listed, rules).select("path", "kind", "rule_no", "root", "relative_path")
    assert sorted(map(tuple, found.collect())) == [("/lib/a/x.png", "upsert", 4, "/lib/a", "x.png"), ("/lib/ab/x.png", "upsert", 1, "/lib", "ab/x.png")]
    loose = changes.resolve(listed, [*rules, {"rule_no": 5, "path": ""}, {"rule_no": 6, "path": "/"}], apply_rules=False)
    assert {r.path: r.rule_no for r in loose.collect()} == {"/lib/a/x.png": 4, "/lib/ab/x.png": 1, "/library/x.png": 6, "/gone/x.png": 3}


@pytest.fixture
def scanned(spark, tmp_path, now):
    root = str(tmp_path / "lib")
    for name in ("a.png", "b.png", "sub/c.png"):
        put(root, name)
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    ingest.scan_import(spark, catalog, {"path": root}, now)
    return root, catalog


def test_stream_applies_and_replays(spark, scanned, tmp_path, now):
    root, catalog = scanned
    put(root, "new/dir/d.png")
    put(root, "private/e.png")
    os.remove(f"{root}/b.png")
    feed = str(tmp_path / "events")
    first = [(f"{root}/new/dir/d.png", "create", True, False), (f"{root}/b.png", "remove", False, False), ("/elsewhere/x.png", "create", True, False)]
    second = [(f"{root}/a.png", "remove", False, False), (f"{root}/a.png", "create", True, False), (f"{root}/ghost.png", "create", True, False),
              (f"{root}/private/e.png", "create", True, False)]
    for n, batch in enumerate((first, second)):
        events(spark, batch).coalesce(1).write.parquet(f"{feed}/{n}")
    rules = [{"rule_no": 1, "path": root, "exclude": ["private"]}]
    source = stream.read_events(spark, f"{feed}/*", per_batch=1)
    stream.run(source, catalog, rules, now, str(tmp_path / "progress"), trigger={"availableNow": True}).awaitTermination()
    rows = media_of(catalog)
    assert {n: r.is_present for n, r in rows.items()} == {"a.png": False, "b.png": False, "sub/c.png": True, "new/dir/d.png": True}
    folders = {r.path: r for r in catalog.read("folders").collect()}
    assert rows["new/dir/d.png"].folder_id == folders[f"{root}/new/dir"].id and folders[f"{root}/new/dir"].scan_complete
    assert folders[f"{root}/new/dir"].parent_id == folders[f"{root}/new"].id and folders[f"{root}/new"].parent_id == folders[root].id
    assert f"{root}/private" not in folders

    version = catalog.version()
    again = stream.apply_batch(events(spark, second), catalog, rules, now, "changes", 1)
    assert again["replayed"] and catalog.version() == version

    # the next batch brings the file back; unreadable files are counted
    done = stream.apply_batch(events(spark, [(f"{root}/a.png", "modify", True, False), (f"{root}/ghost.png", "create", True, False)]), catalog, rules, now, "changes", 2)
    assert (done["upserted"], done["missing"], done["failed"]) == (1, 0, 1)
    assert [r.folder_id for r in done["folders"].collect()] == [folders[root].id]
    back = media_of(catalog)["a.png"]
    assert back.is_present and back.id == rows["a.png"].id


def test_stream_equals_batch(spark, scanned, tmp_path):
    feed = str(tmp_path / "e2")
    batch = events(spark, [(f"/x/{i % 7}.png", "remove" if i % 5 == 0 else "modify", True, False) for i in range(200)])
    batch.repartition(5).write.parquet(feed)
    wanted = sorted(map(tuple, changes.debounce(changes.classify(batch), "3 seconds").collect()))
    timed = changes.debounce(changes.classify(stream.read_events(spark, feed)), "3 seconds", watermark="10 minutes")
    # a last event far in the future closes every session before it
    events(spark, [("/x/end.png", "modify", True, False)]).withColumn("ts", F.lit("2025-01-01").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(feed)
    query = timed.writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("debounced").collect()))
    assert got == wanted and len(got) > 7


def test_unreadable_feed_is_reported(spark, tmp_path):
    feed = str(tmp_path / "feed")
    rows = events(spark, [("/one/a.png", "modify", True, False), ("/one/d/b.png", "modify", True, False), ("/two/c.png", "modify", True, False)])
    rows.write.parquet(feed)
    watched, problems = stream.read_watched(spark, [{"path": "/one", "recursive": False}, {"path": "/two"}, {"path": "/three"}], {"/one": feed, "/two": feed})
    assert [p for p, _ in problems] == ["/three"]
    query = watched.writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.path for r in spark.table("watched").collect()) == ["/one/a.png", "/two/c.png"]


def test_large_sides_go_whole_to_no_task(spark, make, tmp_path, now, monkeypatch):
    """Joins of a batch with many rows deal both sides, however few bytes of files they come from."""
    monkeypatch.setattr(skew, "FEW_ROWS", 10)
    broadcast, stored = set(), stream.stored

    def seen(df, label):
        plan = df._jdf.queryExecution().executedPlan().toString()
        broadcast.update(re.sub("#\\d+L?", "", keys) for keys in re.findall(r"BroadcastHashJoin \[([^]]*)\]", plan))
        return stored(df, label)

    monkeypatch.setattr(stream, "stored", seen)
    folders = [{"id": 1, "path": "/r"}, {"id": 900, "path": "/r/d3/only.png"}, *({"id": i, "parent_id": 1, "path": f"/r/d{i}"} for i in range(2, 400))]
    media = [{"id": i, "folder_id": i, "absolute_path": f"/r/d{i}/old.png"} for i in range(2, 60)]
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.commit({"folders": make.folders(folders), "media": make.media(media)})
    batch = [("/r/d3/only.png", "create", True, False), ("/r/top.png", "create", True, False)]
    batch += [(f"/r/d{i}/old.png", "remove" if i % 2 else "modify", True, False) for i in range(2, 40)] + [(f"/r/n{i}/m/x.png", "create", True, False) for i in range(20)]
    stat = lambda files: files.select(
        "path", F.lit(5).cast("bigint").alias("size"), now.alias("mtime"), F.lit("png").alias("format"), F.lit("h").alias("content_hash"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("error"),
    )
    rules = [{"rule_no": 1, "path": "/r"}, {"rule_no": 2, "path": "/r/d3/only.png"}]
    done = stream.apply_batch(events(spark, batch), catalog, rules, now, "changes", 0, stat)
    assert (done["upserted"], done["missing"], done["failed"]) == (41, 19, 0)
    # import rules and the prefixes and folders that are hot: a few rows by construction
    assert broadcast <= {"root", "_prefix", "_dir"}
    after = catalog.read("media")
    assert "BroadcastHashJoin" not in after._jdf.queryExecution().executedPlan().toString()
    rows, paths = {r.absolute_path: r for r in after.collect()}, {r.path: r for r in catalog.read("folders").collect()}
    assert len(rows) == 58 + 22 and len(paths) == 400 + 40 and paths["/r/n7/m"].parent_id == paths["/r/n7"].id and paths["/r/n7"].parent_id == 1
    assert rows["/r/n7/m/x.png"].folder_id == paths["/r/n7/m"].id and rows["/r/top.png"].folder_id == 1 and rows["/r/d3/only.png"].folder_id == 3
    assert all((r.id, r.folder_id, r.is_present) == (i, i, i >= 40 or i % 2 == 0) for i in range(2, 60) for r in [rows[f"/r/d{i}/old.png"]])
