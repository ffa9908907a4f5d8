import pytest
from pyspark.sql import functions as F

from shoebox.operators import annotate, changeset, hierarchy
from shoebox.schemas import CONFIGS, VALUES, WORK_ITEMS

CHANGE = "folder_id bigint, relative_path string, absolute_path string, content_hash string, width int, height int, format string, file_size bigint, modified_at timestamp_ntz"


def test_upsert_replaces_and_inserts(make, spark, now):
    media = make.media([
        {"id": 10, "relative_path": "foo.jpg", "is_present": False, "missing_since": __import__("datetime").datetime(2024, 2, 2)},
        {"id": 11, "relative_path": "keep.jpg"},
    ])
    changes = spark.createDataFrame([
        (1, "foo.jpg", "/r/foo.jpg", "hash", 100, 200, "jpeg", 1024, None), (1, "new.jpg", "/r/new.jpg", "h2", None, None, None, None, None)], CHANGE)
    after = {r.relative_path: r for r in changeset.upsert_media(media, changes, now).collect()}
    foo, new = after["foo.jpg"], after["new.jpg"]
    assert len(after) == 3
    assert (foo.id, foo.width, foo.height, foo.format, foo.file_size, foo.is_present, foo.missing_since) == (10, 100, 200, "jpeg", 1024, True, None)
    assert foo.created_at.year == 2024 and foo.created_at.month == 1
    assert new.is_present and new.width is None and str(new.created_at) == "2024-07-01 00:00:00"
    again = changeset.upsert_media(changeset.upsert_media(media, changes, now), changes, now)
    assert again.count() == 3 and again.select("folder_id", "relative_path").distinct().count() == 3


def test_missing_then_purge(make, spark, now):
    media = make.media([{"id": 1, "relative_path": "present.jpg"}, {"id": 2, "relative_path": "gone.jpg"}, {"id": 3, "folder_id": 9, "absolute_path": "/x/other.jpg"}])
    listed = spark.createDataFrame([("/r/present.jpg",)], "absolute_path string")
    marked = changeset.mark_missing(media, listed, F.col("folder_id") == 1, now)
    assert {r.id: (r.is_present, r.missing_since is None, r.content_hash) for r in marked.collect()} == {
        1: (True, True, "hash"), 2: (False, False, "hash"), 3: (True, True, "hash")}
    assert sorted(r.id for r in changeset.purge_missing(marked).collect()) == [1, 3]
    key = spark.createDataFrame([(1, "gone.jpg")], "folder_id bigint, relative_path string")
    back = changeset.mark_present_by_key(marked, key)
    assert back.where("is_present").count() == 3 and back.where("missing_since IS NOT NULL").count() == 0
    assert sorted(r.id for r in changeset.delete_where(media, key, changeset.MEDIA_KEY).collect()) == [1, 3]


def test_cascade(make, spark):
    folders = make.folders([{"id": 1, "path": "/r"}, {"id": 2, "parent_id": 1, "path": "/r/a"}, {"id": 3, "path": "/s"}])
    media = make.media([{"id": 1, "folder_id": 2, "relative_path": "a"}, {"id": 2, "folder_id": 3, "relative_path": "b"}])
    left, kept = changeset.cascade_folders(folders, media, hierarchy.closure(folders), spark.createDataFrame([(1,)], "id bigint"))
    assert [r.id for r in left.collect()] == [3] and [r.id for r in kept.collect()] == [2]
    children = spark.createDataFrame([(5, 1), (6, 2)], "id bigint, media_file_id bigint")
    assert [r.id for r in changeset.cascade_media(children, kept).collect()] == [6]


def test_folders_are_created_once(make):
    folders = make.folders([{"id": 1, "path": "/r"}])
    wanted = make.folders([{"id": 77, "path": "/r"}, {"id": 78, "path": "/s"}])
    assert {r.path: r.id for r in changeset.insert_folders(folders, wanted).collect()} == {"/r": 1, "/s": 78}
    assert {r.path: r.id for r in changeset.get_or_create_folders(folders, wanted).collect()} == {"/r": 1, "/s": 78}


def test_config_names_are_unique(spark):
    import datetime as dt

    def configs(*names):
        return spark.createDataFrame([(i, n, "text", True, "{}", dt.datetime(2024, 1, 1)) for i, n in enumerate(names)], CONFIGS)

    assert changeset.insert_configs(configs("a"), configs("b", "c")).count() == 3
    for new in (configs("a"), configs("b", "b")):
        with pytest.raises(Exception, match="config"):
            changeset.insert_configs(configs("a"), new).collect()


def test_values(spark, now):
    import datetime as dt

    stamp = dt.datetime(2024, 1, 1)
    values = spark.createDataFrame([(1, 1, 1, "1", stamp, stamp), (2, 2, 2, "2", stamp, stamp)], VALUES)
    new = spark.createDataFrame([(1, 1, "9"), (3, 1, "3")], "media_file_id bigint, searchable_config_id bigint, value_json string")
    after = {(r.media_file_id, r.searchable_config_id): r for r in annotate.upsert_values(values, new, now).collect()}
    assert len(after) == 3 and after[(1, 1)].id == 1 and after[(1, 1)].value_json == "9"
    assert after[(1, 1)].created_at == stamp and after[(1, 1)].updated_at != stamp and after[(2, 2)].updated_at == stamp
    assert annotate.delete_values_of_media(values, spark.createDataFrame([(1,)], "id bigint")).count() == 1
    assert annotate.delete_values_of_configs(values, spark.createDataFrame([(2,)], "id bigint")).first().id == 1


def test_work_items_round_trip(make, spark, now):
    media = make.media([{"id": 1, "relative_path": "a"}, {"id": 2, "relative_path": "b", "is_present": False}, {"id": 3, "relative_path": "c"}])
    params = '{"model_name":"wd14"}'
    items = annotate.enqueue(spark.createDataFrame([], WORK_ITEMS), media, [("tagger", params)], now)
    assert sorted(r.media_file_id for r in items.collect()) == [1, 3]
    assert annotate.backlog(items).first().n == 2
    assert annotate.enqueue(items, media, [("tagger", params)], now).count() == 2
    claimed = annotate.claim(items, media, 1, now)
    assert sorted(r.status for r in claimed.collect()) == ["pending", "running"]
    # a running item does not block a new request
    later = F.lit("2024-08-01").cast("timestamp_ntz")
    more = annotate.enqueue(claimed, media, [("tagger", params)], later)
    assert more.count() == 3 and more.select("id").distinct().count() == 3
    hidden = annotate.claim(items, media.withColumn("is_present", F.lit(False)), 5, now)
    assert {r.status for r in hidden.collect()} == {"pending"}


def test_annotate_isolates_bad_rows(make, spark, now):
    import datetime as dt

    stamp = dt.datetime(2024, 1, 1)
    media = make.media([{"id": i, "relative_path": f"{i}", "file_size": i} for i in (1, 2, 3)])
    items = spark.createDataFrame([
        (1, 1, 7, "tagger", '{"model_name":"m"}', "running", 0, None, stamp, stamp), (2, 2, 7, "tagger", "bad", "running", 0, None, stamp, stamp),
        (3, 3, 7, "mystery", None, "running", 2, None, stamp, stamp)], WORK_ITEMS)

    def model(pdf):
        if (pdf["file_size"] == 2).any():
            raise ValueError("cannot read 2")
        return pdf["model_name"].map(lambda m: '{"by":"%s"}' % m)

    outcomes = annotate.run_models(items, media, model).persist()
    after, values = annotate.record(items, spark.createDataFrame([], VALUES), outcomes, annotate.unknown_kinds(items), now)
    got = {r.id: (r.status, r.attempts, r.error) for r in after.collect()}
    assert got == {1: ("done", 0, None), 2: ("failed", 1, "cannot read 2"), 3: ("failed", 3, "unknown job kind: mystery")}
    assert [(r.media_file_id, r.value_json) for r in values.collect()] == [(1, '{"by":"m"}')]


def test_models_by_kind_are_loaded_once_a_task(make, spark, tmp_path):
    import datetime as dt

    stamp, n = dt.datetime(2024, 1, 1), 300
    media = make.media([{"id": i, "relative_path": f"{i}", "file_size": i} for i in range(n)])
    kinds = ["tagger", "classifier", "visionlanguage"]
    items = spark.createDataFrame([(i, i, 7, kinds[i % 3], None, "running", 0, None, stamp, stamp) for i in range(n)], WORK_ITEMS)
    log = str(tmp_path / "loads")

    def tagger():
        with open(log, "a") as f:
            f.write("loaded\n")
        return lambda pdf: pdf["file_size"].map(str)

    def classifier():
        raise OSError("no weights")

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r.id: (r.value_json, r.error) for r in annotate.run_models(items, media, {"tagger": tagger, "classifier": classifier}, tasks=2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    wanted = [lambda i: (str(i), None), lambda i: (None, "cannot load classifier: no weights"), lambda i: (None, "no model for kind: visionlanguage")]
    assert got == {i: wanted[i % 3](i) for i in range(n)}
    with open(log) as f:
        assert 1 <= len(f.readlines()) <= 2
    assert annotate.run_models(items.limit(0), media, {"tagger": tagger}).count() == 0


def test_counts_come_from_the_writing_job(make):
    rows, seen = changeset.counted(make.media([{"id": 1, "relative_path": "a"}, {"id": 2, "relative_path": "b", "is_present": False}]), "n", gone=~F.col("is_present"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"gone": 1}


def test_large_batches_are_not_one_task(make, spark, now, monkeypatch, tmp_path):
    from shoebox.plans import annotation
    from shoebox.sources.catalog import Catalog

    media = make.media([{"id": i, "relative_path": f"f{i}", "absolute_path": f"/r/f{i}", "is_present": i != 7} for i in range(1, 31)])
    items = annotate.new_items(spark.createDataFrame([], WORK_ITEMS), media, [("tagger", "{}")], now, 1)
    day = F.concat(F.lit("2024-01-0"), (F.col("media_file_id") % 3 + 1).cast("string")).cast("timestamp_ntz")
    items = items.withColumn("created_at", F.when(F.col("media_file_id") != 5, day))
    oldest = [r.id for r in annotate.next_batch(items, media, 20).collect()]
    monkeypatch.setattr(annotate, "TOP_K", 3)
    batch = annotate.next_batch(items, media, 20)
    assert [r.id for r in batch.collect()] == oldest and batch.columns == items.columns
    assert "Limit" not in batch._jdf.queryExecution().toString() and "TakeOrdered" not in batch._jdf.queryExecution().toString()
    assert annotate.next_batch(items, media, 99).count() == 29 and annotate.next_batch(items.limit(0), media, 99).count() == 0
    # the model runs in as many tasks as the items call for
    dealt, run_models = [], annotate.run_models
    monkeypatch.setattr(annotation, "ITEMS_PER_TASK", 6)
    monkeypatch.setattr(annotate, "run_models", lambda claimed, media, model, tasks=None: dealt.append(tasks) or run_models(claimed, media, model, tasks))
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.commit({"media": media, "work_items": items})
    model = lambda pdf: pdf["relative_path"]
    assert annotation.run_batch(catalog, model, 20, now) == {"done": 20, "failed": 0} and annotation.run_batch(catalog, model, 20, now) == {"done": 9, "failed": 0}
    assert annotation.run_batch(catalog, model, 20, now) == {"done": 0, "failed": 0} and dealt == [4, 2, 1]
