import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from shoebox.operators import fingerprint
from shoebox.plans import ingest
from shoebox.schemas import timestamp
from shoebox.sources import filetree, imports
from shoebox.sources.catalog import Catalog, StaleCatalog



@pytest.fixture
def later():
    return timestamp("2024-08-01 00:00:00")


def png(width=3, height=2):
    body = b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body))


def put(root, name, content=None):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(png() if content is None else content)
    return path


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "lib")
    for name in ("n.png", "sub/y.JPG", "_u.png", ".dot.png", ".thumbs/z.png", "_d/x.png", "k=v/q.png", "sp ace#1.png", "a/b/c/deep.png"):
        put(root, name)
    put(root, "plain", b"x")
    put(root, "empty.png", b"")
    put(root, "note.txt", b"x")
    return root


def names(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


ALL = sorted(["n.png", "sub/y.JPG", "_u.png", ".dot.png", ".thumbs/z.png", "_d/x.png", "k=v/q.png", "sp ace#1.png", "a/b/c/deep.png", "empty.png"])


def test_listing(spark, tree):
    files, dirs = filetree.list_tree(spark, tree)
    assert names(files, tree) == ALL
    assert names(dirs.where("status = 'listed'"), tree) == sorted([".", "sub", ".thumbs", "_d", "k=v", "a", "a/b", "a/b/c"])
    row = files.where(F.col("path").endswith("/n.png")).first()
    assert row.size == len(png()) and row.mtime.microsecond == 0
    flat, _ = filetree.list_tree(spark, tree, recursive=False)
    assert names(flat, tree) == sorted([".dot.png", "_u.png", "empty.png", "n.png", "sp ace#1.png"])


def test_listing_prunes(spark, tree):
    files, dirs = filetree.list_tree(spark, tree, exclude=[".thumbs", f"{tree}/a"])
    assert names(files, tree) == sorted(set(ALL) - {".thumbs/z.png", "a/b/c/deep.png"})
    assert names(dirs.where("status = 'excluded'"), tree) == [".thumbs", "a"]
    only, _ = filetree.list_tree(spark, tree, include=["sub"])
    assert names(only, tree) == ["sub/y.JPG"]
    strict, _ = filetree.list_tree(spark, tree, include=[f"{tree}/sub"])
    below, _ = filetree.list_tree(spark, tree, include=[f"{tree}/sub"], mode="subtree")
    assert names(strict, tree) == [] and names(below, tree) == ["sub/y.JPG"]
    skip = spark.createDataFrame([(f"{tree}/a",)], "path string")
    rest, dirs = filetree.list_tree(spark, tree, skip=skip)
    assert names(rest, tree) == sorted(set(ALL) - {"a/b/c/deep.png"})
    assert names(dirs.where("status = 'skipped'"), tree) == ["a"]


def test_failed_directory_is_reported(spark, tmp_path):
    files, dirs = filetree.list_tree(spark, str(tmp_path / "absent"))
    assert files.count() == 0 and dirs.first().status == "failed"


def test_read_bytes(spark, tmp_path):
    put(str(tmp_path), "d/a.png", b"abc")
    got = fingerprint.fingerprint_content(filetree.read_bytes(spark, str(tmp_path))).first()
    assert got.path == f"{tmp_path}/d/a.png" and got.content_hash.startswith("ba7816bf") and got.format == "png" and got.width is None


def test_image_headers(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\x03" * 6
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, 11, 0) + struct.pack("<HHII", 257, 4, 1, 12)
    samples = {
        "a.png": (png(7, 9), (7, 9)), "b.jpg": (jpeg, (40, 30)), "c.gif": (b"GIF89a" + struct.pack("<HH", 5, 6), (5, 6)),
        "d.bmp": (b"BM" + b"\0" * 16 + struct.pack("<ii", 8, -4), (8, 4)),
        "e.webp": (b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (19).to_bytes(3, "little") + (9).to_bytes(3, "little"), (20, 10)),
        "f.tiff": (tiff, (11, 12)), "g.avif": (b"x" * 64, (None, None)), "h.png": (jpeg, (None, None)), "i.gif": (b"", (None, None)),
    }
    rows = [(put(str(tmp_path), n, c), len(c)) for n, (c, _) in samples.items()] + [(str(tmp_path / "none.png"), 0)]
    got = {os.path.basename(r.path): r for r in fingerprint.fingerprint_files(spark.createDataFrame(rows, "path string, size bigint")).collect()}
    assert {n: (got[n].width, got[n].height) for n in samples} == {n: d for n, (_, d) in samples.items()}
    assert got["none.png"].error and got["none.png"].content_hash is None
    assert got["b.jpg"].format == "jpeg" and got["h.png"].format == "png"


def test_import_rules(spark, tmp_path):
    rules = imports.import_rules(spark, [{"path": str(tmp_path), "blacklist": ["x"]}, {}, {"path": "/nowhere", "recursive": False}])
    first = rules.orderBy("rule_no").first()
    assert (first.recursive, first.flatten, first.exclude, first.include, first.cache_mode, first.cache_folder, first.cache_fallback) == (
        True, False, ["x"], [], "global", "", "disable")
    good, bad = imports.reachable(rules, spark.createDataFrame([(str(tmp_path),)], "path string"))
    assert [r.rule_no for r in good.collect()] == [1]
    assert sorted((r.rule_no, r.reason) for r in bad.collect()) == [(2, "no path configured"), (3, "not reachable")]


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def media_of(catalog):
    return {r.relative_path: r for r in catalog.read("media").collect()}


def report(df):
    return df.first().asDict()


def test_scan_lifecycle(spark, tree, catalog, now, later):
    rule = {"path": tree}
    first = report(ingest.scan_import(spark, catalog, rule, now))
    assert (first["processed"], first["missing"], first["rejected"], first["listed"]) == (len(ALL), 0, 0, len(ALL))
    before = media_of(catalog)
    assert sorted(before) == ALL
    assert (before["n.png"].width, before["n.png"].height, before["n.png"].format) == (3, 2, "png")
    assert before["sub/y.JPG"].format == "jpeg" and before["sub/y.JPG"].width is None
    folders = {r.path: r for r in catalog.read("folders").collect()}
    assert len(folders) == 8 and all(f.scan_complete for f in folders.values())
    assert folders[tree].parent_id is None and folders[f"{tree}/a/b"].parent_id == folders[f"{tree}/a"].id
    assert before["a/b/c/deep.png"].folder_id == folders[f"{tree}/a/b/c"].id and before["n.png"].folder_id == folders[tree].id

    # scanning again changes nothing
    second = report(ingest.rescan_import(spark, catalog, rule, now))
    assert (second["processed"], second["missing"], second["unchanged"]) == (0, 0, len(ALL))
    assert media_of(catalog) == before

    # one file changes, a folder loses all its files, a directory vanishes
    os.utime(put(tree, "n.png", png(30, 20)), (1_700_000_000,) * 2)
    os.remove(f"{tree}/sub/y.JPG")
    for name in ("a/b/c/deep.png", "a/b/c", "a/b", "a"):
        (os.remove if name.endswith("png") else os.rmdir)(f"{tree}/{name}")
    third = report(ingest.rescan_import(spark, catalog, rule, later))
    assert (third["processed"], third["missing"]) == (1, 2)
    after = media_of(catalog)
    assert not after["sub/y.JPG"].is_present and not after["a/b/c/deep.png"].is_present
    assert after["sub/y.JPG"].content_hash == before["sub/y.JPG"].content_hash and str(after["sub/y.JPG"].missing_since) == "2024-08-01 00:00:00"

    # the same file comes back unchanged
    stamp = before["sub/y.JPG"].modified_at
    path = put(tree, "sub/y.JPG")
    import calendar

    os.utime(path, (calendar.timegm(stamp.timetuple()),) * 2)
    fourth = report(ingest.rescan_import(spark, catalog, rule, later))
    assert (fourth["processed"], fourth["restored"]) == (0, 1)
    restored = media_of(catalog)["sub/y.JPG"]
    assert restored.is_present and restored.missing_since is None and restored.id == before["sub/y.JPG"].id
    ingest.purge(catalog)
    assert "a/b/c/deep.png" not in media_of(catalog)


def test_changed_file_keeps_its_id(spark, tree, catalog, now, later):
    rule = {"path": tree}
    ingest.scan_import(spark, catalog, rule, now)
    before = media_of(catalog)["n.png"]
    put(tree, "n.png", png(30, 20) + b"more")
    ingest.rescan_import(spark, catalog, rule, later)
    after = media_of(catalog)["n.png"]
    assert (after.id, after.created_at, after.width) == (before.id, before.created_at, 30) and after.content_hash != before.content_hash


def test_complete_subfolders_are_not_entered(spark, tree, catalog, now, later):
    rule = {"path": tree}
    ingest.scan_import(spark, catalog, rule, now)
    put(tree, "sub/late.png")
    put(tree, "late.png")
    os.remove(f"{tree}/_d/x.png")
    resumed = report(ingest.scan_import(spark, catalog, rule, later))
    assert (resumed["processed"], resumed["missing"]) == (1, 0)
    assert "late.png" in media_of(catalog) and "sub/late.png" not in media_of(catalog)


def test_excluded_directory_keeps_its_rows(spark, tree, catalog, now, later):
    ingest.scan_import(spark, catalog, {"path": tree}, now)
    done = report(ingest.rescan_import(spark, catalog, {"path": tree, "exclude": ["/_d", "_u.png"]}, later))
    rows = media_of(catalog)
    # the directory was not listed, so nothing is known; the file was left out of a listed one
    assert rows["_d/x.png"].is_present and not rows["_u.png"].is_present and done["missing"] == 1


def test_unreachable_root_marks_nothing(spark, tree, catalog, now, later):
    ingest.scan_import(spark, catalog, {"path": tree}, now)
    os.rename(tree, tree + "-away")
    done = report(ingest.rescan_import(spark, catalog, {"path": tree}, later))
    assert done["missing"] == 0 and all(r.is_present for r in media_of(catalog).values())


def test_same_name_in_two_imports(spark, tmp_path, catalog, now):
    rules = [{"path": str(tmp_path / "one")}, {"path": str(tmp_path / "two")}]
    for rule in rules:
        put(rule["path"], "same.png")
    assert ingest.scan_all(spark, catalog, rules, now).count() == 2
    assert catalog.read("media").count() == 2
    assert ingest.scan_all(spark, catalog, rules, now).count() == 0


def test_non_recursive_import(spark, tree, catalog, now):
    done = report(ingest.scan_import(spark, catalog, {"path": tree, "recursive": False}, now))
    assert done["processed"] == 5 and catalog.read("folders").count() == 1


def test_commit_is_atomic_and_costs_what_changed(spark, make, catalog):
    media = make.media([{"id": i, "relative_path": f"{i}.png"} for i in range(40)])
    assert catalog.version() == 0 and catalog.read("media").count() == 0
    catalog.commit({"media": media})
    change = media.where("id = 3").withColumn("file_size", F.lit(99).cast("bigint"))
    # written but not committed: readers do not see it
    change.withColumn("bucket", F.lit(0)).write.parquet(f"{catalog.root}/data/media/v=2")
    assert catalog.read("media").where("file_size = 99").count() == 0
    catalog.commit(changes={"media": change}, stream="feed", batch=5)
    # the second commit wrote one row
    assert [rows for _, rows in catalog.state["tables"]["media"]] == [40, 1]
    assert [r.id for r in catalog.read("media").where("file_size = 99").collect()] == [3]
    assert catalog.read("media").count() == 40 and catalog.version() == 2
    assert catalog.has_batch("feed", 5) and not catalog.has_batch("feed", 6) and not catalog.has_batch("other", 0)
    catalog.commit({"media": media.limit(0)})
    assert catalog.read("media").count() == 0


def test_the_last_record_states_everything(spark, make, tmp_path):
    root = str(tmp_path / "c")
    catalog = Catalog(spark, root)
    media = make.media([{"id": i, "relative_path": f"{i}.png"} for i in range(10)])
    catalog.commit({"media": media}, stream="feed", batch=7)
    for n in range(4):
        row = media.where(f"id = {n}").withColumn("file_size", F.lit(50).cast("bigint"))
        catalog.commit(changes={"media": row})
    # a draft that was never published and older records that were cleared away are not missed
    (tmp_path / "c" / "commits" / "_draft").write_text("{")
    (tmp_path / "c" / "commits" / "v=2.json").unlink()
    again = Catalog(spark, root)
    assert (again.version(), again.has_batch("feed", 7), again.state) == (5, True, catalog.state)
    assert again.read("media").count() == 10 and again.read("media").where("file_size = 50").count() == 4


def test_two_writers_past_the_check(spark, make, tmp_path, monkeypatch):
    """Both handles find no newer commit; the rename lets one of them through."""
    root = str(tmp_path / "c")
    rows = make.media([{"id": 1, "relative_path": "a.png"}])
    first, second = Catalog(spark, root), Catalog(spark, root)
    monkeypatch.setattr(second, "_latest", lambda: 0)
    first.commit({"media": rows})
    with pytest.raises(StaleCatalog):
        second.commit({"media": rows.limit(0)})
    assert Catalog(spark, root).read("media").count() == 1


def test_changes_of_a_table_never_written(spark, make, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.commit(changes={"media": make.media([{"id": 1, "relative_path": "a.png"}])})
    assert catalog.read("media").count() == 1 and [r.name for r in catalog.read("configs").collect()] == ["filename"]


def test_a_stale_writer_destroys_nothing(spark, make, tmp_path):
    root = str(tmp_path / "c")
    first = Catalog(spark, root)
    rows = make.media([{"id": i, "relative_path": f"{i}.png"} for i in range(30)])
    first.commit({"media": rows})
    winner, loser = Catalog(spark, root), Catalog(spark, root)
    winner.commit({"media": rows.withColumn("file_size", F.lit(2).cast("bigint"))})
    with pytest.raises(StaleCatalog):
        loser.commit({"media": rows.limit(1)})
    for handle in (winner, Catalog(spark, root)):
        assert handle.version() == 2 and handle.read("media").where("file_size = 2").count() == 30
    loser.refresh()
    assert loser.commit({"media": rows.limit(1)}) == 3 and Catalog(spark, root).read("media").count() == 1


def test_a_log_that_cannot_be_read_is_not_empty(spark, tmp_path):
    root = str(tmp_path / "c")
    (tmp_path / "c" / "commits").mkdir(parents=True)
    (tmp_path / "c" / "commits" / "v=4.json").write_text('{"version": 4, "tab')
    with pytest.raises(ValueError):
        Catalog(spark, root)


def test_roots_are_normalised(spark, tree, tmp_path, now):
    """However the root is spelled, the tables are the same; pages return every row once."""
    from shoebox.operators import browse, hierarchy, search

    tables = []
    for n, root in enumerate((tree, f"{tree}/", f"{tree}//")):
        catalog = Catalog(spark, str(tmp_path / f"c{n}"))
        ingest.scan_import(spark, catalog, {"path": root}, now)
        tables.append([sorted(map(str, catalog.read(t).collect())) for t in ("media", "folders")])
        assert not ingest.scan_all(spark, catalog, [{"path": root}], now).collect()
    assert tables[0] == tables[1] == tables[2]
    media, folders = catalog.read("media"), catalog.read("folders")
    top = folders.where(F.col("path") == tree).first().id
    seen, after = [], None
    while page := browse.page_of_subtree(media, hierarchy.closure(folders), top, after, 3).collect():
        seen += [r.id for r in page]
        after = seen[-1]
    assert sorted(seen) == sorted(r.id for r in media.collect()) and min(seen) < 0
    # a catalogue that was never told about scorers finds files by name
    scorers = search.Registry([search.FILENAME])
    found = search.search_in_catalog(media, folders, catalog.read("configs"), scorers, top, True, "deep", ["filename"])
    assert [r.relative_path for r in found.collect()] == ["a/b/c/deep.png"]


def test_colliding_ids_fail(spark, make):
    from shoebox.operators import changeset

    old = make.media([{"id": 5, "relative_path": "a"}])
    changeset.check_new_ids(make.media([{"id": 5, "relative_path": "a"}, {"id": 6, "relative_path": "b"}]), old)
    for clash in ([{"id": 5, "relative_path": "b"}], [{"id": 6, "relative_path": "b"}, {"id": 6, "relative_path": "c"}]):
        with pytest.raises(ValueError):
            changeset.check_new_ids(make.media(clash), old)


def test_changes_stay_small_until_they_are_folded(spark, make, tmp_path):
    """500 changed paths of a large table write 500 rows; the table is written anew only
    when it is folded, and reads the same throughout."""
    one = make.media([{"id": 0, "relative_path": "x"}])
    big = spark.range(100_000).select(
        *[{"id": F.col("id"), "absolute_path": F.concat(F.lit("/r/"), F.col("id").cast("string"))}.get(c, F.lit(one.first()[c]).cast(one.schema[c].dataType)).alias(c) for c in one.columns]
    )
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.commit({"media": big})
    for n in range(3):
        rows = big.where(F.col("id") < 500).withColumn("file_size", F.lit(100 + n).cast("bigint"))
        catalog.commit(changes={"media": rows})
    again = Catalog(spark, catalog.root)
    assert [rows for _, rows in again.state["tables"]["media"]] == [100_000, 500, 500, 500]
    assert again.read("media").count() == 100_000 and again.read("media").where("file_size = 102").count() == 500
    assert again.read("media").where("absolute_path = '/r/7'").first().file_size == 102
    again.commit(changes={"media": big.where("id >= 91000").withColumn("file_size", F.lit(9).cast("bigint"))})
    again.fold("media")
    assert [rows for _, rows in again.state["tables"]["media"]] == [100_000] and Catalog(spark, catalog.root).state == again.state
    assert [again.read("media").where(f"file_size = {n}").count() for n in (9, 102)] == [9_000, 500]
