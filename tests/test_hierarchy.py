import random
import zlib

import pytest
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.operators import browse, hierarchy
from shoebox.session import checkpointed


def pairs(df):
    return sorted(tuple(r) for r in df.select("ancestor_id", "folder_id", "depth").collect())


def test_both_closures_agree_with_nested_roots(make):
    folders = make.folders([
        {"id": 1, "path": "/lib"}, {"id": 2, "parent_id": 1, "path": "/lib/a"}, {"id": 3, "parent_id": 2, "path": "/lib/a/b"},
        # an import of its own inside another one starts a new tree
        {"id": 4, "path": "/lib/n"}, {"id": 5, "parent_id": 4, "path": "/lib/n/x"},
        {"id": 6, "path": "/library"}, {"id": 7, "path": "/r_x"}, {"id": 8, "path": "/rAx"}, {"id": 9, "parent_id": 8, "path": "/rAx/a"},
    ])
    found = pairs(hierarchy.closure(folders))
    assert found == pairs(hierarchy.closure_recursive(folders))
    assert (4, 5, 1) in found and (1, 5, 2) not in found and (7, 9, 1) not in found
    for root in range(1, 10):
        direct = sorted(r.id for r in hierarchy.subtree(folders, root).collect())
        assert direct == sorted(r.id for r in hierarchy.subtree(hierarchy.closure(folders), root).collect())
    top = {r.folder_id: r.root_id for r in hierarchy.roots(hierarchy.closure(folders)).collect()}
    assert top == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8}


def test_deep_chain(make):
    rows, path = [], ""
    for i in range(1, 111):
        path += f"/d{i}"
        rows.append({"id": i, "parent_id": i - 1 or None, "path": path})
    folders = make.folders(rows)
    tree = hierarchy.closure(folders)
    assert tree.count() == 110 * 111 // 2
    assert hierarchy.closure_recursive(folders).count() == 110 * 111 // 2
    assert hierarchy.subtree(tree, 100).count() == hierarchy.subtree(folders, 100).count() == 11


def test_cycle_fails(make, spark):
    folders = make.folders([{"id": 1, "parent_id": 2, "path": "/a"}, {"id": 2, "parent_id": 1, "path": "/b"}])
    limit = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    try:
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "10")
        with pytest.raises(Exception, match="RECURSION"):
            hierarchy.closure_recursive(folders).count()
    finally:
        spark.conf.set("spark.sql.cteRecursionLevelLimit", limit)


def test_recursion_has_no_limit_on_rows_or_levels(make, spark):
    folders = make.folders([
        {"id": 1, "path": "/r"}, {"id": 2, "parent_id": 1, "path": "/r/a"}, {"id": 3, "parent_id": 2, "path": "/r/a/b"},
        {"id": 4, "parent_id": 3, "path": "/r/a/b/c"}, {"id": 5, "parent_id": 99, "path": "/x/y"}, {"id": 6, "parent_id": 5, "path": "/x/y/z"},
    ])
    limits = {"spark.sql.cteRecursionLevelLimit": "2", "spark.sql.cteRecursionRowLimit": "5"}
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        found = [tuple(r) for r in hierarchy.closure_recursive(folders).collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted(found) == sorted(
        [(k, k, 0) for k in range(1, 7)] + [(1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 3, 2), (2, 4, 2), (1, 4, 3), (99, 5, 1), (5, 6, 1), (99, 6, 2)])
    assert hierarchy.closure_recursive(folders.limit(0)).count() == 0


def test_tree_order_keeps_same_named_trees_apart(make):
    folders = make.folders([
        {"id": 1, "path": "/b/Photos"}, {"id": 2, "parent_id": 1, "path": "/b/Photos/x"},
        {"id": 3, "path": "/a/photos"}, {"id": 4, "parent_id": 3, "path": "/a/photos/A"},
        {"id": 5, "parent_id": 3, "path": "/a/photos/a b"}, {"id": 6, "parent_id": 4, "path": "/a/photos/A/z"}, {"id": 7, "path": "/z/Early"},
    ])
    tree = hierarchy.closure(folders)
    ordered = hierarchy.tree_order(folders, tree).orderBy("sort_key").select("id", "depth").collect()
    assert [tuple(r) for r in ordered] == [(7, 0), (3, 0), (4, 1), (6, 2), (5, 1), (1, 0), (2, 1)]
    flat = hierarchy.tree_order(folders, tree, folders.where("id = 3").select("path"))
    assert sorted(r.id for r in flat.select("id").collect()) == [1, 2, 3, 7]


def test_name_filter(make):
    folders = make.folders([
        {"id": 1, "path": "/lib"}, {"id": 2, "parent_id": 1, "path": "/lib/Cats"}, {"id": 3, "parent_id": 2, "path": "/lib/Cats/old"},
        {"id": 4, "parent_id": 1, "path": "/lib/dogs"},
    ])
    tree = hierarchy.closure(folders)

    def ids(text):
        return sorted(r.id for r in hierarchy.name_filter(folders, tree, text).select("id").collect())

    assert ids("") == [1, 2, 3, 4] and ids("cat") == [1, 2] and ids("OLD") == [1, 2, 3] and ids("none") == []


@pytest.mark.parametrize("mode", ["custom", None])
def test_settings_come_from_the_root(make, mode):
    folders = make.folders([
        {"id": 1, "path": "/imports/photos", "thumbnail_cache_mode": mode, "thumbnail_cache_folder": "/c" if mode else None, "thumbnail_cache_fallback": "global"},
        {"id": 2, "parent_id": 1, "path": "/imports/photos/vacation", "thumbnail_cache_mode": "disabled"},
    ])
    got = hierarchy.inherited_settings(folders).where("folder_id = 2").first()
    assert (got.root_path, got.cache_mode, got.cache_folder, got.cache_fallback) == (
        "/imports/photos", mode or "global", "/c" if mode else "", "global")


def test_derive_folders(make, spark, now):
    known = make.folders([{"id": 1, "path": "/lib"}, {"id": 2, "parent_id": 1, "path": "/lib/a"}])
    listing = spark.createDataFrame(
        [("/lib/a/b/c/x.png", False), ("/lib/empty", True), ("/lib/top.png", False), ("/library/x.png", False)], "path string, is_dir boolean")
    dirs = hierarchy.directories_of(listing, "/lib")
    new = hierarchy.derive_folders(dirs, known, now, exclude=F.lit(["p"])).collect()
    by_path = {r.path: r for r in new}
    assert set(by_path) == {"/lib/a/b", "/lib/a/b/c", "/lib/empty"}
    assert by_path["/lib/a/b"].parent_id == 2 and by_path["/lib/empty"].parent_id == 1
    assert by_path["/lib/a/b/c"].parent_id == by_path["/lib/a/b"].id
    assert not by_path["/lib/a/b"].recursive and by_path["/lib/a/b"].exclude == ["p"] and by_path["/lib/a/b"].include == []


def test_prune_complete(make, spark):
    folders = make.folders([
        {"id": 1, "path": "/lib", "scan_complete": True}, {"id": 2, "parent_id": 1, "path": "/lib/done", "scan_complete": True},
        {"id": 3, "parent_id": 2, "path": "/lib/done/sub"}, {"id": 4, "parent_id": 1, "path": "/lib/open"},
        {"id": 5, "path": "/other", "scan_complete": True},
    ])
    listing = spark.createDataFrame(
        [("/lib/x.png", False), ("/lib/done", True), ("/lib/done/x.png", False), ("/lib/done/sub/x.png", False),
         ("/lib/open/x.png", False), ("/lib/done2/x.png", False)], "path string, is_dir boolean")
    kept = hierarchy.prune_complete(listing, folders, hierarchy.closure(folders), 1, "/lib")
    assert sorted(r.path for r in kept.collect()) == ["/lib/done2/x.png", "/lib/open/x.png", "/lib/x.png"]


def test_browse_scopes_and_pages(make):
    folders = make.folders([{"id": 1, "path": "/r"}, {"id": 2, "parent_id": 1, "path": "/r/a"}, {"id": 3, "path": "/ra"}])
    media = make.media([{"id": i, "folder_id": f, "relative_path": f"{i}.png"} for i, f in enumerate([1, 2, 2, 3, 2, 1], start=1)])
    tree = hierarchy.closure(folders)
    assert [r.id for r in browse.page_of_folder(media, 2, 2, 1).collect()] == [3]
    assert [r.id for r in browse.page_of_folder(media, 2, 5, 10).collect()] == []
    assert [r.id for r in browse.page_of_subtree(media, tree, 1, 1, 3).collect()] == [2, 3, 5]
    assert [r.id for r in browse.page_of_folder(media, 2, None, 2).collect()] == [2, 3]
    assert browse.count_in_subtree(media, tree, 1).first().n == 5
    assert browse.count_in_folder(media, 2).first().n == 3
    assert {r.folder_id: r.n for r in browse.counts_by_subtree(media, tree).collect()} == {1: 5, 2: 3, 3: 1}
    assert sorted(r.id for r in browse.in_path_scope(media, folders, 1).collect()) == [1, 2, 3, 5, 6]
    assert [r.id for r in browse.by_id(media, 4).collect()] == [4]
    assert [r.id for r in browse.by_relative_path(media, 3, "4.png").collect()] == [4]


def test_sort_orders(make):
    media = make.media([
        {"id": 1, "relative_path": "x/B.png", "file_size": None}, {"id": 2, "relative_path": "y/a.png", "file_size": 5},
        {"id": 3, "relative_path": "a/c.png", "file_size": 5}, {"id": 4, "relative_path": "b/C.png", "file_size": 2},
    ])
    rows = browse.summaries(media)

    def ids(key, descending=False):
        return [r.id for r in browse.sort_media(rows, key, descending).collect()]

    assert ids("filename") == [2, 1, 3, 4]
    assert ids("filename", True) == [3, 4, 1, 2]
    assert ids("size") == [1, 4, 2, 3]
    assert ids("size", True) == [2, 3, 4, 1]
    assert ids("score") == ids("score", True) == [2, 1, 3, 4]


def test_ancestors_of_many(spark):
    df = spark.createDataFrame([("/a/b",)], "path string").select(F.explode(paths.ancestor_paths("path")).alias("p"))
    assert [r.p for r in df.collect()] == ["/a", "/a/b"]


def test_chains_of_any_depth_and_cycles(spark, make):
    n = 100_000
    parent = F.when(F.col("id") > 0, F.col("id") - 1)
    chain = spark.range(n).select("id", parent.alias("parent_id"), F.concat(F.lit("/"), F.col("id").cast("string")).alias("path"))
    top = hierarchy.climbed(chain).agg(F.max("depth").alias("deep"), F.min("root_id").alias("low"), F.max("root_id").alias("high"), F.count("depth").alias("n")).first()
    assert tuple(top) == (n - 1, 0, 0, n)
    odd = make.folders([{"id": 1, "path": "/a"}, {"id": 2, "path": "/a/b", "parent_id": 1}, {"id": 3, "path": "/x/y", "parent_id": 77}, {"id": 4, "path": "/x/y/z", "parent_id": 3}])
    assert sorted(map(tuple, hierarchy.climbed(odd).collect()), key=lambda r: r[0]) == [(1, 1, 0), (2, 1, 1), (3, None, 1), (4, None, 2)]
    loop = make.folders([{"id": 1, "path": "/a"}, {"id": 5, "path": "/l", "parent_id": 6}, {"id": 6, "path": "/m", "parent_id": 5}, {"id": 7, "path": "/n", "parent_id": 6}])
    with pytest.raises(ValueError, match="parents of /l form a cycle"):
        hierarchy.climbed(loop)
    assert hierarchy.climbed(loop.limit(0)).count() == 0


def test_closure_after_random_changes(spark, make):
    rng = random.Random(3)

    def table(paths):
        ids = {p: 1 + zlib.crc32(p.encode()) for p in paths}
        return make.folders([{"id": ids[p], "path": p, "parent_id": ids.get(p.rsplit("/", 1)[0])} for p in sorted(paths)])

    def grown(paths):
        return {p for p in paths if p.count("/") == 1 or p.rsplit("/", 1)[0] in paths}

    paths = {"/r", "/s"}
    for _ in range(60):
        paths.add(f"{rng.choice(sorted(paths))}/{rng.choice('abcd')}")
    tree = checkpointed(hierarchy.closure(table(paths)))
    for _ in range(4):
        after = set(paths)
        for p in rng.sample(sorted(after - {"/r", "/s"}), 4):  # gone with all below
            after = {q for q in after if q != p and not q.startswith(p + "/")}
        source, target = rng.choice(sorted(after - {"/r", "/s"})), rng.choice(sorted(after))
        if not (target + "/").startswith(source + "/"):  # moved with all below
            after = {target + "/m" + q[len(source):] if q == source or q.startswith(source + "/") else q for q in after}
        after |= {f"{rng.choice(sorted(after))}/{rng.choice('xyz')}" for _ in range(4)}
        after = grown(after)
        old, now = table(paths), table(after)
        key = ["id", "parent_id", "path"]
        gone, new = old.select(key).exceptAll(now.select(key)), now.select(key).exceptAll(old.select(key))
        tree, paths = checkpointed(hierarchy.closure_after(tree, now, gone, new)), after
        assert sorted(map(tuple, tree.collect())) == sorted(map(tuple, hierarchy.closure(now).collect()))
