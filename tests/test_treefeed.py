import os
import shutil
import time

from shoebox.plans import ingest
from shoebox.sources.catalog import Catalog
from shoebox.streaming import changes as stream
from shoebox.streaming import treefeed

from test_ingest import media_of, put


def poll(reader, at, after):
    """One poll by hand: its events, by kind."""
    found = {}
    for part in reader.partitions({"poll": at}, {"poll": after}):
        rows = list(reader.read(part))
        assert [r[:4] for r in reader.read(part)] == [r[:4] for r in rows]  # a task that runs again
        for _, _, path, kind, *_ in rows:
            found.setdefault(kind, []).append(os.path.relpath(path, reader.root) if path else "")
    reader.commit({"poll": after})
    return {k: sorted(v) for k, v in found.items()}


def test_polls(tmp_path):
    root = str(tmp_path / "lib")
    for name in ("a.png", "s/b.png", "s/deep/c.png", "t/d.png", "odd\nname/e.png"):
        put(root, name)
    os.symlink(f"{root}/s", f"{root}/link")
    reader = treefeed.TreeReader({"path": root, "state": str(tmp_path / "state")})
    assert poll(reader, 0, 10) == {"heartbeat": [""]}
    put(root, "s/new.png")
    put(root, "u/v/w.png")
    os.remove(f"{root}/a.png")
    os.utime(f"{root}/s/deep/c.png", (5, 5))
    assert poll(reader, 10, 20) == {"heartbeat": [""], "create": ["s/new.png", "u/v/w.png"], "remove": ["a.png"], "modify": ["s/deep/c.png"]}
    assert poll(reader, 20, 30) == {"heartbeat": [""]}
    shutil.rmtree(f"{root}/s")
    assert poll(reader, 30, 40)["remove"] == ["s/b.png", "s/deep/c.png", "s/new.png"]
    os.rename(root, f"{root}-away")
    assert poll(reader, 40, 50) == {"heartbeat": [""], "error": ["."]}
    os.rename(f"{root}-away", root)
    put(root, "back.png")
    assert poll(reader, 50, 60) == {"heartbeat": [""], "create": ["back.png"]}
    assert all(len(treefeed.listings(str(tmp_path / "state" / d))) == 1 for d in os.listdir(tmp_path / "state"))


def test_levels_and_flat_roots(tmp_path):
    root = str(tmp_path / "lib")
    for name in ("a.png", "s/b.png", "s/deep/c.png"):
        put(root, name)
    for options in ({"levels": "2"}, {"recursive": "false"}):
        reader = treefeed.TreeReader({"path": root, "state": str(tmp_path / str(len(str(options)))), **options})
        assert poll(reader, 0, 10) == {"heartbeat": [""]}
        os.utime(f"{root}/s/deep/c.png", (9, len(str(options))))
        os.utime(f"{root}/a.png", (9, len(str(options))))
        assert poll(reader, 10, 20)["modify"] == (["a.png", "s/deep/c.png"] if "levels" in options else ["a.png"])


def test_folder_that_fails_keeps_its_files():
    old = iter([["/r/a", 1, 1], ["/r/f/x", 1, 1], ["/r/g", 1, 1]])
    got = list(treefeed.merged(old, iter([("/r/b", 2, 2)]), ["/r/f"]))
    assert got == [("remove", ["/r/a", 1, 1]), ("create", ["/r/b", 2, 2]), (None, ["/r/f/x", 1, 1]), ("remove", ["/r/g", 1, 1])]


def test_watched_trees_reach_the_catalogue(spark, tmp_path, now):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for root in (one, two):
        put(root, "a.png")
        put(root, "sub/b.png")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    rules = [{"rule_no": 1, "path": one}, {"rule_no": 2, "path": two}, {"rule_no": 3, "path": f"{one}-gone"}, {"rule_no": 4, "path": ""}]
    for rule in rules[:2]:
        ingest.scan_import(spark, catalog, rule, now)
    feed, problems = treefeed.watch(spark, rules, str(tmp_path / "state"))
    assert problems == [(f"{one}-gone", "not reachable"), ("", "no path configured")]
    seen = []

    def go():
        out = stream.run(
            treefeed.changes_only(feed), catalog, rules[:2], now, str(tmp_path / "progress"), trigger={"availableNow": True}, report=seen.append,
        )
        out.awaitTermination()
        time.sleep(0.01)

    go()
    put(one, "sub/new.png")
    os.remove(f"{two}/a.png")
    os.remove(f"{two}/sub/b.png")
    go()
    rows = {r.absolute_path: r.is_present for r in Catalog(spark, catalog.root).read("media").collect()}
    assert rows == {f"{one}/a.png": True, f"{one}/sub/b.png": True, f"{one}/sub/new.png": True, f"{two}/a.png": False, f"{two}/sub/b.png": False}
    assert seen[-1]["upserted"] == 1 and seen[-1]["missing"] == 2 and media_of(catalog)
