from pyspark.sql import functions as F

from shoebox.functions import json_cols, paths, text, thumbs


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


def test_supported_extension(spark):
    cases = {
        "/a/b.jpg": True, "/a/b.JPEG": True, "/a/.png": False, "/a/.x.png": True, "/a/b": False, "/a.png/b": False,
        "/a/b.heic": False, "/a/b.tiff": True, "/a/b.tif": False, "/a/b.": False, "/a/b.png.txt": False, "/a/sp ace#1.png": True,
    }
    got = values(spark, [(p,) for p in cases], "path string", "path", paths.is_supported("path"))
    assert dict(got) == cases
    assert one(spark, paths.is_supported("v", heif=True), "/a/b.HEIC")


def test_exclude_and_include(spark):
    def check(test, path, patterns):
        literal = one(spark, test("v", patterns), path)
        column = one(spark, test("v", F.lit(patterns).cast("array<string>") if patterns else F.array().cast("array<string>")), path)
        assert literal == column
        return literal

    assert check(paths.is_excluded, "/tmp/skip", ["/tmp/skip"])
    assert not check(paths.is_excluded, "/tmp/keep", ["/tmp/skip"])
    assert not check(paths.is_excluded, "/tmp/skip/x", ["/tmp/skip"])
    assert check(paths.is_excluded, "/tmp/skip", ["/tmp//skip/"])
    assert check(paths.is_excluded, "/home/user/node_modules/foo.png", ["node_modules"])
    assert not check(paths.is_excluded, "/home/user/photos/foo.png", ["node_modules"])
    assert check(paths.is_excluded, "/anything", [""])
    assert check(paths.is_included, "/home/user/photos/foo.png", ["photos"])
    assert not check(paths.is_included, "/home/user/videos/foo.mp4", ["photos"])
    assert check(paths.is_included, "/anything", [])
    assert not one(spark, paths.is_admitted("v", ["private"], ["photos"]), "/home/user/photos/private/foo.png")


def test_include_modes(spark):
    keep = ["/lib/a"]
    strict = values(spark, [("/lib/a",), ("/lib/a/x.png",), ("/lib/ab",)], "p string", paths.is_included("p", keep))
    below = values(spark, [("/lib/a",), ("/lib/a/x.png",), ("/lib/ab",)], "p string", paths.is_included("p", keep, "subtree"))
    assert strict == [(True,), (False,), (False,)] and below == [(True,), (True,), (False,)]


def test_pruning_spares_the_root(spark):
    rows = [("/lib",), ("/lib/x.png",), ("/lib/private/x.png",), ("/lib/private",)]
    got = values(spark, rows, "p string", paths.survives_pruning("p", F.lit("/lib"), ["private", "/lib"], []))
    assert got == [(True,), (True,), (False,), (False,)]


def test_path_parts(spark):
    assert one(spark, paths.ancestor_paths("v"), "/a/b/c.png") == ["/a", "/a/b", "/a/b/c.png"]
    assert one(spark, paths.parent_dir("v"), "/a") == "/"
    assert one(spark, paths.parent_dir("v"), "a.png") == ""
    assert one(spark, paths.file_name("v"), "a.png") == "a.png"
    assert one(spark, paths.relative_to("v", F.lit("/a")), "/a/b/c.png") == "b/c.png"
    assert not one(spark, paths.is_under("v", F.lit("/lib")), "/library/x")
    assert not one(spark, paths.is_under("v", F.lit("/r_x")), "/rAx/a")
    assert one(spark, paths.is_under("v", F.lit("/")), "/x")


def test_longest_rule(spark):
    rules = [(1, "/lib"), (2, "/lib/a"), (3, "/lib/a"), (4, "")]
    number = paths.longest_rule("p", rules)
    got = values(spark, [("/lib/a/x",), ("/lib/ab/x",), ("/library/x",)], "p string", number)
    assert got == [(3,), (1,), (4,)]
    assert one(spark, paths.longest_rule("v", rules[:2]), "/other/x") is None


def test_tokens(spark):
    query = " Foo bar　foo \t"
    assert text.split_query(query) == ["Foo", "bar", "foo"]
    assert one(spark, text.tokens(F.col("v")), query) == ["foo", "bar", "foo"]
    assert one(spark, text.trimmed(F.col("v")), query) == text.trim_query(query) == "Foo bar　foo"
    assert text.split_query("   ") == []


def test_filename_score(spark):
    def score(path, query):
        return one(spark, text.filename_score(F.col("v"), query), path)

    assert score("foo/bar baz.jpg", "bar baz") == 2.0
    assert score("foo/bar.jpg", "bar baz") == 1.0
    assert score("baz/qux.png", "bar") is None
    assert score("foo/bar.jpg", "bar bar") == 2.0
    assert score("Foo/Bar.jpg", "  FOO/bar.JPG ") == 6.0
    assert score("a_b%c.png", "_b%") == 1.0


def test_kinds(spark):
    rows = [("text",), ("vector:768",), ("vector:007",), ("vector:+5",), ("vector",), ("vector:x",), ("vector:",), ("Tags",), (None,)]
    got = spark.createDataFrame(rows, "k string").select(text.parse_kind(F.col("k")).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in got] == [("text", None), ("vector", 768), ("vector", 7), ("vector", 5), None, None, None, None, None]


def test_json_lists(spark):
    rows = [('["a","b"]',), ("[]",), ("bad",), (None,), ('["a",1]',), ("[null]",), ('["a",null]',), ('{"a":1}',), ('"a"',)]
    got = spark.createDataFrame(rows, "j string").select(json_cols.string_list(F.col("j")).alias("r")).collect()
    assert [r.r for r in got] == [["a", "b"], [], [], [], [], [], [], [], []]
    assert one(spark, json_cols.id_list(F.col("v")), "[1, 22]") == [1, 22]


def test_json_field(spark):
    rows = [('{"model_name":"wd14"}',), ('{"model_name":5}',), ('{"x":1}',), ("bad",), (None,), ('{"model_name":null}',), ("[1]",), ("5",)]
    got = spark.createDataFrame(rows, "j string").select(json_cols.string_field(F.col("j"), "model_name", "unknown").alias("r")).collect()
    assert [r.r for r in got] == ["wd14"] + ["unknown"] * 7
    assert one(spark, json_cols.object_of(model_name=F.col("v")), 'a"b') == '{"model_name":"a\\"b"}'


def test_thumbnail_size(spark):
    cases = {(4000, 3000): (256, 192), (3000, 4000): (192, 256), (1, 5000): (1, 256), (5000, 1): (256, 1), (10, 10): (256, 256), (10, 5): (256, 128)}
    got = spark.createDataFrame(list(cases), "w int, h int").select(
        "w", "h", thumbs.scaled_size(F.col("w"), F.col("h"), 256).alias("s")).collect()
    assert {(r.w, r.h): tuple(r.s) for r in got} == cases
    empty = spark.createDataFrame([(None, 5)], "w int, h int").select(thumbs.scaled_size(F.col("w"), F.col("h"), 256).alias("s"))
    assert empty.first().s is None


def test_sharded_key(spark):
    cases = {"deadbeef": "de/ad/deadbeef_256.webp", "abc": "ab/c/abc_256.webp", "ab": "ab/ab_256.webp", "a": "a/a_256.webp"}
    got = values(spark, [(h,) for h in cases], "h string", "h", thumbs.sharded_key(F.col("h"), 256))
    assert dict(got) == cases


def test_cache_locations(spark):
    schema = "mode string, folder string, root string, fallback string, writable boolean, h string"
    rows = [
        ("custom", "/own", "/import", "disable", True, "deadbeef"),
        ("custom", "", "/import", "disable", True, "deadbeef"),
        ("custom", None, "/import", "global", False, "deadbeef"),
        ("custom", "/own", "/import", None, False, "deadbeef"),
        ("disabled", None, "/import", None, True, "deadbeef"),
        ("global", "/own", "/import", None, True, "deadbeef"),
        (None, None, "/import", None, True, "deadbeef"),
    ]
    given = [F.col(c) for c in ("mode", "folder", "root", "fallback", "writable", "h")]
    key = "/de/ad/deadbeef_256.webp"
    got = values(spark, rows, schema, thumbs.write_path(*given, 256, "/g"))
    assert got == [("/own" + key,), ("/import/.thumbnails" + key,), ("/g" + key,), (None,), (None,), ("/g" + key,), ("/g" + key,)]
    reads = values(spark, rows, schema, thumbs.read_bases(F.col("mode"), F.col("folder"), F.col("root"), "/g"))
    own = ["/import/.thumbnails", "/g"]
    assert [r[0] for r in reads] == [["/own", "/g"], own, own, ["/own", "/g"], own, ["/g"], ["/g"]]
    temp = values(spark, rows, schema, thumbs.write_path(*given, 256, "/g", disable_cache=True, temporary_cache=True, temp_base="/t"))
    assert set(temp) == {("/t" + key,)}
    off = values(spark, rows, schema, thumbs.write_path(*given, 256, "/g", disable_cache=True))
    assert set(off) == {(None,)}


def test_pruning_shortcuts_equal_the_definition(spark):
    """Against the plain rule: every prefix below the root must be admitted."""
    import itertools

    names = ["a", "ab", "b", "photos", "private"]
    listed = ["/lib"] + ["/lib/" + "/".join(c) for n in (1, 2, 3) for c in itertools.product(names, repeat=n)]
    df = spark.createDataFrame([(p,) for p in listed], "p string")

    def hit(path, patterns, below):
        return any((path == q or below and path.startswith(q + "/")) if q.startswith("/") else q in path for q in patterns)

    def wanted(path, exclude, include, mode):
        steps = path.split("/")
        tested = ["/".join(steps[:i]) for i in range(3, len(steps) + 1)]
        return all(not hit(t, exclude, False) and (not include or hit(t, include, mode == "subtree")) for t in tested)

    excludes = [[], ["private"], ["/lib/a"], ["/lib/a/b", "hot"], ["/lib"], ["/"], ["lib"], [""]]
    includes = [
        [], ["photos"], ["/lib/a"], ["/lib/a", "b"], ["/lib/ab", "/lib/ab/a", "photos"], ["/lib/a", "a/b"], ["/lib/a/b", "ab"],
        ["/lib/a/b/ab", "/lib/a", "/lib/a/b"], ["/lib/b/a", "/lib", "o"], ["/lib/b/a/photos", "b/a", "/lib/b"],
    ]
    for exclude in excludes:
        cases = list(itertools.product(includes, ("strict", "subtree")))
        columns = []
        for include, mode in cases:
            lists = [F.array(*[F.lit(x) for x in items]).cast("array<string>") for items in (exclude, include)]
            columns.append(paths.survives_pruning("p", F.lit("/lib"), exclude, include, mode))
            columns.append(paths.survives_pruning("p", F.lit("/lib"), *lists, mode))
        got = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
        for i, (include, mode) in enumerate(cases):
            expected = [wanted(p, exclude, include, mode) for p in listed]
            assert [r[2 * i] for r in got] == [r[2 * i + 1] for r in got] == expected, (exclude, include, mode)


def test_times_ignore_the_session_zone(spark):
    from shoebox.functions import times

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # 02:30 on this day does not exist in that zone
        got = spark.createDataFrame([(1710037800, "2024-03-10 02:30:00.75")], "s bigint, t string").select(
            times.from_epoch(F.col("s")).cast("string").alias("a"),
            times.whole_seconds(F.col("t").cast("timestamp_ntz")).cast("string").alias("b")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == ("2024-03-10 02:30:00", "2024-03-10 02:30:00")
