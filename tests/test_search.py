from pyspark.sql import functions as F

from shoebox.operators import hierarchy, search


def library(make):
    folders = make.folders([{"id": 1, "path": "/tmp/root"}, {"id": 2, "parent_id": 1, "path": "/tmp/root/child"}])
    media = make.media([
        {"id": 1, "folder_id": 1, "relative_path": "foo/bar.jpg"}, {"id": 2, "folder_id": 1, "relative_path": "baz/qux.png"},
        {"id": 3, "folder_id": 2, "relative_path": "foo/bar baz.jpg", "is_present": False},
    ])
    return media, hierarchy.closure(folders)


def run(make, query, recursive=True, scorers=(search.FILENAME,)):
    media, tree = library(make)
    return [(r.id, r.score) for r in search.search(media, tree, 1, recursive, query, list(scorers)).collect()]


def test_filename_search(make):
    assert run(make, "bar", recursive=False) == [(1, 1.0)]
    assert run(make, "bar baz") == [(3, 2.0), (2, 1.0), (1, 1.0)]
    assert run(make, "FOO/bar.jpg") == [(1, 6.0)]
    assert run(make, "  ") == run(make, "") == run(make, " ") == []
    assert run(make, "bar", scorers=()) == []


def test_scorers_add_up(make):
    def constant(name, ids):
        def found(media, query):
            return media.where(F.col("id").isin(ids)).select(F.col("id").alias("media_id"), F.lit(1.0).alias("score"))

        return search.FrameScorer(name, "text", found)

    registry = search.Registry([constant("alpha", [1, 2]), constant("beta", [2])])
    assert registry.names() == ["alpha", "beta"] and registry.by_name("beta").kind == "text" and registry.by_name("x") is None
    assert run(make, "x", scorers=registry) == [(2, 2.0), (1, 1.0)]
    assert run(make, "foo/bar", scorers=[search.FILENAME, *registry]) == [(2, 2.0), (1, 2.0), (3, 1.0)]
    both = search.active_scorers(registry, ["alpha"], ["alpha", "beta"])
    assert [s.name for s in both] == ["alpha"] and search.active_scorers(registry, ["beta"], ["alpha"]) == []


def test_catalog_search_respects_configs(make, spark):
    media, tree = library(make)
    configs = spark.createDataFrame([("filename", True), ("other", False)], "name string, enabled boolean")
    registry = search.Registry.with_defaults()
    hits = search.search_in_catalog(media, tree, configs, registry, 1, True, "bar", ["filename", "other"])
    assert [r.id for r in hits.collect()] == [3, 1]
    assert search.search_in_catalog(media, tree, configs.where("name = 'other'"), registry, 1, True, "bar", ["filename"]).count() == 0
    shown = search.as_summaries(hits).collect()
    assert [(r.id, r.search_score) for r in shown] == [(3, 1.0), (1, 1.0)]


def test_filename_search_needs_no_exchange_but_the_sort(make, spark):
    media, tree = library(make)
    scored = search.score_media(media, [search.FILENAME], "bar baz")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
