import pytest
from pyspark.sql import functions as F

from shoebox.operators import changes, skew


@pytest.fixture(autouse=True)
def small_salts(monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 400)


def test_hot_keys_are_few_and_right(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in skew.hot_keys(rows, "k").collect()] == [(7, 26)]


def test_one_rule_owns_all_paths(spark):
    paths = spark.range(2_000).select(F.concat(F.lit("/lib/"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    rules = spark.createDataFrame([(1, "/lib//"), (2, "/lib/7.png"), (3, "/x/")], "rule_no int, path string")
    got = {r.path: (r.root, r.rule_no) for r in changes.match_rules(paths, rules).collect()}
    assert len(got) == 2_000 and got.pop("/lib/7.png") == ("/lib/7.png", 2) and set(got.values()) == {("/lib", 1)}


def test_lookup_join_equals_plain_join(spark):
    left = spark.range(6_000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 900).alias("k"))
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = skew.lookup_join(left, right, "k", how, ["id"])
        plain = left.join(right, "k", how)
        assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_hot_rows_are_spread(spark):
    """No shuffle partition of the join holds a third of the rows."""
    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(20_000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = skew.lookup_join(left, right, "k", "inner", ["id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = left.join(right, "k").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 20_000 and max(sizes) < 2_500 < max(r["count"] for r in plain)


def test_positions(spark):
    rows = spark.range(5_000).select("id", (F.col("id") * 7919 % 5_000).alias("v"), F.lit("same").alias("s"))
    got = skew.with_position(rows.repartition(6), [F.col("s"), F.col("v").desc()])
    assert sorted((r.v, r.position) for r in got.collect()) == [(4_999 - i, 1 + i) for i in reversed(range(5_000))]
    empty = skew.with_position(rows.where("id < 0"), [F.col("v")])
    assert empty.count() == 0
    kept = skew.with_position(rows.orderBy(F.col("v").desc()))
    assert sorted((r.v, r.position) for r in kept.collect()) == [(4_999 - i, 1 + i) for i in reversed(range(5_000))]


def test_positions_need_no_python_on_executors(spark):
    got = skew.with_position(spark.range(100).repartition(4), [F.col("id").desc()])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan [_part" in plan and "ExistingRDD[_part" not in plan
    assert sorted((r.id, r.position) for r in got.collect()) == [(i, 100 - i) for i in range(100)]


def test_hot_folder_scope(make, spark):
    """A folder with a third of the files."""
    from shoebox.operators import browse

    folders = make.folders([{"id": 1, "path": "/r"}] + [{"id": i, "parent_id": 1, "path": f"/r/f{i}"} for i in range(2, 50)] + [{"id": 99, "path": "/x"}])
    media = make.media([{"id": i, "folder_id": 2 if i % 3 == 0 else 99 if i % 3 == 1 else 2 + i % 48, "relative_path": f"{i}"} for i in range(600)])
    wanted = sorted(r.id for r in media.where("folder_id <> 99").collect())
    assert sorted(r.id for r in browse.in_subtree(media, folders, 1).collect()) == wanted
