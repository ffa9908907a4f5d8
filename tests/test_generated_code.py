"""A few queries with generated code, as users run them; the other tests interpret."""

import pytest

from shoebox.plans.queries import ORACLES, QUERIES
from tests.test_queries import DATA, canonical, duck  # noqa: F401

NAMES = ["K2_multi_scorer_search", "E2_subtree_summaries", "C5_directory_pruning", "L4_resolve", "I1_upsert_media", "J10_whole_seconds"]


@pytest.fixture
def generated(spark):
    wanted = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", [n for n in NAMES if n in QUERIES])
def test_query_matches_sql_in_generated_code(generated, duck, name):  # noqa: F811
    df = QUERIES[name](generated, DATA)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLES[name])
    assert got == canonical(cursor.fetchall(), [c[0] for c in cursor.description])
