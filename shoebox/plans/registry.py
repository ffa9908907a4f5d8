"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoebox.sources.fixtures import FIXTURE_SQL, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the fixtures.  ``sql`` may start with a comma to add
    common table expressions of its own; none means there is no SQL check."""

    def wrap(build: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Fixtures(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            head = "WITH RECURSIVE " + FIXTURE_SQL.strip()
            ORACLES[name] = head + (sql.strip() if sql.strip().startswith(",") else "\n" + sql.strip())
        return build

    return wrap
