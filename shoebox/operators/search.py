"""Multi-scorer search.

A scorer is either an expression over one media row (``RowScorer``) or a function
giving ``(media_id, score)`` rows (``FrameScorer``).  Row scorers are summed in
place while media are scanned, so the built-in file-name search is a filtered
scan and one sort.  Frame scorers are summed per media row with map-side
combining before they meet the media.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import text
from shoebox.operators.browse import browse_order, rank_order, scoped
from shoebox.schemas import SUMMARY_COLUMNS


@dataclass(frozen=True)
class RowScorer:
    """``score(query)`` is a column over media; null means no contribution."""

    name: str
    kind: str
    score: Callable[[str], Column]


@dataclass(frozen=True)
class FrameScorer:
    """``search(media, query)`` gives ``(media_id, score)``."""

    name: str
    kind: str
    search: Callable[[DataFrame, str], DataFrame]


FILENAME = RowScorer("filename", "text", lambda query: text.filename_score(F.col("relative_path"), query))


class Registry:
    """Scorers by name, in the order they were registered."""

    def __init__(self, scorers: Iterable[RowScorer | FrameScorer] = ()):
        self._scorers = {}
        for scorer in scorers:
            self.register(scorer)

    @classmethod
    def with_defaults(cls) -> Registry:
        return cls([FILENAME])

    def register(self, scorer: RowScorer | FrameScorer) -> None:
        self._scorers[scorer.name] = scorer

    def by_name(self, name: str):
        return self._scorers.get(name)

    def names(self) -> list[str]:
        return list(self._scorers)

    def __iter__(self):
        return iter(self._scorers.values())


def active_scorers(registry: Registry, enabled: Iterable[str], requested: Iterable[str]) -> list:
    """Scorers that are registered, enabled and asked for."""
    wanted = set(enabled) & set(requested)
    return [scorer for scorer in registry if scorer.name in wanted]


def active_configs(configs: DataFrame, requested: DataFrame) -> DataFrame:
    """Enabled configurations among the ``requested(name)``."""
    return configs.where("enabled").join(requested.select("name"), "name", "left_semi").select(*configs.columns)


def enabled_names(configs: DataFrame, registry: Registry) -> list[str]:
    """Names of enabled scorers that are installed: no more than there are installed."""
    return [row.name for row in configs.where("enabled").where(F.col("name").isin(registry.names())).select("name").collect()]


def contributions(media: DataFrame, scorers: list, query: str) -> DataFrame:
    """The bag of ``(media_id, score)`` rows from every scorer."""
    parts = []
    for scorer in scorers:
        if isinstance(scorer, RowScorer):
            found = media.select(F.col("id").alias("media_id"), scorer.score(query).cast("float").alias("score"))
            parts.append(found.where(F.col("score").isNotNull()))
        else:
            parts.append(scorer.search(media, query).select("media_id", F.col("score").cast("float").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def total_scores(contributed: DataFrame) -> DataFrame:
    return contributed.groupBy("media_id").agg(F.sum("score").cast("float").alias("score"))


def score_media(media: DataFrame, scorers: list, query: str) -> DataFrame:
    """Media rows some scorer contributed to, with the summed ``score``."""
    local = [s for s in scorers if isinstance(s, RowScorer)]
    remote = [s for s in scorers if isinstance(s, FrameScorer)]
    scores = [s.score(query).cast("double") for s in local]
    scored = media
    if remote:
        found = total_scores(contributions(media, remote, query)).withColumnRenamed("media_id", "id")
        scored = media.join(found.withColumnRenamed("score", "_remote"), "id", "left" if local else "inner")
        scores.append(F.col("_remote").cast("double"))
    hit = reduce(Column.__or__, [s.isNotNull() for s in scores])
    total = reduce(Column.__add__, [F.coalesce(s, F.lit(0.0)) for s in scores])
    return scored.withColumn("score", F.when(hit, total.cast("float"))).where(F.col("score").isNotNull()).drop("_remote")


def search(
    media: DataFrame, tree: DataFrame, folder_id: int, recursive: bool, query: str, scorers: list, ranked: bool = True
) -> DataFrame:
    """Summaries with ``score``, best first.  An empty query or no scorer gives
    no rows."""
    if not text.split_query(query) or not scorers:
        hits = media.select(*SUMMARY_COLUMNS, F.lit(None).cast("float").alias("score")).where(F.lit(False))
    else:
        hits = score_media(scoped(media, tree, folder_id, recursive), scorers, query).select(*SUMMARY_COLUMNS, "score")
    return hits.orderBy(*rank_order()) if ranked else hits


def search_in_catalog(
    media: DataFrame, tree: DataFrame, configs: DataFrame, registry: Registry, folder_id: int, recursive: bool,
    query: str, requested: Iterable[str],
) -> DataFrame:
    """Search with the scorers that are requested, enabled and registered."""
    scorers = active_scorers(registry, enabled_names(configs, registry), requested)
    return search(media, tree, folder_id, recursive, query, scorers)


def as_summaries(hits: DataFrame, sort: bool = True) -> DataFrame:
    """Browse rows carrying the score, switched to score order."""
    rows = hits.select(*SUMMARY_COLUMNS, F.col("score").alias("search_score"))
    return rows.orderBy(*browse_order("score", descending=True)) if sort else rows
