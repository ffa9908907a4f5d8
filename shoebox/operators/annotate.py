"""Annotation work-list and values."""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions import json_cols
from shoebox.operators.changeset import delete_where, merged, update_where
from shoebox.operators.skew import with_position

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The kinds of work a model can be asked for.
MODEL_KINDS = ("tagger", "classifier", "visionlanguage")
# The largest batch that is picked by a top-k, which one task holds.
TOP_K = 10_000


def upsert_values(values: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Set ``value_json`` per (media, config); a replaced value keeps its id and
    creation time."""
    key = ["media_file_id", "searchable_config_id"]
    set_now = {"value_json": F.col("new_value_json"), "updated_at": now}
    return merged(values, new.select(*key, "value_json"), key, set_now, {"id": F.xxhash64(*key), "created_at": now})


def delete_values_of_media(values: DataFrame, media_ids: DataFrame) -> DataFrame:
    return delete_where(values, media_ids.select(F.col("id").alias("media_file_id")), ["media_file_id"])


def delete_values_of_configs(values: DataFrame, config_ids: DataFrame) -> DataFrame:
    return delete_where(values, config_ids.select(F.col("id").alias("searchable_config_id")), ["searchable_config_id"])


def model_params(model: Column) -> Column:
    return json_cols.object_of(model_name=model)


def model_name(params: Column) -> Column:
    return json_cols.string_field(params, "model_name", "unknown")


def new_items(
    items: DataFrame, media: DataFrame, requests: list[tuple[str, str]], now: Column, config_id: int | None = None
) -> DataFrame:
    """Work items to add: one per present media row and requested (kind, params)
    pair, except where the same item is pending already.  Items in any other
    state do not block.  The pairs are a literal list, so targets are fanned out
    in place; media ids are unique, so distinct pairs give distinct items."""
    pairs = list(dict.fromkeys(requests))
    wanted = F.array(*[F.struct(F.lit(kind).alias("job_kind"), F.lit(params).alias("params_json")) for kind, params in pairs])
    targets = media.where("is_present").select(F.col("id").alias("media_file_id"), F.inline(wanted))
    key = ["media_file_id", "job_kind", "params_json"]
    pending = items.where(F.col("status") == "pending").select(*key)
    fresh = targets.join(pending, key, "left_anti")
    return fresh.select(
        F.xxhash64(*key, now.cast("string")).alias("id"), "media_file_id",
        F.lit(config_id).cast("bigint").alias("searchable_config_id"), "job_kind", "params_json",
        F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("attempts"), F.lit(None).cast("string").alias("error"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def enqueue(
    items: DataFrame, media: DataFrame, requests: list[tuple[str, str]], now: Column, config_id: int | None = None
) -> DataFrame:
    return items.unionByName(new_items(items, media, requests, now, config_id))


def runnable(items: DataFrame, media: DataFrame) -> DataFrame:
    """Pending items of media that are present."""
    there = media.where("is_present").select(F.col("id").alias("media_file_id"))
    return items.where(F.col("status") == "pending").join(there, "media_file_id", "left_semi").select(*items.columns)


def next_batch(items: DataFrame, media: DataFrame, size: int) -> DataFrame:
    """The oldest ``size`` runnable items: a top-k, not a sort.  A batch too large for one
    task is cut from items numbered in ranges and stays in them."""
    ready = runnable(items, media)
    if size <= TOP_K:
        return ready.orderBy("created_at", "id").limit(size)
    place = "_place"
    numbered = with_position(ready, [F.col("created_at"), F.col("id")], place)
    return numbered.where(F.col(place) <= size).select(*items.columns)


def claim(items: DataFrame, media: DataFrame, size: int, now: Column) -> DataFrame:
    """Items with the next batch set to running."""
    batch = next_batch(items, media, size).select("id")
    return update_where(items, batch, ["id"], status=F.lit("running"), updated_at=now)


def complete(items: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return update_where(items, ids.select("id"), ["id"], status=F.lit("done"), updated_at=now)


def fail(items: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """``failures(id, error)``; attempts only count, nothing is retried."""
    return update_where(
        items, failures.select("id", "error"), ["id"], status=F.lit("failed"), attempts=F.col("attempts") + 1,
        error=F.col("new_error"), updated_at=now,
    )


def unknown_kinds(items: DataFrame) -> DataFrame:
    """``(id, error)`` for items no model can take."""
    return items.where(~F.col("job_kind").isin(*MODEL_KINDS)).select(
        "id", F.concat(F.lit("unknown job kind: "), F.col("job_kind")).alias("error")
    )


def backlog(items: DataFrame) -> DataFrame:
    return items.where(F.col("status").isin("pending", "running")).agg(F.count(F.lit(1)).alias("n"))


def backlog_by_kind(items: DataFrame) -> DataFrame:
    return items.where(F.col("status").isin("pending", "running")).groupBy("job_kind").agg(F.count(F.lit(1)).alias("n"))


Model = Callable[[pd.DataFrame], pd.Series]


def run_models(
    claimed: DataFrame, media: DataFrame, model: Model | Mapping[str, Callable[[], Model]], tasks: int | None = None
) -> DataFrame:
    """Call the model on the media of claimed items, in Arrow batches.

    A model gets a frame with the item and media columns and returns one JSON
    text per row.  A batch that raises is halved, so one bad row fails alone.  Result: ``(id, media_file_id, searchable_config_id, value_json, error)``.

    ``model`` is one model for all kinds of work, or by kind a function that loads one.  A
    model is loaded when a task meets the first item of its kind, once a task; where that
    fails, or a kind has none, its items fail and the others go on.
    """

    def attempt(model, pdf):
        """Values and errors; a batch that raises is halved until the bad rows stand alone."""
        try:
            return list(model(pdf)), [None] * len(pdf)
        except Exception as problem:
            if len(pdf) == 1:
                return [None], [str(problem)]
            half = len(pdf) // 2
            first, second = attempt(model, pdf.iloc[:half]), attempt(model, pdf.iloc[half:])
            return first[0] + second[0], first[1] + second[1]

    def load(kind):
        """The model of a kind, or why there is none."""
        if callable(model):
            return model, None
        if kind not in model:
            return None, f"no model for kind: {kind}"
        try:
            return model[kind](), None
        except Exception as problem:
            return None, f"cannot load {kind}: {problem}"

    def work(batches):
        loaded = {}
        for pdf in batches:
            for kind, part in [(None, pdf)] if callable(model) else pdf.groupby("job_kind"):
                if kind not in loaded:
                    loaded[kind] = load(kind)
                ready, missing = loaded[kind]
                out = part[["id", "media_file_id", "searchable_config_id"]].reset_index(drop=True)
                out["searchable_config_id"] = out["searchable_config_id"].astype("Int64")
                if missing:
                    out["value_json"], out["error"] = None, missing
                else:
                    out["value_json"], out["error"] = attempt(ready, part) if len(part) else ([], [])
                yield out

    known = claimed.where(F.col("job_kind").isin(*MODEL_KINDS))
    work_rows = known.select(
        "id", "media_file_id", "searchable_config_id", "job_kind", model_name(F.col("params_json")).alias("model_name")
    ).join(
        media.select(F.col("id").alias("media_file_id"), "relative_path", "absolute_path", "content_hash", "format", "file_size"),
        "media_file_id",
    )
    spread = work_rows.repartition(tasks, "id") if tasks else work_rows
    return spread.mapInPandas(
        work, "id bigint, media_file_id bigint, searchable_config_id bigint, value_json string, error string"
    )


def record(items: DataFrame, values: DataFrame, outcomes: DataFrame, rejected: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Write model outcomes and unknown kinds back: new items, new values.
    Pass ``outcomes`` that are already written or checkpointed, else the model
    runs once per consumer."""
    good = outcomes.where(F.col("error").isNull())
    failures = outcomes.where(F.col("error").isNotNull()).select("id", "error").unionByName(rejected)
    after = fail(complete(items, good, now), failures, now)
    storable = good.where(F.col("searchable_config_id").isNotNull() & F.col("value_json").isNotNull())
    latest = storable.groupBy("media_file_id", "searchable_config_id").agg(F.max_by("value_json", "id").alias("value_json"))
    return after, upsert_values(values, latest, now)
