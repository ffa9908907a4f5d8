"""The annotation job over a catalogue: enqueue a scope, then claim, run and record.

Every step commits the rows it changed.  A claim is committed before the model runs, so
a job that dies leaves its items running and visible, and nothing is done twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame

from shoebox.operators import annotate, browse
from shoebox.plans.ingest import stored
from shoebox.sources.catalog import Catalog

# Items a task runs a model on.
ITEMS_PER_TASK = 2_000


def enqueue(
    catalog: Catalog, requests: list[tuple[str, str]], now: Column, folder_id: int | None = None, recursive: bool = True,
    media_id: int | None = None, config_id: int | None = None,
) -> int:
    """Ask for work on one media row, on a folder, or on a folder with all below it;
    how many items were added.  Items that are pending already are not added again."""
    media = catalog.read("media")
    if media_id is not None:
        scope = media.where(media["id"] == media_id)
    else:
        scope = browse.scoped(media, catalog.read("folders"), folder_id, recursive)
    new = stored(annotate.new_items(catalog.read("work_items"), scope, requests, now, config_id), "new-items")
    catalog.commit(changes={"work_items": new})
    return new.count()


def run_batch(catalog: Catalog, model: annotate.Model | Mapping[str, Callable[[], annotate.Model]], size: int, now: Column) -> dict:
    """Claim the oldest ``size`` runnable items, run the model, or that of their kind, on them
    and record what it gave; counts of done and failed.  Nothing left to claim gives zeros."""
    media = catalog.read("media")
    batch = stored(annotate.next_batch(catalog.read("work_items"), media, size), "claimed")
    claimed = stored(annotate.claim(batch, media, size, now), "running")
    catalog.commit(changes={"work_items": claimed})
    # the tables' files are few and uneven, so the work is dealt by the number of items
    tasks = max(1, -(-claimed.count() // ITEMS_PER_TASK))
    outcomes = stored(annotate.run_models(claimed, media, model, tasks), "outcomes")
    # values of the claimed media only: everything else stays as it is
    held = catalog.read("values").join(claimed.select("media_file_id").distinct(), "media_file_id", "left_semi")
    items, values = annotate.record(claimed, held, outcomes, annotate.unknown_kinds(claimed), now)
    done = stored(items, "recorded")
    catalog.commit(changes={"work_items": done, "values": stored(values, "values")})
    counts = {r.status: r["count"] for r in done.groupBy("status").count().collect()}
    return {"done": counts.get("done", 0), "failed": counts.get("failed", 0)}
