"""Event-time debounce that lives across micro-batches and keeps order across them.

Every path has a small keyed state: its bursts of events, closer together than a gap,
and which of them have been passed on.  A burst is passed on once the watermark says
that it is over, as one change; a restart goes on from the stored state.  An event that
comes later than the watermark is not lost: if it belongs to the burst passed on last, that one is
corrected, if it is newer it makes a burst of its own, and if it is older than what was
passed on it only counts as ``stale``, so it never undoes anything newer.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from shoebox.operators import changes

HEARTBEAT = "heartbeat"
SETTLED = "path string, kind string, n_events bigint, first_at bigint, last_at bigint, last_id bigint, stale boolean"


def micros(length: str) -> int:
    """A length of time such as ``500 milliseconds`` in microseconds."""
    whole = pd.Timedelta(length)
    return int(whole.value // 1000)


class Burst:
    """Events of one path; ``kind`` is what its state was passed on as, if it was."""

    def __init__(self, first, last, last_id, removed, last_removed, n, sent=None):
        self.first, self.last, self.last_id, self.removed, self.last_removed, self.n, self.sent = first, last, last_id, removed, last_removed, n, sent

    def stored(self) -> list:
        return [self.first, self.last, self.last_id, self.removed, self.last_removed, self.n, self.sent]

    def joined(self, other: Burst) -> Burst:
        late, early = (self, other) if (self.last, self.last_id) >= (other.last, other.last_id) else (other, self)
        return Burst(
            min(self.first, other.first), late.last, late.last_id, self.removed or other.removed, late.last_removed, self.n + other.n, late.sent or early.sent,
        )

    def kind(self, order: str) -> str:
        return "remove" if (self.last_removed if order == "latest" else self.removed) else "upsert"


def with_bursts(bursts: list[Burst], new: list[Burst], gap: int) -> list[Burst]:
    """All bursts in order, those no further from each other than the gap joined: one sort
    and one pass, however many there are."""
    joined: list[Burst] = []
    for b in sorted([*bursts, *new], key=lambda b: b.first):
        if joined and joined[-1].last + gap >= b.first:
            joined[-1] = joined[-1].joined(b)
        else:
            joined.append(b)
    return joined


def with_burst(bursts: list[Burst], new: Burst, gap: int) -> list[Burst]:
    """Bursts in order, those no further from ``new`` than the gap joined with it."""
    return with_bursts(bursts, [new], gap)


def passed_on(bursts: list[Burst], clock: int, gap: int, order: str) -> list[tuple]:
    """Rows for bursts that are over and new or changed, marked as sent; a burst before one
    that has been sent is stale."""
    rows = []
    newest = max((b.last for b in bursts if b.sent), default=None)
    for b in bursts:
        state = [b.kind(order), b.last, b.last_id, b.n]
        if b.last + gap >= clock or b.sent == state:
            continue
        rows.append((state[0], b.n, b.first, b.last, b.last_id, newest is not None and b.last < newest))
        b.sent = state
    return rows


def settled(events: DataFrame, gap: str = "500 milliseconds", delay: str = "2 seconds", keep: str = "1 hour", order: str = "remove_wins", heif: bool = False) -> DataFrame:
    """The changes that a stream of events comes to: ``path, kind, n_events, first_ts,
    last_ts, last_id, stale``.

    ``delay`` is how far events may be out of order before a burst counts as over; what
    comes later corrects or is stale, as above.  ``keep`` is how long bursts are
    remembered after that: a path's last one until the watermark is that much past it.  Rows of kind
    ``heartbeat`` only move the clock, so that the last bursts of a quiet feed come out.
    """
    gap_us, keep_us = micros(gap), micros(keep)
    kind = changes.change_kind(heif)
    at = F.col("ts").cast("timestamp")
    # a row that keeps the clock, and one without a time that no watermark can drop
    clocks = F.when(kind.isNotNull(), F.array(F.lit(None).cast("timestamp"), at)).otherwise(F.array(at))
    timed = events.select("path", "event_id", kind.alias("kind"), F.unix_micros(at).alias("at"), F.explode(clocks).alias("clock"))
    alive = timed.withWatermark("clock", delay).where(F.col("clock").isNull())

    def step(key, batches, state):
        clock = state.getCurrentWatermarkMs() * 1000
        bursts = [Burst(*b) for b in json.loads(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            new = []
            for batch in batches:
                for when, number, what in zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["kind"].tolist(), strict=True):
                    removed = what == "remove"
                    new.append(Burst(when, when, number, removed, removed, 1))
            bursts = with_bursts(bursts, new, gap_us)
        rows = passed_on(bursts, clock, gap_us, order)
        bursts = [b for b in bursts if not b.sent or b.last + keep_us >= clock or b is bursts[-1]]
        waiting = [b.last + gap_us for b in bursts if not b.sent]
        wake = min(waiting, default=bursts[-1].last + keep_us)
        if not waiting and wake < clock:
            state.remove()
        else:
            state.update((json.dumps([b.stored() for b in bursts]),))
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        # a path with nothing to pass on costs no frame
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["path", "kind", "n_events", "first_at", "last_at", "last_id", "stale"])

    found = alive.groupBy("path").applyInPandasWithState(step, SETTLED, "bursts string", "append", GroupStateTimeout.EventTimeTimeout)
    naive = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("path", "kind", "n_events", naive("first_at").alias("first_ts"), naive("last_at").alias("last_ts"), "last_id", "stale")


def latest_of_each(settled_rows: DataFrame) -> DataFrame:
    """Of the changes of one batch, the newest that is not stale of each path."""
    order: Column = F.struct("last_ts", "last_id", "n_events")
    return settled_rows.where(~F.col("stale")).groupBy("path").agg(F.max_by("kind", order).alias("kind"))
