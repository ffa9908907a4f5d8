"""Naive UTC date-times that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoebox.schemas import timestamp


def from_epoch(seconds: Column) -> Column:
    """Whole seconds since 1970 as a naive UTC date-time."""
    return timestamp("1970-01-01 00:00:00") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def whole_seconds(ts: Column) -> Column:
    naive = ts.cast("timestamp_ntz")
    return naive - F.make_dt_interval(secs=F.extract(F.lit("SECOND"), naive) % 1)
