"""Joins and orderings that hold when one key owns a large share of the rows.

Two means are used.  Joins whose left side may be skewed but that read like any
other are left to adaptive skew handling: it splits a large left partition and
repeats the right one, which covers inner, left, semi and anti joins.  Joins
where a hot key is certain by construction (the root is a prefix of every path,
one directory holds the files) are salted here, independent of settings.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.session import checkpointed

# Fewer than HOT_KEYS keys can own more than 1/HOT_KEYS of the rows, whatever the data
# size, so looking at that many is enough and bounds what is broadcast.
HOT_KEYS = 1_000
# rows one sub-key of a hot key should get
ROWS_PER_SALT = 1_000_000
# Counted rows up to which the planner may hand one side of a join whole to every task.
FEW_ROWS = 100_000


def dealt(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join whose ``rows`` have been counted: many are dealt by key, as the other
    side is, whatever the planner takes them for.  It goes by the bytes of files, and sorted
    paths take a hundred times as many in memory, in the driver's first."""
    return side if rows <= FEW_ROWS else side.hint("merge")


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, _salts)``: the most frequent keys, each with as many sub-keys as its own
    rows call for; keys that fit one are not listed.  Counts are combined map-side, so the
    shuffle carries one row per key and map task, and the choice is a top-k."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / ROWS_PER_SALT).cast("int")
    top = counts.orderBy(F.desc("_n"), key).limit(HOT_KEYS)
    return top.where(F.col("_n") > ROWS_PER_SALT).select(key, salts.alias("_salts"))


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str, salt_on: list[str], rows: int = 0) -> DataFrame:
    """Join many rows to a table whose ``key`` is unique, spreading hot keys.

    Left rows of a hot key are spread over its sub-keys by a hash of their own columns
    ``salt_on`` (stable, so a recomputed task lands rows in the same place), and only the
    lookup rows of hot keys are repeated.  ``how`` is one of inner, left, left_semi,
    left_anti; ``rows`` is how many ``right`` has, where that is known (``dealt``).
    """
    hot = F.broadcast(hot_keys(left, key))
    salt = F.pmod(F.xxhash64(*salt_on), F.col("_salts")).cast("int")
    spread = left.join(hot, key, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return spread.join(dealt(repeated, rows), [key, "_salt"], how).drop("_salt")


def with_position(df: DataFrame, order: list[Column] | None = None, name: str = "position") -> DataFrame:
    """Number the rows 1..n in a total order without gathering them in one task; without
    ``order``, in the order a sorted ``df`` has already.

    Range-partition and sort, pin the result with a checkpoint (so both uses see
    the same cut points), count rows per partition, and add the number of rows in
    earlier partitions to each row's place in its own.  Only one row per
    partition reaches the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    # monotonically_increasing_id holds the partition in the upper bits and the
    # row's place inside the partition in the lower 33
    pinned = checkpointed(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part, place = F.shiftright(F.col("_mid"), 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = pinned.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()
    starts, before = [], 0
    for row in sorted(counts, key=lambda r: r["_part"]):
        starts.append((row["_part"], before))
        before += row["_n"]
    # from Arrow columns: a list of rows would be read by Python workers of a daemon of its own
    part_of, start_of = (pa.array([s[k] for s in starts], pa.int64()) for k in (0, 1))
    offsets = df.sparkSession.createDataFrame(pa.table({"_part": part_of, "_start": start_of}))
    numbered = pinned.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_start") + place + 1).drop("_mid", "_part", "_start")
