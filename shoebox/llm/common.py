"""Helpers shared by the corpus operators: column names, stored tables, row keys, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.session import checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], stem: str) -> str:
    """``stem``, lengthened until no column has that name (names ignore case)."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and continue from the files, so
    that neither a lost executor nor a second use computes it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, once nothing will read it any more, and have
    the driver let go of the shuffle files of what made it (it does so only when it
    collects garbage, which a driver with little to do seldom does)."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def small_batches(batches: Iterable[pa.RecordBatch], column: int = -1, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of a text column (a longer text
    alone), so that a worker holds little beside the batch it was sent, and gives back
    what Arrow no longer uses."""
    for batch in batches:
        index = batch.num_columns + column if column < 0 else column
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(index)), 0).cast(pa.int64())).to_numpy()
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(ends.searchsorted(before + most, side="right")))
            yield batch.slice(low, high - low)
            low = high
        pa.default_memory_pool().release_unused()
    give_back()


def give_back() -> None:
    """Return memory that a worker no longer uses to the system.  Workers are used again
    by later stages and would keep it beside what those need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# Rows and bytes of the batches that jobs under ``lean_batches`` send to Python, and rows of
# those they read: a reader holds the texts of a batch in one array, which doubles as it grows.
LEAN = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
}


@contextmanager
def lean_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send texts to Python in smaller batches: an executor builds every
    batch outside its heap and keeps that room.  The session's settings come back after."""
    before = {key: spark.conf.get(key) for key in LEAN}
    try:
        for key, value in LEAN.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, str(value).removesuffix("b"))


def id_text(doc_id: str) -> Column:
    """An id as text; a null id counts as empty text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    return F.crc32(F.encode(id_text(doc_id), "UTF-8")) % modulus == remainder


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable node of every node that has an edge: ``(node, root)``.

    ``edges`` has two columns of one orderable type; direction does not matter, loops
    and repeated edges are allowed.  Large-star and small-star steps alternate until
    nothing changes (Kiveris et al. 2014): every step is a minimum by key, combined
    before the shuffle, and an equi-join whose large side adaptive skew handling may
    split.  Only a count and a checksum reach the driver.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    current, mark = stored(pairs.distinct(), name), None
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: a node's larger neighbours move to its minimum
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours meet at their minimum
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(floor, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
        before, current = current, stored(small.where("u != v").distinct(), name)
        discard(before)
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
