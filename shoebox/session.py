"""Session defaults and the one place that knows where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the routine sizing: it coalesces small shuffle
# partitions, splits skewed join partitions and swaps in a broadcast join when
# a side turns out small.  Nothing in the package hints a broadcast unless the
# side has a proven bound.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where a later step must then shuffle again
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # sessions of a busy path are merged before the shuffle, not only after it
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    # folder trees deeper or wider than the stock recursion limits
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def build_session(app: str = "shoebox", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediate tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder, since executors on other hosts
    would not see it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="shoebox-checkpoint-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
