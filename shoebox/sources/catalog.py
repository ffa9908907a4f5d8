"""Catalogue tables as plain Parquet folders, and one small record per commit that names them.

A table is a folder with all its rows, in ranges of its key, and appended folders with
rows that took the place of older ones since.  ``fold`` joins them into one folder; when,
is for a job that has the time, not for commits, which write what changed and no more.
A record is one small file that states everything, so opening a catalogue reads the last
one; it is published by a rename that fails if another writer was first.  Readers never
see half a commit, and an open ``Catalog`` is a fixed snapshot until it commits or is
refreshed.  Folders and records that are no longer the latest are left for a retention rule.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.operators.skew import dealt
from shoebox.schemas import TABLES

KEY = {"folders": "path", "media": "absolute_path", "configs": "name", "values": "id", "work_items": "id"}
# Fixed value: the one scorer every catalogue starts with.
FILENAME_CONFIG = (1, "filename", "text", True, "{}", None)


class StaleCatalog(RuntimeError):
    """The catalogue has moved on since this handle read it."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop, self._conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._log = self._hadoop.Path(f"{self.root}/commits")
        self.refresh()

    def refresh(self) -> None:
        """Take up the latest commit: ``{version, tables: {table: [[folder, rows], ...]}, streams: {stream: batch}}``."""
        version = self._latest()
        text = self.spark.read.text(f"{self.root}/commits/v={version}.json", wholetext=True).first().value if version else None
        self.state = json.loads(text) if text else {"version": 0, "tables": {}, "streams": {}}

    def _latest(self) -> int:
        files = self._log.getFileSystem(self._conf)
        names = [at.getPath().getName() for at in files.listStatus(self._log)] if files.exists(self._log) else []
        return max((int(name[2:-5]) for name in names if name.startswith("v=")), default=0)

    def version(self) -> int:
        return self.state["version"]

    def has_batch(self, stream: str, batch: int) -> bool:
        return self.state["streams"].get(stream, -1) >= batch

    def read(self, table: str) -> DataFrame:
        """Current rows.  A catalogue that never wrote configurations has the file-name scorer."""
        schema, key, held = TABLES[table], KEY[table], self.state["tables"].get(table)
        if held is None:
            return self.spark.createDataFrame([FILENAME_CONFIG] if table == "configs" else [], schema)
        folders = [f"{self.root}/data/{table}/{folder}" for folder, _ in held]
        base = self.spark.read.schema(schema).parquet(folders[0])
        if len(folders) == 1:
            return base
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_version", T.LongType())])).parquet(*folders[1:])
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*schema.names), "_version").alias("_row")).select("_row.*")
        return replace_rows(base, latest, key, sum(n for _, n in held[1:]))

    def commit(
        self, tables: dict[str, DataFrame] | None = None, changes: dict[str, DataFrame] | None = None,
        stream: str | None = None, batch: int | None = None,
    ) -> int:
        """Publish whole tables, and rows that are new or changed (``changes``, unique by
        the table's key).  A stream names itself and the batch it has just applied.
        Nothing is overwritten: a commit from a stale handle fails and changes nothing."""
        version, folder = self.version() + 1, f"v={self.version() + 1}-{uuid.uuid4().hex}"
        if self._latest() >= version:
            raise StaleCatalog(f"version {version} of {self.root} has been committed by another handle")
        held, streams = dict(self.state["tables"]), dict(self.state["streams"])
        for table, rows in (tables or {}).items():
            ordered = rows.select(*TABLES[table].names).repartitionByRange(KEY[table]).sortWithinPartitions(KEY[table])
            held[table] = [[folder, self._written(ordered, table, folder)]]
        for table, rows in (changes or {}).items():
            if table not in held:
                held[table] = [[f"{folder}-base", self._written(self.read(table), table, f"{folder}-base")]]
            stamped = rows.select(*TABLES[table].names, F.lit(version).cast("bigint").alias("_version"))
            n = self._written(stamped, table, f"{folder}-rows")
            held[table] = held[table] + [[f"{folder}-rows", n]] * (n > 0)
        if stream is not None:
            streams[stream] = batch
        self._publish({"version": version, "tables": held, "streams": streams})
        return version

    def fold(self, *tables: str) -> int:
        """Write tables anew, each as one folder without appended rows."""
        return self.commit({table: self.read(table) for table in tables})

    def _written(self, rows: DataFrame, table: str, folder: str) -> int:
        path = f"{self.root}/data/{table}/{folder}"
        rows.write.mode("error").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).count()

    def _publish(self, state: dict) -> None:
        draft, record = (self._hadoop.Path(self._log, name) for name in (f"_{uuid.uuid4().hex}", f"v={state['version']}.json"))
        out = self._log.getFileSystem(self._conf).create(draft, False)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        choices = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(self._conf).rename(draft, record, choices)
        except Py4JJavaError as problem:
            if "FileAlreadyExistsException" not in problem.java_exception.getClass().getName():
                raise
            raise StaleCatalog(f"version {state['version']} of {self.root} has been committed by another handle") from problem
        self.state = state


def replace_rows(old: DataFrame, rows: DataFrame, key: str, n: int) -> DataFrame:
    """Old rows with ``rows``, ``n`` at most, put in their place, matched by a unique key."""
    return old.join(dealt(rows.select(key), n), key, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns))
