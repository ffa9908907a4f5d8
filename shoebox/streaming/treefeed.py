"""File trees as streams of change events: a streaming data source that polls.

Each trigger is one poll, and an offset names the listing taken at it.  A partition is one
directory (of the first levels alone, of the last one with all below it); its task
walks the directory in order, merges what it finds with its listing of the poll before,
and yields what was created, modified or removed.  Listings lie in a folder that all
executors share, one file per directory and poll, and are put in place at once, so a task that runs
again yields the same.  What cannot be listed is reported and removes nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shoebox.schemas import CHANGE_EVENTS
from shoebox.session import checkpoint_root
from shoebox.sources.imports import with_clean_root

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "file_tree"
EVENTS = "event_id bigint, ts timestamp_ntz, path string, event_kind string, path_exists boolean, is_dir boolean, root string, error string"


class Folder(InputPartition):
    """One directory's share of a poll; ``problem`` says why there is none."""

    def __init__(self, path: str, deep: bool, start: int, end: int, beat: bool = False, problem: str | None = None):
        self.path, self.deep, self.start, self.end, self.beat, self.problem = path, deep, start, end, beat, problem


def place(state: str, folder: str) -> str:
    return os.path.join(state, hashlib.sha256(folder.encode("utf-8", "surrogateescape")).hexdigest())


def listings(where: str) -> list[int]:
    try:
        return sorted(int(name) for name in os.listdir(where) if name.isdigit())
    except FileNotFoundError:
        return []


def walk(folder: str, deep: bool, failed: list[str]) -> Iterator[tuple[str, int, int]]:
    """``(path, size, mtime)`` of files in the order of their path's parts; a folder that
    fails is noted.  One directory's entries are held at a time, per level."""

    def entries(path):
        try:
            return iter(sorted(os.scandir(path), key=lambda e: e.name))
        except OSError:
            failed.append(path)
            return iter(())

    open_ = [entries(folder)]
    while open_:
        entry = next(open_[-1], None)
        if entry is None:
            open_.pop()
            continue
        try:
            if entry.is_dir(follow_symlinks=False):
                if deep:
                    open_.append(entries(entry.path))
            elif entry.is_file():
                found = entry.stat()
                yield entry.path, found.st_size, found.st_mtime_ns
        except OSError:
            failed.append(entry.path)


def merged(old: Iterator, new: Iterator, failed: list[str]) -> Iterator[tuple[str | None, list]]:
    """``(what happened, row to remember)`` from two listings in order."""
    key = lambda row: row[0].split("/")
    was, now = next(old, None), next(new, None)
    while was is not None or now is not None:
        if was is None or (now is not None and key(now) < key(was)):
            yield "create", list(now)
            now = next(new, None)
        elif now is None or key(was) < key(now):
            # what a failed directory held is kept
            lost = any(was[0] == f or was[0].startswith(f.rstrip("/") + "/") for f in failed)
            yield (None if lost else "remove"), list(was)
            was = next(old, None)
        else:
            yield ("modify" if list(was[1:]) != list(now[1:]) else None), list(now)
            was, now = next(old, None), next(new, None)


class TreeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/") or "/"
        self.state = options["state"]
        self.deep = options.get("recursive", "true").lower() == "true"
        self.levels = int(options.get("levels", "1")) if self.deep else 0

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        span = start["poll"], end["poll"]
        if not os.path.isdir(self.root):
            return [Folder(self.root, False, *span, beat=True, problem="not reachable")]
        folders, level = [], [self.root]
        for depth in range(self.levels + 1):
            folders += [(path, depth == self.levels and self.deep) for path in level]
            below = []
            for path in level if depth < self.levels else []:
                try:
                    below += [e.path for e in os.scandir(path) if e.is_dir(follow_symlinks=False)]
                except OSError:
                    pass  # its own partition reports it
            level = below
        known = {path for path, _ in folders}
        parts = [Folder(path, deep, *span, beat=path == self.root) for path, deep in folders]
        for path in self._remembered():
            # a folder that is gone has a last listing to empty, one that failed is kept
            if path not in known and not os.path.lexists(path):
                parts.append(Folder(path, True, *span))
        return parts

    def _remembered(self) -> list[str]:
        found = []
        for name in os.listdir(self.state) if os.path.isdir(self.state) else []:
            try:
                with open(os.path.join(self.state, name, "folder")) as f:
                    found.append(json.load(f))
            except OSError:
                continue
        return found

    def commit(self, end: dict) -> None:
        """Listings that no poll will start from are deleted."""
        for path in self._remembered():
            where = place(self.state, path)
            for poll in [p for p in listings(where) if p <= end["poll"]][:-1]:
                os.remove(os.path.join(where, str(poll)))

    def read(self, part: Folder) -> Iterator[tuple]:
        stamp = datetime.fromtimestamp(part.end / 1000, UTC).replace(tzinfo=None)

        def event(path, kind, exists, is_dir=False, error=None):
            number = int.from_bytes(hashlib.sha256(f"{part.end}:{kind}:{path}".encode("utf-8", "surrogateescape")).digest()[:8], "big", signed=True)
            name = os.fsencode(path).decode("utf-8", "replace")
            return number, stamp, name, kind, exists, is_dir, self.root, error

        if part.beat:
            yield event("", "heartbeat", False)
        if part.problem:
            yield event(self.root, "error", False, True, part.problem)
            return
        where = place(self.state, part.path)
        os.makedirs(where, exist_ok=True)
        before = [p for p in listings(where) if p <= part.start]
        failed: list[str] = []
        gone = not os.path.lexists(part.path)
        new = iter(()) if gone else walk(part.path, part.deep, failed)
        work = os.path.join(where, f"work-{os.getpid()}-{time.time_ns()}")
        old_file = open(os.path.join(where, str(before[-1]))) if before else None
        try:
            old = (json.loads(line) for line in old_file) if old_file else iter(())
            with open(work, "w") as out:
                for kind, row in merged(old, new, failed):
                    # the first poll of all only takes stock
                    if kind and part.start:
                        yield event(row[0], kind, kind != "remove")
                    if kind != "remove":
                        out.write(json.dumps(row) + "\n")
        finally:
            if old_file:
                old_file.close()
        for path in failed:
            yield event(path, "error", True, True, "cannot be listed")
        with open(work + "-folder", "w") as out:
            json.dump(part.path, out)
        os.replace(work + "-folder", os.path.join(where, "folder"))
        os.replace(work, os.path.join(where, str(part.end)))


class TreeFeed(DataSource):
    """``spark.readStream.format("file_tree")`` with the options ``path`` and ``state``, and
    ``recursive`` and ``levels`` (how many levels of directories are tasks of their own)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeReader(self.options)


def watch(spark: SparkSession, imports: list[dict], state: str | None = None, levels: int = 1) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The events of several imports as one stream, and the imports that cannot be
    watched from the start with the reason; the others go on.  A root that vanishes
    later gives a row of kind ``error`` at every poll and no removals.  ``state`` is
    a folder that executors reach by its path, as they do the trees."""
    spark.dataSource.register(TreeFeed)
    state = state or checkpoint_root(spark).removeprefix("file:") + "/tree-listings"
    streams, problems = None, []
    for rule in imports:
        root = with_clean_root(rule)["path"]
        if not root or not os.path.isdir(root):
            problems.append((root, "not reachable" if root else "no path configured"))
            continue
        reader = spark.readStream.format(FORMAT).option("path", root).option("state", place(state, root)).option("levels", levels)
        mine = reader.option("recursive", str(rule.get("recursive", True)).lower()).load()
        streams = mine if streams is None else streams.unionByName(mine)
    return streams, problems


def changes_only(feed: DataFrame) -> DataFrame:
    """A feed's rows as ``streaming.changes.run`` takes them."""
    return feed.where(F.col("event_kind") != "error").select(*CHANGE_EVENTS.names)
