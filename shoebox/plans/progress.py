"""What a running scan has done so far.

Tasks add to accumulators as they go; a thread of the driver looks at them while the jobs
run and reports.  A task that runs again counts again, so figures are for people, not
for the catalogue.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession

STAGES = ("listed", "fingerprinted")


class Progress:
    """Reports ``{"stage", "files", "bytes"}`` to ``report`` each time ``every`` more files
    are done, while the block runs, and what each stage came to at its end."""

    def __init__(self, spark: SparkSession, report: Callable[[dict], None] | None, every: int = 5_000, look: float = 0.25):
        self.report, self.every, self.look = report, every, look
        accumulator = spark.sparkContext.accumulator
        self.counters = {s: (accumulator(0), accumulator(0)) for s in STAGES} if report else dict.fromkeys(STAGES)
        self.said = dict.fromkeys(STAGES, 0)
        self.over = threading.Event()

    def _look(self, least: int) -> None:
        for stage, (files, size) in self.counters.items():
            done = files.value
            if done - self.said[stage] >= least:
                self.said[stage] = done
                self.report({"stage": stage, "files": done, "bytes": size.value})

    def _watch(self) -> None:
        while not self.over.wait(self.look):
            self._look(self.every)

    def __enter__(self) -> Progress:
        if self.report:
            self.thread = threading.Thread(target=self._watch, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        if self.report:
            self.over.set()
            self.thread.join()
            self._look(1)
