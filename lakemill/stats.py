"""Counts and timings by name and label, kept in the process and read as rows; batches add theirs through observations."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: What is counted, by whom: pollers, uploads, sources and sinks. Times are seconds.
NAMES = (
    "poller.latency", "poller.latest_ms", "poller.files", "upload.seconds", "upload.files", "upload.bytes",
    "source.files", "source.rows", "source.errors", "source.seconds", "source.bytes", "sink.records", "sink.errors", "sink.rotations", "sink.batch_rows",
)


class Counters:
    def __init__(self) -> None:
        self.lock = threading.Lock()
        self.values: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0, 0.0])

    def add(self, name: str, value: float = 1, label: str | None = None) -> None:
        """Adds to a counter; a label of None is left out."""
        with self.lock:
            x = self.values[name, label or ""]
            x[0] += 1
            x[1] += value

    def set(self, name: str, value: float, label: str | None = None) -> None:
        with self.lock:
            self.values[name, label or ""] = [1, value]

    @contextmanager
    def timed(self, name: str, label: str | None = None) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.add(name, time.monotonic() - began, label)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, label or None, int(c), float(v)) for (n, label), (c, v) in sorted(self.values.items())]
        return spark.createDataFrame(rows, "name string, label string, times long, total double")


counters = Counters()


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row count that is known once it has run."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o
