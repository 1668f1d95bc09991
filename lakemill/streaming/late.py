"""Late and out-of-order events as a stream: each micro-batch goes through ``operators.late.advance``.

State is three keyed tables: watermarks, windows, and which (process, file) were seen, the last two by day of event time, so a
batch reads and rewrites only the days it touches and a record that comes again in a later batch counts once. A batch writes
what it changed and what it diverted, then publishes them by one atomic create under its own number, so a repeated batch
finds itself published and does nothing. Of versions, and of folders that no later one names, the last few are kept.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.operators.incremental import Conflict
from lakemill.operators.late import HOUR_MS, WINDOW, advance, arrivals, merge_windows
from lakemill.session import cut
from lakemill.sources.storage import Storage

DAY_MS = 86_400_000
WINDOWS = "process_name string, prefix string, window_start long, n_files long, bytes long, last_arrived_us long"
LATE = "process_name string, file_name string, arrived_us long, file_type string, event_ms long, prefix string, bytes long, behind_ms long"
SEEN = "process_name string, file_name string"
#: So many parts of one kind (and day) are merged into one; so many versions stay readable.
MOST_PARTS, KEPT_VERSIONS = 8, 3


class LateEvents:
    """``listing``: where raw records find their files' sizes (see ``late.arrivals``)."""

    def __init__(self, spark: SparkSession, path: str, lateness_ms: int = 6 * HOUR_MS, width_ms: int = HOUR_MS, listing: DataFrame | None = None) -> None:
        self.spark, self.path, self.lateness_ms, self.width_ms, self.listing, self.storage = spark, path, lateness_ms, width_ms, listing, Storage(spark)

    def _versions(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self.storage.names(f"{self.path}/versions") if x.endswith(".json"))

    def _version(self, n: int) -> dict:
        return json.loads(self.storage.read(f"{self.path}/versions/{n}.json"))

    def _state(self) -> tuple[int, dict]:
        n = max(self._versions(), default=-1)
        return n, self._version(n) if n >= 0 else {"late": [], "days": {}, "seen": {}}

    def take_raw(self, records: DataFrame, batch_id: int) -> None:
        """Takes a batch of raw records (``files_processed``)."""
        self.take(arrivals(records, self.listing), batch_id)

    def take(self, events: DataFrame, batch_id: int) -> None:
        """Takes a batch of ``arrivals``; batches must come in order of arrival. A batch taken before is ignored.

        An event of a (process, file) that an earlier batch had is a repetition and left out.
        """
        n, state = self._state()
        if batch_id <= n:
            return
        base = f"{self.path}/data/{batch_id}-{self.storage.unique()}"
        day = F.floor(F.col("event_ms") / DAY_MS).cast("long")
        events = cut(events)
        came = sorted(str(r[0]) for r in events.select(day).distinct().collect())  # as many as days with new events
        known = [p for d in came for p in state["seen"].get(d, [])]
        if known:
            events = cut(events.join(self.spark.read.schema(SEEN).parquet(*known), ["process_name", "file_name"], "left_anti"))
        marks = self.spark.read.parquet(state["marks"]) if "marks" in state else None
        a = advance(events, marks, None, self.lateness_ms, self.width_ms)
        a.watermarks.write.parquet(f"{base}/marks")
        a.diverted.write.parquet(f"{base}/late")
        events.select("process_name", "file_name", day.alias("day")).hint("rebalance", F.col("day")).write.partitionBy("day").parquet(f"{base}/seen")
        added = {x.removeprefix("day=") for x in self.storage.names(f"{base}/seen") if x.startswith("day=")}
        seen = state["seen"] | {d: self._few([*state["seen"].get(d, []), f"{base}/seen/day={d}"], f"{base}/seen-{d}", SEEN) for d in added}
        of = F.floor(F.col("window_start") / DAY_MS).cast("long")
        fresh = cut(a.upserts)
        touched = sorted(str(r[0]) for r in fresh.select(of).distinct().collect())
        days = dict(state["days"])
        old = [days[d] for d in touched if d in days]
        merged = cut(merge_windows(self.spark.read.schema(WINDOWS).parquet(*old) if old else None, fresh))
        merged.join(fresh.select(*WINDOW), WINDOW, "left_semi").write.parquet(f"{base}/upserts")
        merged.withColumn("day", of).hint("rebalance", F.col("day")).write.partitionBy("day").parquet(f"{base}/windows")
        days |= {d: f"{base}/windows/day={d}" for d in touched}
        new = {"marks": f"{base}/marks", "days": days, "seen": seen, "upserts": f"{base}/upserts", "late": self._few([*state["late"], f"{base}/late"], f"{base}/late-all", LATE)}
        if not self.storage.create(f"{self.path}/versions/{batch_id}.json", json.dumps(new)):
            self.storage.delete(base)
            raise Conflict(f"batch {batch_id} of {self.path} was published by another run")
        self._clean()

    def _few(self, parts: list[str], into: str, schema: str) -> list[str]:
        """The parts, or one that holds them all if they are too many."""
        if len(parts) <= MOST_PARTS:
            return parts
        self.spark.read.schema(schema).parquet(*parts).write.parquet(into)
        return [into]

    @staticmethod
    def _named(state: dict) -> set[str]:
        return {state["marks"], state["upserts"], *state["late"], *state["days"].values(), *(p for parts in state["seen"].values() for p in parts)}

    def _clean(self) -> None:
        """Drops versions before the last few with the folders that none of these names."""
        versions = self._versions()
        kept = set().union(*[self._named(self._version(n)) for n in versions[-KEPT_VERSIONS:]])
        for n in versions[:-KEPT_VERSIONS]:
            for p in self._named(self._version(n)) - kept:
                self.storage.delete(p)
            self.storage.delete(f"{self.path}/versions/{n}.json")

    def _of(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def windows(self) -> DataFrame:
        """All windows as they stand."""
        return self._of(list(self._state()[1]["days"].values()), WINDOWS)

    def upserts(self) -> DataFrame:
        """The windows that the last batch changed."""
        s = self._state()[1]
        return self._of([s["upserts"]] if "upserts" in s else [], WINDOWS)

    def late(self) -> DataFrame:
        """What was diverted so far, with how far it was behind."""
        return self._of(self._state()[1]["late"], LATE)

    def start(self, stream: DataFrame, checkpoint: str, seconds: float | None = None):  # noqa: ANN201
        """Takes a stream of raw records; without ``seconds`` what is there."""
        w = stream.writeStream.foreachBatch(self.take_raw).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()
