"""Pollers: new files by name and new snapshots by id, with what was processed kept where the consumer keeps its results."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.naming import FileMeta
from lakemill.operators.incremental import Conflict, Target
from lakemill.plans.log import Snapshot
from lakemill.plans.table import LakeTable
from lakemill.sources import files as loose
from lakemill.stats import counters

POLL_S, OFFSET_MS, QUEUE, KEEP_ROWS = 30, 600_000, 5, 100
STATE = "process_name string, file_name string, file_type string, file_timestamp timestamp, processed_at timestamp"


# -- relations over the state: what the poller asks of ``files_processed``


def latest(state: DataFrame) -> DataFrame:
    """Greatest ``file_timestamp`` per process and file type."""
    return state.groupBy("process_name", "file_type").agg(F.max("file_timestamp").alias("latest"))


def unprocessed(listing: DataFrame, state: DataFrame, process: str | None = None) -> DataFrame:
    """Rows of ``listing`` (``process_name, file_name`` and more) that the state doesn't have."""
    done = state.select("process_name", "file_name").distinct()
    if process is not None:
        listing, done = listing.where(F.col("process_name") == process), done.where(F.col("process_name") == process)
    return listing.join(done, ["process_name", "file_name"], "left_anti")


def retained(state: DataFrame, offset_ms: int = OFFSET_MS, keep: int = KEEP_ROWS, now: datetime | None = None) -> DataFrame:
    """What stays of the state of each (process, file type): rows not older than both the offset and the (keep+1)-th newest.

    The (keep+1)-th newest time is found from counts per time, largest first, without ranking single rows. Groups of at most
    ``keep`` rows stay whole.
    """
    now = now or datetime.now(UTC)
    keys = ["process_name", "file_type"]
    from lakemill.operators.ordered import Scan, scan

    per = state.groupBy(*keys, "file_timestamp").agg(F.count(F.lit(1)).alias("n"))
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(file_timestamp as timestamp_ntz))")
    per = per.withColumn("__o", -micros).withColumn("__slice", F.floor(F.col("__o") / 86_400_000_000))
    ranked = scan(per, keys, "__slice", ["__o"], [Scan("newer", "n", "sum", "before")])
    cut = ranked.where((F.col("newer") <= keep) & (F.col("newer") + F.col("n") > keep)).select(*keys, F.col("file_timestamp").alias("at_keep"))
    floor = datetime.fromtimestamp(now.timestamp() - offset_ms / 1000, UTC)
    limit = F.least(F.col("at_keep"), F.lit(floor.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(state.schema["file_timestamp"].dataType))
    return state.join(cut, keys, "left").where(F.col("at_keep").isNull() | (F.col("file_timestamp") >= limit)).drop("at_keep")


@dataclass(frozen=True)
class Lookback:
    """Where listing begins: after ``start_ms``, or at most ``most_ms`` before now; later if the state is, less the offset."""

    start_ms: int | None = None
    most_ms: int | None = None

    def after(self, latest_ms: int | None, now_ms: int, offset_ms: int = OFFSET_MS) -> int:
        base = self.start_ms if self.start_ms is not None else now_ms - (self.most_ms or 0)
        return base if latest_ms is None else max(base, latest_ms - offset_ms)


@dataclass
class FilePoller:
    """Hands each new file of a prefix to ``consume(meta, rows)`` and records it in the same target version.

    ``consume`` returns the rows to keep (or None); they and the record of the files are published together, so a failed turn
    repeats and a finished one never does. ``rows`` reads what was published. Pollers of other processes and prefixes may share
    the state; of two that take the same file, one publishes and the other's turn is a ``Conflict``. A file that can't be read,
    or that ``consume`` fails on, goes to ``failed`` and is tried again next turn, whatever its time, up to ``attempts`` times.
    ``failed`` (key -> attempts and the last error) is stored with the state, so the next instance goes on with it. Compacted
    files are not new data.
    """

    spark: SparkSession
    root: str
    prefix: str
    process: str
    state_path: str
    consume: Callable[[FileMeta, DataFrame], DataFrame | None]
    lookback: Lookback = Lookback(start_ms=0)
    offset_ms: int = OFFSET_MS
    attempts: int = 3
    failed: dict[str, tuple[int, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.state = Target(self.spark, self.state_path, ["process_name", "file_name"], "file_timestamp")

    def rows(self) -> DataFrame | None:
        """What ``consume`` returned for all files processed; None if it returned no rows yet."""
        parts = self.state.manifest()[1].get("rows", {}).get(self._label, [])
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.state_path}/data/{p}" for p in parts]) if parts else None

    @property
    def _label(self) -> str:
        return f"{self.prefix}:{self.process}"

    def _publish(self, seen: int, good: list[FileMeta], parts: list[str], tried: list[FileMeta]) -> None:
        """The record of the files, the rows of ``parts`` and ``failed`` as one version; ``seen``: the version that the turn began with."""
        at = datetime.now(UTC)
        record = lambda files: self.spark.createDataFrame([(self.process, f.key, self.prefix, datetime.fromtimestamp(f.millis / 1000, UTC), at) for f in files], STATE)
        done = record(good)
        while True:
            n, m = self.state.manifest()
            if n != seen and unprocessed(record(tried), self.state.read(n)).count() < len(tried):
                raise Conflict(f"files of {self._label} were taken by another poller")
            rows, failed = m.get("rows", {}), m.get("failed", {})
            beside = {"rows": rows | {self._label: [*rows.get(self._label, []), *parts]}, "failed": failed | {self._label: self.failed}}
            try:
                self.state.run(done, beside=beside, onto=n)
                return
            except Conflict:
                continue  # another poller published first

    def poll(self, now_ms: int | None = None) -> list[FileMeta]:
        """One turn; the files processed."""
        now_ms = now_ms or int(time.time() * 1000)
        seen, m = self.state.manifest()
        if self._label in m.get("failed", {}):
            self.failed = {k: (n, why) for k, (n, why) in m["failed"][self._label].items()}
        state = self.state.read()
        mine = state.where((F.col("process_name") == self.process) & (F.col("file_type") == self.prefix)) if state is not None else None
        newest = mine.agg(F.max(F.unix_millis("file_timestamp"))).first()[0] if mine is not None else None
        after = self.lookback.after(newest, now_ms, self.offset_ms)
        again = {k for k, (n, _) in self.failed.items() if n < self.attempts}
        found = [f for f in loose.list_files(self.spark, self.root, self.prefix) if not f.compacted and (f.millis > after or f.key in again)]
        if mine is not None and found:
            listing = self.spark.createDataFrame([(self.process, f.key) for f in found], "process_name string, file_name string")
            new = {r["file_name"] for r in unprocessed(listing, mine).collect()}  # of the listing, not of the state
            found = [f for f in found if f.key in new]
        bad = loose.check_sizes(self.spark, [f.key for f in found])
        good, parts, tried = [], [], []
        for f in found:
            tries = self.failed.get(f.key, (0, ""))[0]
            if tries >= self.attempts:
                continue
            tried.append(f)
            try:
                if f.key in bad:
                    raise loose.BadParquet(bad[f.key])
                kept = self.consume(f, loose.read(self.spark, [f.key]))
                if kept is not None:
                    parts.append(self.state.stage(kept))
                good.append(f)
                self.failed.pop(f.key, None)
                counters.add("poller.files", 1, self.process)
                counters.set("poller.latest_ms", f.millis, self.process)
                counters.set("poller.latency", now_ms / 1000 - f.millis / 1000, self.process)
            except Exception as e:
                self.failed[f.key] = (tries + 1, str(e)[:300])
        if tried:
            try:
                self._publish(seen, good, parts, tried)
            except Conflict:  # after other errors the version may be there: what no version names does no harm
                for p in parts:
                    self.state.storage.delete(f"{self.state_path}/data/{p}")
                raise
        return good

    def clean(self, now: datetime | None = None, keep: int = KEEP_ROWS) -> None:
        """Drops from the state what no later turn can ask for (see ``retained``)."""
        n, _ = self.state.manifest()
        if n:
            self.state.replace(retained(self.state.read(n), self.offset_ms, keep, now), onto=n)

    def run(self, stop, every: float = POLL_S) -> None:  # noqa: ANN001
        while not stop.is_set():
            self.poll()
            stop.wait(every)


def stream_files(spark: SparkSession, root: str, prefix: str, schema, per_trigger: int = QUEUE) -> DataFrame:  # noqa: ANN001
    """New files of exactly one prefix as a streaming DataFrame; progress is in the query's checkpoint.

    Compacted files are not new data: a glob's ``*`` would span the dot of ``.c``, so the digits are spelled out.
    """
    millis = ",".join("[0-9]" * n for n in range(1, 19))  # as many as ``naming.PATTERN`` allows
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{prefix}.{{{millis}}}.parquet").option("maxFilesPerTrigger", per_trigger).parquet(root)


@dataclass
class Delta:
    """What is new in a table; ``ack`` once it is safe, or the same is given again."""

    snapshot: Snapshot
    rows: DataFrame
    acked: bool = False

    def ack(self) -> None:
        self.acked = True


class SnapshotPoller:
    """Deltas of a table, one outstanding at a time: at least once, in order, without gaps.

    The first delta is the whole current snapshot unless ``start_after`` is given.
    """

    def __init__(self, table: LakeTable, start_after: int | None = None) -> None:
        self.table, self.last, self.out = table, start_after, None

    def poll(self) -> Delta | None:
        """The next delta; the outstanding one again if it wasn't acknowledged; None if nothing is new."""
        if self.out is not None:
            if not self.out.acked:
                return self.out
            self.last, self.out = self.out.snapshot.id, None
        now = self.table.current()
        if now is None or now.id == self.last:
            return None
        rows = self.table.scan(snapshot_id=now.id) if self.last is None else self.table.scan_range(self.last, now.id)
        self.out = Delta(now, rows)
        return self.out

    def deltas(self) -> Iterator[Delta]:
        """Deltas until there is nothing new; each is taken as acknowledged when the next is asked for."""
        while (d := self.poll()) is not None:
            yield d
            d.ack()

    def run(self, handle: Callable[[Delta], None], stop, every: float = POLL_S, timeout: float = 30.0) -> None:  # noqa: ANN001 (a threading.Event)
        """Hands each delta to ``handle``, which acknowledges it once it is safe, until ``stop`` is set.

        A delta that isn't acknowledged comes again after ``every`` seconds. One that ``handle`` holds for longer than
        ``timeout`` ends the run with ``TimeoutError``; it stays unacknowledged, so the next run gives it again.
        """
        pool = ThreadPoolExecutor(1)
        try:
            while not stop.is_set():
                d = self.poll()
                if d is not None:
                    pool.submit(handle, d).result(timeout)
                if d is None or not d.acked:
                    stop.wait(every)
        except FutureTimeout:
            raise TimeoutError(f"a delta was held for more than {timeout} s") from None
        finally:
            pool.shutdown(wait=False)
