"""Sinks: rows in, rotated Parquet files or table commits out; nothing is visible before its commit."""

from __future__ import annotations

import bisect
import dataclasses
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakemill.functions.naming import FileMeta
from lakemill.plans.log import FileEntry
from lakemill.plans.table import LakeTable
from lakemill.plans.wap import WapTransaction
from lakemill.sources.files import check_codec
from lakemill.sources.storage import Storage
from lakemill.stats import counters


class DataWriter(Protocol):
    """Whatever takes rows and returns once they are safe."""

    def write(self, rows: Iterable[Any]) -> None: ...


class SinkClosed(RuntimeError):
    pass


@dataclass(frozen=True)
class Rotation:
    """When a file is full; rows and bytes are looked at per flushed batch."""

    max_rows: int = 100_000
    max_bytes: int = 100 << 20
    max_seconds: float = 180.0
    batch_rows: int = 1000

    def reason(self, rows: int, size: int, age: float) -> str | None:
        if rows >= self.max_rows:
            return "row_count"
        if size >= self.max_bytes:
            return "size"
        return "time" if age >= self.max_seconds else None


def _plain(row: Any) -> dict:
    return row if isinstance(row, dict) else row.asDict() if hasattr(row, "asDict") else dataclasses.asdict(row)


def _micros(seconds: float) -> int:
    return round(seconds * 1e6)


def _table(batch: pa.RecordBatch | pa.Table) -> pa.Table:
    return batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])


def file_ordinals(df: DataFrame, order: list[str], rotation: Rotation, slice_col: str | None = None) -> DataFrame:
    """The file each row of a stream would go to: ``file_no`` by row count, at batch granularity. Ordered by unique ``order``.

    Slices of the first column are counted, and their counts added up in two steps: over spans of so many slices, and over one
    row per span; rows are only numbered within their slice.
    """
    per = -(-rotation.max_rows // rotation.batch_rows) * rotation.batch_rows
    x = df.withColumn("__slice", F.floor(F.col(slice_col or order[0]) / per))
    counts = x.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n")).withColumn("__span", F.floor(F.col("__slice") / SPAN))
    spans = counts.groupBy("__span").agg(F.sum("__n").alias("__all"))
    earlier = Window.orderBy(F.col("__span").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row per SPAN slices
    spans = spans.select(F.col("__span").alias("__of"), F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__span").orderBy(F.col("__slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.join(spans, F.col("__span").eqNullSafe(F.col("__of"))).select(F.col("__slice").alias("__at"), (F.col("__before") + F.coalesce(F.sum("__n").over(within), F.lit(0))).alias("__base"))
    n = F.row_number().over(Window.partitionBy("__slice").orderBy(*order)) - 1
    return x.join(base, F.col("__slice").eqNullSafe(F.col("__at"))).withColumn("file_no", F.floor((F.col("__base") + n) / per).cast("long")).drop("__slice", "__at", "__base")


#: Slices whose counts are added up together.
SPAN = 4096


class Ticker:
    """Calls ``fn`` every ``period`` seconds in the background until stopped; what it raises is kept and raised by ``stop``."""

    def __init__(self, period: float, fn: Callable[[], None]) -> None:
        self.fn, self.period, self.ended, self.error = fn, period, threading.Event(), None
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while not self.ended.wait(self.period):
            try:
                self.fn()
            except Exception as e:
                self.error = e
                return

    def stop(self) -> None:
        self.ended.set()
        self.thread.join()
        if self.error is not None:
            raise self.error


class ParquetSink:
    """Rows to rotated files ``prefix.millis.parquet``: written aside, staged when closed, in place when committed.

    ``recover`` at start: complete staged files of this prefix are committed if ``auto_commit`` and otherwise deleted, files
    without a footer are deleted, files of other prefixes are left alone. The folders are this process's own disk, from which
    ``sources.upload`` takes finished files to a store. Every ``check_seconds`` a full or old file is rotated also when no row
    comes. Flushed batches share row groups of ``row_group`` rows, however small they are.
    """

    def __init__(self, target: str, prefix: str, schema: T.StructType | pa.Schema, rotation: Rotation = Rotation(), staging: str | None = None, codec: str = "snappy", row_group: int = 10_000, auto_commit: bool = False, clock: Callable[[], float] = time.time, check_seconds: float | None = None) -> None:
        FileMeta.name(prefix, 0)
        self.lock = threading.RLock()
        self.target, self.prefix, self.rotation, self.clock = Path(target), prefix, rotation, clock
        self.schema = schema if isinstance(schema, pa.Schema) else to_arrow_schema(schema)
        self.staging = Path(staging) if staging else self.target / "_staging"
        self.codec, self.row_group, self.auto_commit = check_codec(codec), row_group, auto_commit
        self.target.mkdir(parents=True, exist_ok=True)
        self.staging.mkdir(parents=True, exist_ok=True)
        self.parts: list[pa.Table] = []  # not flushed yet, and after them the buffer
        self.buffer: list[dict] = []
        self.group: list[pa.Table] = []  # flushed, and less than a row group yet
        self.waiting, self.grouped = 0, 0  # rows not flushed, and rows of the group
        self.open: pq.ParquetWriter | None = None
        self.staged: list[Path] = []
        self.closed, self.rotations, self._last, self._seen = False, [], 0, None
        self.recovered = self.recover()
        self.ticker = Ticker(check_seconds, self._tick) if check_seconds else None

    def _now(self) -> int:
        return _micros(self.clock())

    def _name(self, now: int) -> str:
        self._last = max(now // 1000, self._last + 1)
        while (self.target / (name := FileMeta.name(self.prefix, self._last))).exists():
            self._last += 1
        return name

    def recover(self) -> list[Path]:
        got = []
        for p in sorted(self.staging.glob(f"{self.prefix}.*.parquet*")):
            if p.name.split(".")[0] != self.prefix:
                continue
            whole = p.suffix == ".parquet"
            if whole:
                try:
                    pq.read_metadata(p)
                except Exception:
                    whole = False
            if whole and self.auto_commit:
                os.replace(p, self.target / p.name)
                got.append(self.target / p.name)
            else:
                p.unlink()
        return got

    def write(self, row: Any) -> None:
        if self.closed:
            raise SinkClosed(self.prefix)
        with self.lock:
            now = self._now()
            self.buffer.append(_plain(row))
            self.waiting += 1
            if self.waiting >= self.rotation.batch_rows:
                self.flush(now)
            self.rotate_if_due(now)

    def _tick(self) -> None:
        with self.lock:
            self.flush()
            self.rotate_if_due()

    def write_all(self, rows: Iterable[Any]) -> None:
        for r in rows:
            self.write(r)

    def write_batches(self, batches: Iterable[pa.RecordBatch | pa.Table], at: str | None = None) -> None:
        """Rows in Arrow, to the files that ``write`` would put them into one by one.

        ``at`` is a column of the clock's micros at each row, which isn't written; a null is the time of the row before.
        Without it the clock is asked once per batch.
        """
        for b in batches:
            if self.closed:
                raise SinkClosed(self.prefix)
            with self.lock:
                t = _table(b)
                self._take(t.select(self.schema.names).cast(self.schema), self._times(t, at))

    def _times(self, t: pa.Table, at: str | None) -> np.ndarray:
        if at is None or not len(t):
            return np.full(len(t), self._now(), np.int64)
        times = pc.fill_null_forward(t[at].cast(pa.int64()))
        if times.null_count:
            times = times.fill_null(self._now() if self._seen is None else self._seen)
        self._seen = times[-1].as_py()
        return times.to_numpy()

    def _take(self, t: pa.Table, times: np.ndarray) -> None:
        """Goes from rotation to rotation, not from row to row: batches without one in between are flushed together."""
        every, i = max(1, self.rotation.batch_rows), 0
        while i < len(t):
            flushes, end = range(i + max(1, every - self.waiting), len(t) + 1, every), len(t)  # counts of rows after which a batch is full
            if self.open is not None or flushes:
                first, since = (i, self.began) if self.open is not None else (flushes[0] - 1, times[flushes[0] - 1])
                old = np.flatnonzero((times[first:] - since) / 1e6 >= self.rotation.max_seconds)
                end = first + int(old[0]) + 1 if len(old) else end
            end = self._full(t, i, range(flushes.start, end + 1, every)) or end
            flushes = range(flushes.start, end + 1, every)
            if flushes:
                self._hold(t.slice(i, flushes[-1] - i))
                self.flush(int(times[flushes[0] - 1]))
                i = flushes[-1]
            if i < end:
                self._hold(t.slice(i, end - i))
                i = end
            self.rotate_if_due(int(times[end - 1]))

    def _full(self, t: pa.Table, i: int, flushes: range) -> int | None:
        """The first of ``flushes`` that fills the file by rows or bytes; ``t`` is in up to row ``i``."""
        self._pack()
        rows, size = (self.rows, self.bytes) if self.open is not None else (0, 0)
        rows, size = rows + self.waiting, size + sum(p.nbytes for p in self.parts)
        k = bisect.bisect_left(flushes, True, key=lambda stop: self.rotation.reason(rows + stop - i, size + t.slice(i, stop - i).nbytes, float("-inf")) is not None)
        return flushes[k] if k < len(flushes) else None

    def _hold(self, t: pa.Table) -> None:
        self._pack()
        self.parts.append(t)
        self.waiting += len(t)

    def _pack(self) -> None:
        if self.buffer:
            try:
                self.parts.append(pa.Table.from_pylist(self.buffer, self.schema))
            except Exception:
                counters.add("sink.errors", 1, self.prefix)
                raise
            self.buffer = []

    def flush(self, now: int | None = None) -> None:
        """What waits goes to the open file, in row groups once they are full. ``now``: the clock's micros."""
        if not self.waiting:
            return
        self._pack()
        if self.open is None:
            now = self._now() if now is None else now
            self.path = self.staging / (self._name(now) + ".tmp")
            self.open = pq.ParquetWriter(self.path, self.schema, compression=self.codec, write_page_index=True)
            self.rows, self.bytes, self.began = 0, 0, now
        n = self.waiting
        self.rows, self.bytes, self.grouped = self.rows + n, self.bytes + sum(p.nbytes for p in self.parts), self.grouped + n
        self.group += self.parts
        self.parts, self.waiting = [], 0
        counters.add("sink.records", n, self.prefix)
        counters.add("sink.batch_rows", n, self.prefix)
        self._write_group(self.grouped // self.row_group * self.row_group)

    def _write_group(self, n: int) -> None:
        if n:
            t = pa.concat_tables(self.group).combine_chunks()
            try:
                self.open.write_table(t.slice(0, n), self.row_group)
            except Exception:
                counters.add("sink.errors", 1, self.prefix)
                raise
            self.group, self.grouped = [t.slice(n)] if n < len(t) else [], self.grouped - n

    def rotate_if_due(self, now: int | None = None) -> None:
        if self.open is None:
            return
        now = self._now() if now is None else now
        if why := self.rotation.reason(self.rows, self.bytes, (now - self.began) / 1e6):
            self.flush(now)
            self._close()
            self.rotations.append(why)
            counters.add("sink.rotations", 1, self.prefix)
            if self.auto_commit:
                self.commit()

    def _close(self) -> None:
        if self.open is not None:
            self._write_group(self.grouped)
            self.open.close()
            done = self.path.with_suffix("")
            os.replace(self.path, done)
            self.staged.append(done)
            self.open = None

    def commit(self) -> list[str]:
        """Closes and publishes what was written; the paths."""
        with self.lock:
            self.flush()
            self._close()
            out = []
            for p in self.staged:
                os.replace(p, self.target / p.name)
                out.append(str(self.target / p.name))
            self.staged = []
            return out

    def rollback(self) -> list[str]:
        """Discards what was not committed; the paths that were."""
        with self.lock:
            self.buffer, self.parts, self.group, self.waiting, self.grouped = [], [], [], 0, 0
            self._close()
            out = [str(p) for p in self.staged]
            for p in self.staged:
                p.unlink(missing_ok=True)
            self.staged = []
            return out

    def close(self) -> list[str]:
        if self.ticker is not None:
            self.ticker.stop()
        out = self.commit() if self.auto_commit else (self.flush(), self._close(), [str(p) for p in self.staged])[2]
        self.closed = True
        return out


def write_files(df: DataFrame, target: str, max_rows: int = 100_000, codec: str = "snappy", row_group: int = 10_000) -> None:
    """A whole DataFrame as rotated files, in parallel: at most ``max_rows`` rows per file, ``row_group`` per group."""
    df.write.option("compression", check_codec(codec)).option("maxRecordsPerFile", max_rows).option("parquet.block.row.count.limit", row_group).mode("append").parquet(target)


class Wal:
    """Write-ahead records of table commits in a folder of any store: one file each, with the label as a field."""

    def __init__(self, storage: Storage, folder: str) -> None:
        self.storage, self.folder = storage, folder.rstrip("/")

    def record(self, label: str, location: str, branch: str, entries: list[FileEntry], wap_id: str | None = None, publish: bool = False) -> str:
        p = f"{self.folder}/{uuid.uuid4().hex}.wal"
        head = {"label": label, "table": location, "branch": branch, "wap_id": wap_id, "publish": publish}
        self.storage.create(p, "\n".join(json.dumps(x, default=str) for x in [head, *map(dataclasses.asdict, entries)]))
        return p

    def done(self, record: str) -> None:
        self.storage.delete(record)

    def pending(self, label: str) -> list[tuple[str, dict, list[FileEntry]]]:
        out = []
        for name in self.storage.names(self.folder):
            if name.endswith(".wal") and not name.startswith("."):
                p = f"{self.folder}/{name}"
                head, *rest = [json.loads(x) for x in self.storage.read(p).split("\n")]
                if head["label"] == label:
                    out.append((p, head, [FileEntry(**e) for e in rest]))
        return out


class LakeSink:
    """Rows or DataFrames to a table: buffered, written as files, recorded, and committed in the background in order.

    Rows are measured by batches. At ``rotation``'s rows, bytes or age they are committed with ``auto_commit``; without it they
    are written as files that wait for ``commit``, so the buffer stays bounded. Every ``check_seconds`` age counts also when no
    row comes. With ``wap`` commits go through a branch and, if ``auto_publish``, on to main. ``commit`` raises what a background
    commit failed with. ``recover`` commits what a dead process had recorded, but no file twice, also by its branch.
    """

    def __init__(self, table: LakeTable, label: str, wal: str, rotation: Rotation = Rotation(), max_pending: int = 3, wap: bool = False, auto_publish: bool = True, auto_commit: bool = False, clock: Callable[[], float] = time.time, check_seconds: float | None = None) -> None:
        self.table, self.label, self.wal, self.rotation, self.clock = table, label, Wal(table.storage, wal), rotation, clock
        self.wap, self.auto_publish, self.auto_commit = wap, auto_publish, auto_commit
        self.max_pending = max(1, max_pending)
        self.pool = ThreadPoolExecutor(1)
        self.lock = threading.RLock()
        self.jobs: list[Future] = []
        self.parts: list[pa.Table] = []  # not measured yet, and after them the rows
        self.rows: list[Any] = []
        self.batches: list[pa.Table] = []
        self.waiting, self.held_rows, self.held_bytes = 0, 0, 0  # rows not measured, all rows, bytes of the batches
        self.staged: list[FileEntry] = []
        self.rotations: list[str] = []
        self.began = clock()
        self.unpublished: list[WapTransaction] = []
        self.recover()
        self.ticker = Ticker(check_seconds, self.rotate_if_due) if check_seconds else None

    def recover(self) -> int:
        """The number of recorded commits that had not been made."""
        made = 0
        for p, head, entries in self.wal.pending(self.label):
            if head["table"] != self.table.location:
                continue
            if head.get("wap_id"):
                made += self._resume(head, entries)
                self.wal.done(p)
                continue
            known = self.table.has_files([e.path for e in entries])
            left = [e for e in entries if e.path not in known and self.table.storage.exists(e.path)]
            if left:
                branch = head["branch"]
                if branch != "main" and branch not in self.table.metadata().refs:
                    self.table.create_branch(branch)
                self.table.commit_files(left, branch if branch in self.table.metadata().refs else "main")
                made += 1
            self.wal.done(p)
        return made

    def _resume(self, head: dict, entries: list[FileEntry]) -> int:
        """Takes a branch's commit up where the dead process left it: files not committed, or committed and not published."""
        tx, before = WapTransaction(self.table, head["wap_id"], head["branch"]), ""
        if tx.state == "writer":
            tx.commit([e for e in entries if self.table.storage.exists(e.path)])
            before = "writer"
        if tx.state == "publisher":
            if head["publish"]:
                tx.publish()
                before = before or "publisher"
            else:
                self.unpublished.append(tx)
        return int(bool(before))

    def write(self, row: Any) -> None:
        with self.lock:
            self.rows.append(_plain(row))
            self._count(1)

    def write_all(self, rows: Iterable[Any]) -> None:
        for r in rows:
            self.write(r)

    def write_batches(self, batches: Iterable[pa.RecordBatch | pa.Table]) -> None:
        """Rows in Arrow, measured and rotated after the same rows as by ``write`` one by one."""
        schema = to_arrow_schema(self._schema())
        for b in batches:
            t, i = _table(b).select(schema.names).cast(schema), 0
            while i < len(t):
                with self.lock:
                    n = max(1, min(len(t) - i, self.rotation.batch_rows - self.waiting, self.rotation.max_rows - self.held_rows))
                    self._pack()
                    self.parts.append(t.slice(i, n))
                    i += n
                    self._count(n)

    def _count(self, n: int) -> None:
        self.waiting, self.held_rows = self.waiting + n, self.held_rows + n
        if self.waiting >= self.rotation.batch_rows:
            self._measure()
        self.rotate_if_due()

    def _schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self.table.metadata().struct()])

    def _measure(self) -> None:
        """Packs the buffered rows, whose size is known then."""
        if self.waiting:
            self._pack()
            counters.add("sink.batch_rows", self.waiting, self.label)
            self.held_bytes += sum(p.nbytes for p in self.parts)
            self.batches += self.parts
            self.parts, self.waiting = [], 0

    def _pack(self) -> None:
        if self.rows:
            try:
                self.parts.append(self._packed())
            except Exception:
                counters.add("sink.errors", 1, self.label)
                raise
            self.rows = []

    def _packed(self) -> pa.Table:
        """The buffered rows in Arrow: here, or by Spark where that reads values in its own way (times with a zone, nested ones)."""
        s = self._schema()
        if any(isinstance(f.dataType, (T.TimestampType, T.ArrayType, T.MapType, T.StructType)) for f in s):
            return self.table.spark.createDataFrame(self.rows, s).toArrow()
        return pa.Table.from_pylist(self.rows, to_arrow_schema(s))

    def rotate_if_due(self) -> None:
        with self.lock:
            why = self.rotation.reason(self.held_rows, self.held_bytes, self.clock() - self.began) if self.held_rows else None
            if not why:
                return
            self.rotations.append(why)
            counters.add("sink.rotations", 1, self.label)
            if self.auto_commit:
                self.commit(wait=False)
            else:
                self.staged += self.table.write_arrow(self._taken())
                self.began = self.clock()

    def _taken(self) -> pa.Table:
        self._measure()
        whole, self.batches, self.held_rows, self.held_bytes = pa.concat_tables(self.batches), [], 0, 0
        counters.add("sink.records", len(whole), self.label)
        return whole

    def commit(self, wait: bool = True) -> list[str]:
        """The paths of the files written; with ``wait``, once they are committed."""
        with self.lock:
            entries, self.staged = self.staged, []
            if self.held_rows:
                entries = entries + self.table.write_arrow(self._taken())
            self.began = self.clock()
            return self._commit(entries, wait)

    def commit_frame(self, df: DataFrame, wait: bool = True) -> list[str]:
        with self.lock:
            return self._commit(self.table.write_files(df), wait)

    def _commit(self, entries: list[FileEntry], wait: bool) -> list[str]:
        if entries:
            wap_id = uuid.uuid4().hex if self.wap else None
            branch = f"wap-{wap_id}" if wap_id else "main"
            record = self.wal.record(self.label, self.table.location, branch, entries, wap_id, self.auto_publish)
            while len([j for j in self.jobs if not j.done()]) >= self.max_pending:
                next(j for j in self.jobs if not j.done()).result()

            def job() -> None:
                if wap_id is None:
                    self.table.commit_files(entries)
                else:
                    tx = WapTransaction(self.table, wap_id, branch)
                    tx.commit(entries)
                    if self.auto_publish:
                        tx.publish()
                    else:
                        self.unpublished.append(tx)
                self.wal.done(record)

            self.jobs.append(self.pool.submit(job))
        if wait:
            self.drain()
        return [e.path for e in entries]

    def drain(self) -> None:
        jobs, self.jobs = self.jobs, []
        for j in jobs:
            j.result()

    def publish(self) -> None:
        for tx in self.unpublished:
            tx.publish()
        self.unpublished = []

    def rollback(self) -> list[str]:
        """Discards what was not committed; the paths of files that had been written."""
        with self.lock:
            gone, self.parts, self.rows, self.batches, self.staged = [e.path for e in self.staged], [], [], [], []
            self.waiting, self.held_rows, self.held_bytes = 0, 0, 0
            for p in gone:
                self.table.storage.delete(p)
            return gone

    def close(self) -> None:
        if self.ticker is not None:
            self.ticker.stop()
        self.commit()
        self.pool.shutdown()


def stream_to_table(stream: DataFrame, table: LakeTable, checkpoint: str, seconds: float | None = None, label: str = "stream"):  # noqa: ANN201
    """A streaming query that appends each micro-batch to a table exactly once; without ``seconds`` it takes what is there."""

    def each(df: DataFrame, batch_id: int) -> None:
        mark = f"{label}:{batch_id}"
        if any(s.summary.get("stream.batch") == mark for s in table.metadata().snapshots.values()):
            return
        table.append(df, summary={"stream.batch": mark})

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()

