"""Tables over a snapshot log: every scan is one Parquet read of the files that the log, their bounds and partitions leave."""

from __future__ import annotations

import dataclasses
import json
import tempfile
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal
from typing import Any
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakemill.functions.predicate import Predicate, bound, comparable, conjunction, storable
from lakemill.plans.log import CommitConflict, FileEntry, Metadata, NoSuchSnapshot, Snapshot, SnapshotLog
from lakemill.plans.schema import Reconciled, SchemaError, TableSchema, conform, first_columns, reconcile
from lakemill.sources.files import check_codec, local_path
from lakemill.sources.storage import Storage

#: Properties that ``TableConfig`` sets, under their public names.
PROPERTIES = {
    "wap": "write.wap.enabled", "max_snapshot_age_ms": "history.expire.max-snapshot-age-ms", "min_snapshots": "history.expire.min-snapshots-to-keep",
    "max_ref_age_ms": "history.expire.max-ref-age-ms", "codec": "write.parquet.compression-codec",
}
#: Types whose values are the same in files written by Arrow and by Spark.
PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)
ARROW_CODECS = {"uncompressed": "none", "lz4_raw": "lz4"}
#: Footers are read on the driver up to this many files, by a job beyond.
DRIVER_FOOTERS = 256


@dataclass(frozen=True)
class TableConfig:
    schema: TableSchema
    properties: dict[str, str] = dataclasses.field(default_factory=dict)
    wap: bool = False
    codec: str = "snappy"
    max_snapshot_age_ms: int | None = None
    min_snapshots: int | None = None
    max_ref_age_ms: int | None = None

    def all_properties(self) -> dict[str, str]:
        out = dict(self.properties)
        for name, key in PROPERTIES.items():
            v = getattr(self, name)
            if v is not None and v is not False:
                out[key] = str(v).lower() if isinstance(v, bool) else str(v)
        return out


@contextmanager
def times_as_micros(spark: SparkSession) -> Iterator[None]:
    """Times with a zone are written as micros, which have bounds in footers, and not in the old form, which has none."""
    key = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(key)
    spark.conf.set(key, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Catalog:
    """Tables in a folder: ``warehouse/namespace/table``."""

    def __init__(self, spark: SparkSession, warehouse: str) -> None:
        self.spark, self.warehouse, self.storage = spark, warehouse.rstrip("/"), Storage(spark)

    def location(self, namespace: str, name: str) -> str:
        return f"{self.warehouse}/{namespace.replace('.', '/')}/{name}"

    def exists(self, namespace: str, name: str) -> bool:
        return SnapshotLog(self.storage, self.location(namespace, name)).version() is not None

    def create(self, config: TableConfig) -> LakeTable:
        """Creates a table; fails if there is one."""
        s = config.schema
        check_codec(config.codec)
        m = Metadata(0, str(uuid.uuid4()), self.location(s.namespace, s.table), first_columns(s.struct), len(s.struct), s.struct.names, s.known_identifiers, list(s.partitions), 0, list(s.sort), config.all_properties(), {}, {})
        if not SnapshotLog(self.storage, m.location).create(m):
            raise FileExistsError(f"table {s.namespace}.{s.table} exists")
        return LakeTable(self.spark, m.location)

    def create_if_not_exists(self, config: TableConfig) -> LakeTable:
        try:
            return self.create(config)
        except FileExistsError:
            return self.load(config.schema.namespace, config.schema.table)

    def load(self, namespace: str, name: str) -> LakeTable:
        t = LakeTable(self.spark, self.location(namespace, name))
        t.metadata()
        return t

    def ensure(self, config: TableConfig) -> tuple[LakeTable, str, Reconciled | None]:
        """The table with at least this schema, and ``created``, ``up-to-date`` or ``evolved`` with what changed."""
        s = config.schema
        if not self.exists(s.namespace, s.table):
            try:
                return self.create(config), "created", None
            except FileExistsError:
                pass
        t = self.load(s.namespace, s.table)
        r = t.evolve(s)
        return t, "evolved" if r.changed else "up-to-date", r if r.changed else None


def _bounds(f: pq.ParquetFile, stored: dict[str, str]) -> tuple[int, dict, dict]:
    """(rows, lowest, highest value per column) of a file, from its footer; a column that a row group knows nothing of has none."""
    meta = f.metadata
    low, high, unknown = {}, {}, set()
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            x = meta.row_group(g).column(c)
            if x.path_in_schema not in stored:
                continue
            name, st = stored[x.path_in_schema], x.statistics
            if st is not None and st.has_min_max and (a := storable(st.min)) is not None and (b := storable(st.max)) is not None:
                # decimals are kept as text but ordered as numbers
                order = (lambda v: Decimal(v)) if isinstance(st.min, Decimal) else (lambda v: v)
                low[name], high[name] = min(low.get(name, a), a, key=order), max(high.get(name, b), b, key=order)
            elif st is None or not (st.has_null_count and st.null_count == meta.row_group(g).num_rows):
                unknown.add(name)
    return meta.num_rows, {k: v for k, v in low.items() if k not in unknown}, {k: v for k, v in high.items() if k not in unknown}


def bounds(spark: SparkSession, storage: Storage, files: list[tuple[str, int]], stored: dict[str, str]) -> dict[str, tuple[int, dict, dict]]:
    """path -> what ``_bounds`` says. ``stored``: name in files -> column name.

    Footers are read on the driver by threads, through Hadoop's file systems where they aren't on local disks; of more than
    ``DRIVER_FOOTERS`` files on local disks by a job.
    """
    local = [local_path(p) for p, _ in files]
    if None in local or len(files) <= DRIVER_FOOTERS:

        def one(path: str) -> tuple[int, dict, dict]:
            at = local_path(path)
            if at is not None:
                return _bounds(pq.ParquetFile(at), stored)
            with storage.open(path) as f:
                return _bounds(pq.ParquetFile(f), stored)

        with ThreadPoolExecutor(8 if None not in local else 32) as pool:
            return dict(zip([p for p, _ in files], pool.map(one, [p for p, _ in files]), strict=True))

    def some(frames: Any) -> Any:
        for b in frames:
            yield pd.DataFrame({"path": b["path"], "j": [json.dumps(_bounds(pq.ParquetFile(p), stored)) for p in b["at"]]})

    df = spark.createDataFrame([(p, at) for (p, _), at in zip(files, local, strict=True)], "path string, at string").repartition(max(1, len(files) // 64))
    return {r["path"]: tuple(json.loads(r["j"])) for r in df.mapInPandas(some, "path string, j string").collect()}


class LakeTable:
    def __init__(self, spark: SparkSession, location: str) -> None:
        self.spark, self.location, self.storage = spark, location, Storage(spark)
        self.log = SnapshotLog(self.storage, location)

    def metadata(self) -> Metadata:
        return self.log.load()

    # -- reading

    def _read(self, m: Metadata, entries: list[FileEntry], columns: list[str] | None, filters: list[Predicate | str], where: Column | None) -> DataFrame:
        parsed = [Predicate.parse(f) if isinstance(f, str) else f for f in filters]
        names = {c.name for c in m.columns}
        for p in parsed:
            if p.column not in names:
                raise SchemaError(f"no column {p.column}")
        paths = [e.path for e in entries if e.rows and self._may_hold(e, parsed, m)]
        stored = T.StructType([T.StructField(c.stored, c.dtype, True) for c in m.columns])
        df = self.spark.read.schema(stored).parquet(*paths) if paths else self.spark.createDataFrame([], stored)
        df = df.select(*[F.col(f"`{c.stored}`").alias(c.name) for c in m.columns])
        if parsed:
            df = df.where(conjunction(parsed))
        if where is not None:
            df = df.where(where)
        return df.select(*[f"`{c}`" for c in columns]) if columns is not None else df

    def _may_hold(self, e: FileEntry, parsed: list[Predicate], m: Metadata) -> bool:
        """False only if the bounds or the partition of a file rule a filter out."""
        zone = self.spark.conf.get("spark.sql.session.timeZone")
        types = {c.name: c.dtype for c in m.columns}
        for p in parsed:
            dtype = types[p.column]
            v = comparable(p.value, dtype, zone)
            if v is None:
                continue
            low, high = bound(e.low.get(p.column), dtype), bound(e.high.get(p.column), dtype)
            if isinstance(v, float):  # as Spark compares a decimal with a double
                low, high = (float(x) if isinstance(x, Decimal) else x for x in (low, high))
            if not Predicate(p.column, p.op, v).may_match(low, high):
                return False
            for f in m.partitions if e.spec_id == m.spec_id else ():
                # days and more of times with a zone are those of the session that wrote them
                told = not isinstance(dtype, T.TimestampType) or f.transform.kind in ("identity", "hour", "bucket") or zone in ("UTC", "Etc/UTC", "Z")
                if f.column == p.column and f.name in e.partition and told and not f.transform.may_match(e.partition[f.name], p.op, v, dtype):
                    return False
        return True

    def scan(self, columns: list[str] | None = None, filters: list[Predicate | str] = (), where: Column | None = None, snapshot_id: int | None = None, branch: str = "main", limit: int | None = None) -> DataFrame:
        """The rows of a snapshot (the branch's newest by default). Files whose bounds or partitions rule a filter out aren't read."""
        m = self.metadata()
        i = m.snapshot(snapshot_id).id if snapshot_id is not None else m.refs.get(branch)
        if i is None and branch != "main":
            raise NoSuchSnapshot(f"no branch {branch}")
        df = self._read(m, self.log.live(m, i), columns, list(filters), where)
        return df if limit is None else df.limit(limit)

    def snapshot_at(self, timestamp_ms: int) -> Snapshot | None:
        """The newest snapshot of any branch committed by then; of equal times the later one."""
        return max((s for s in self.metadata().snapshots.values() if s.timestamp_ms <= timestamp_ms), key=lambda s: (s.timestamp_ms, s.sequence), default=None)

    def earliest(self) -> Snapshot | None:
        return min(self.metadata().snapshots.values(), key=lambda s: s.sequence, default=None)

    def current(self, branch: str = "main") -> Snapshot | None:
        m = self.metadata()
        return m.snapshots.get(m.refs.get(branch))

    def scan_at(self, timestamp_ms: int, **how: Any) -> DataFrame:
        s = self.snapshot_at(timestamp_ms)
        if s is None:
            raise NoSuchSnapshot(f"nothing was committed by {timestamp_ms}")
        return self.scan(snapshot_id=s.id, **how)

    def scan_range(self, after: int, to: int | None = None, columns: list[str] | None = None, filters: list[Predicate | str] = (), where: Column | None = None) -> DataFrame:
        """Rows appended after snapshot ``after`` up to ``to`` (main's newest by default).

        What appends added is read from their own files, which compaction leaves in place, so nothing is lost or given twice
        when files were compacted in between.
        """
        m = self.metadata()
        low = m.snapshot(after)
        high = m.snapshot(to) if to is not None else m.snapshots.get(m.refs.get("main"))
        if high is None or high.sequence <= low.sequence:
            return self._read(m, [], columns, list(filters), where)
        steps = [s for s in m.lineage(high.id) if s.sequence > low.sequence and s.operation != "replace"]
        entries = [e for s in reversed(steps) for e in self.log.read_manifest(s.manifest)[0]]
        return self._read(m, entries, columns, list(filters), where)

    def scan_since(self, after: int, **how: Any) -> DataFrame:
        return self.scan_range(after, None, **how)

    # -- metadata as tables

    def snapshots(self) -> DataFrame:
        rows = [(s.id, s.parent, s.sequence, s.timestamp_ms, s.operation, {k: str(v) for k, v in s.summary.items()}) for s in self.metadata().snapshots.values()]
        return self.spark.createDataFrame(rows, "snapshot_id long, parent_id long, sequence long, timestamp_ms long, operation string, summary map<string,string>")

    def files(self, snapshot_id: int | None = None) -> DataFrame:
        m = self.metadata()
        rows = [(e.path, e.rows, e.bytes, e.spec_id, {k: None if v is None else str(v) for k, v in e.partition.items()}) for e in self.log.live(m, snapshot_id if snapshot_id is not None else m.refs.get("main"))]
        return self.spark.createDataFrame(rows, "path string, rows long, bytes long, spec_id int, partition map<string,string>")

    def refs(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.metadata().refs.items()), "name string, snapshot_id long")

    def info(self) -> dict[str, Any]:
        m = self.metadata()
        return {
            "uuid": m.uuid, "location": m.location, "schema": [{"id": c.id, "name": c.name, "type": c.dtype.simpleString(), "required": not c.nullable} for c in m.columns],
            "partitions": [{"name": p.name, "column": p.column, "transform": str(p.transform), "field_id": 1000 + i} for i, p in enumerate(m.partitions)],
            "sort": [{"column": s.column, "descending": s.descending} for s in m.sort], "identifiers": m.identifiers, "properties": m.properties,
            "refs": m.refs, "current_snapshot": m.refs.get("main"), "snapshots": len(m.snapshots),
        }

    # -- writing

    def rows_for(self, m: Metadata, target_bytes: int) -> int | None:
        """How many rows make a file of about ``target_bytes``, by what the newest snapshot that added rows took for them; None if none did."""
        for s in m.lineage(m.refs.get("main")):
            rows, size = s.summary.get("added-records", 0), s.summary.get("added-bytes", 0)
            if rows and size:
                return max(1, target_bytes * rows // size)
        return None

    def write_files(self, df: DataFrame, m: Metadata | None = None, target_bytes: int | None = None, by_partition: bool = True, most_rows: int | None = None) -> list[FileEntry]:
        """Writes rows as data files of the table without committing them.

        A file gets at most ``most_rows`` rows, or about ``target_bytes`` by the size that the table's rows had so far.
        Rows go to files by partition, sorted within each file as the table is; a hot partition is spread over tasks by AQE's
        rebalancing. Files are known by a folder of their own, so a failed write leaves nothing in the table.
        """
        m = m or self.metadata()
        types = {c.name: c.dtype for c in m.columns}
        parts = [(f"__p{i}_{p.name}", p) for i, p in enumerate(m.partitions)]
        names = [n for n, _ in parts]
        body = conform(df, m.columns)
        if parts:
            kept = {c.name: c.stored for c in m.columns}
            body = body.select("*", *[p.transform(kept[p.column], types[p.column]).alias(n) for n, p in parts])
            if by_partition:
                body = body.hint("rebalance", *[F.col(n) for n in names])
        if m.sort:
            stored = {c.name: c.stored for c in m.columns}
            order = [F.col(n) for n in names] + [dataclasses.replace(s, column=stored[s.column]).expression() for s in m.sort]
            body = body.sortWithinPartitions(*order)
        out = f"{self.location}/data/{uuid.uuid4().hex}"
        w = body.write.option("compression", m.properties.get(PROPERTIES["codec"], "snappy"))
        if most_rows is None and target_bytes is not None:
            most_rows = self.rows_for(m, target_bytes)
        if most_rows is not None:
            w = w.option("maxRecordsPerFile", most_rows)
        if parts:
            w = w.partitionBy(*names)
        with times_as_micros(self.spark):
            w.parquet(out)
        return self._entries(out, m)

    def write_arrow(self, t: pa.Table) -> list[FileEntry]:
        """Rows held by this process as a data file, without committing it.

        A table that is neither partitioned nor sorted, of plain types and with all columns here, is written by this process,
        so that small files cost no job; others are by ``write_files``.
        """
        m = self.metadata()
        kept = {c.name: c.stored for c in m.columns}
        if extra := [n for n in t.column_names if n not in kept]:
            raise SchemaError(f"columns the table doesn't have: {', '.join(extra)}")
        plain = all(type(c.dtype) in PLAIN and not c.metadata.get("set") and not c.metadata.get("fixed") for c in m.columns)
        if m.partitions or m.sort or not plain or set(t.column_names) != set(kept) or not len(t):
            types = {c.name: c.dtype for c in m.columns}
            return self.write_files(self.spark.createDataFrame(t, T.StructType([T.StructField(n, types[n], True) for n in t.column_names])), m)
        t = t.select(list(kept)).cast(to_arrow_schema(T.StructType([T.StructField(c.name, c.dtype, True) for c in m.columns])))
        # Arrow leaves NaN out of bounds, but for Spark it is the highest value
        told = [kept[n] for n in kept if not (pa.types.is_floating(t[n].type) and pc.any(pc.is_nan(t[n])).as_py())]
        out = f"{self.location}/data/{uuid.uuid4().hex}"
        codec = m.properties.get(PROPERTIES["codec"], "snappy")
        with tempfile.TemporaryDirectory(prefix="lakemill-") as aside:
            at = f"{aside}/part-00000.parquet"
            pq.write_table(t.rename_columns(list(kept.values())), at, compression=ARROW_CODECS.get(codec, codec), write_statistics=told)
            self.storage.put(at, f"{out}/part-00000.parquet")
        return self._entries(out, m)

    def _entries(self, out: str, m: Metadata) -> list[FileEntry]:
        """The data files below a folder."""
        parts = [(f"__p{i}_{p.name}", p) for i, p in enumerate(m.partitions)]
        found = [(p, n) for p, n, _ in self.storage.files(out) if p.endswith(".parquet")]
        stats = bounds(self.spark, self.storage, found, {c.stored: c.name for c in m.columns}) if found else {}
        entries = []
        for p, n in found:
            rows, low, high = stats[p]
            values = dict(x.split("=", 1) for x in p.split("/") if x.startswith("__p"))
            part = {f.name: None if (v := unquote(values[name])) == "__HIVE_DEFAULT_PARTITION__" else v for name, f in parts}
            if rows:
                entries.append(FileEntry(p, rows, n, part, m.spec_id, low, high))
        return entries

    def commit_files(self, entries: list[FileEntry], branch: str = "main", summary: dict | None = None, timestamp_ms: int | None = None) -> Snapshot | None:
        """Appends written files as one snapshot; ``timestamp_ms`` is for histories that are replayed. No files, no snapshot."""
        if not entries:
            return None
        made: list[Snapshot] = []

        def change(m: Metadata) -> Metadata:
            if branch != "main" and branch not in m.refs:
                raise NoSuchSnapshot(f"no branch {branch}")
            s = self.log.next_snapshot(m, m.refs.get(branch), "append", entries, [], summary or {}, timestamp_ms)
            made[:] = [s]
            return dataclasses.replace(m, snapshots=m.snapshots | {s.id: s}, refs=m.refs | {branch: s.id}, sequence=s.sequence)

        self.log.commit(change)
        return made[0]

    def append(self, df: DataFrame, branch: str = "main", summary: dict | None = None, timestamp_ms: int | None = None) -> Snapshot | None:
        """Writes and commits rows; without rows there is no snapshot."""
        return self.commit_files(self.write_files(df), branch, summary, timestamp_ms)

    def has_files(self, paths: list[str]) -> set[str]:
        """Which of the paths any snapshot has added."""
        m, want, found = self.metadata(), set(paths), set()
        # newest first: what a dead process had written was committed last, if at all
        for s in sorted(m.snapshots.values(), key=lambda s: -s.sequence):
            if want <= found:
                break
            found |= want & {e.path for e in self.log.read_manifest(s.manifest)[0]}
        return found

    # -- schema and properties

    def evolve(self, schema: TableSchema) -> Reconciled:
        """Brings the columns to ``schema``: adds, drops and widens by name. Changing the identifiers is an error."""
        result: list[Reconciled] = []

        def change(m: Metadata) -> Metadata | None:
            if set(schema.known_identifiers) != set(m.identifiers):
                raise SchemaError(f"identifiers can't change from {m.identifiers} to {schema.known_identifiers}")
            r = reconcile(m.columns, schema.struct, m.highest_id, set(m.used_names))
            result[:] = [r]
            if not r.changed:
                return None
            for f in (*m.partitions, *m.sort):
                if f.column in r.dropped:
                    raise SchemaError(f"{f.column} is used by the partitioning or sort order")
            return dataclasses.replace(m, columns=r.columns, highest_id=max(m.highest_id, *(c.id for c in r.columns)), used_names=sorted({*m.used_names, *(c.stored for c in r.columns)}), schema_id=m.schema_id + 1)

        self.log.commit(change)
        return result[0]

    def set_properties(self, values: dict[str, str | None]) -> None:
        self.log.commit(lambda m: dataclasses.replace(m, properties={k: v for k, v in (m.properties | values).items() if v is not None}))

    def expire(self, now_ms: int | None = None) -> list[int]:
        """Drops old snapshots from the log by the table's properties, so that metadata stays small; the ids dropped.

        A snapshot goes if it is older than ``max_snapshot_age_ms`` (5 days if not set) and not among the newest
        ``min_snapshots`` (1) of a branch. The oldest that stay get lists of all their files, and none of their rows changes.
        Data files stay where they are.
        """
        gone: list[int] = []

        def change(m: Metadata) -> Metadata | None:
            age = int(m.properties.get(PROPERTIES["max_snapshot_age_ms"], 5 * 86_400_000))
            least = max(1, int(m.properties.get(PROPERTIES["min_snapshots"], 1)))
            oldest = (now_ms if now_ms is not None else int(time.time() * 1000)) - age
            kept = {s.id for head in m.refs.values() for i, s in enumerate(m.lineage(head)) if i < least or s.timestamp_ms >= oldest}
            gone[:] = [i for i in m.snapshots if i not in kept]
            if not gone:
                return None
            now = {}
            for i in kept:
                s = m.snapshots[i]
                if s.parent is not None and s.parent not in kept and not s.summary.get("full-list"):
                    added, removed, _ = self.log.read_manifest(s.manifest)
                    s = dataclasses.replace(s, manifest=self.log.write_manifest(added, removed, self.log.live(m, i)), summary=s.summary | {"full-list": True})
                now[i] = s
            return dataclasses.replace(m, snapshots={i: now[i] for i in m.snapshots if i in now})

        self.log.commit(change)
        return gone

    # -- branches

    @staticmethod
    def check_branch(name: str) -> None:
        if not name or name == "main":
            raise ValueError(f"not a name for a branch: {name!r}")

    def create_branch(self, name: str) -> int | None:
        """A branch at main's newest snapshot; None, and no branch, if main has none."""
        self.check_branch(name)

        def change(m: Metadata) -> Metadata | None:
            if name in m.refs:
                raise CommitConflict(f"branch {name} exists")
            return dataclasses.replace(m, refs=m.refs | {name: m.refs["main"]}) if "main" in m.refs else None

        return self.log.commit(change).refs.get(name)

    def publish_branch(self, name: str) -> int:
        """Moves main to the branch's head and removes the branch; refused unless main's head is an ancestor of it."""
        self.check_branch(name)

        def change(m: Metadata) -> Metadata:
            if name not in m.refs:
                raise NoSuchSnapshot(f"no branch {name}")
            main = m.refs.get("main")
            if main is not None and main not in {s.id for s in m.lineage(m.refs[name])}:
                raise CommitConflict(f"main has moved on since branch {name} was made")
            return dataclasses.replace(m, refs={k: v for k, v in m.refs.items() if k != name} | {"main": m.refs[name]})

        return self.log.commit(change).refs["main"]

    def delete_branch(self, name: str) -> None:
        self.check_branch(name)

        def change(m: Metadata) -> Metadata:
            if name not in m.refs:
                raise NoSuchSnapshot(f"no branch {name}")
            return dataclasses.replace(m, refs={k: v for k, v in m.refs.items() if k != name})

        self.log.commit(change)

