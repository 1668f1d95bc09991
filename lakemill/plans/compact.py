"""Compaction of loose files and of tables. Planning is shared by the dry run and the run, so their numbers agree."""

from __future__ import annotations

import dataclasses
import json
import math
import time
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions.naming import MARKER, FileMeta
from lakemill.operators.dedup import first_rows
from lakemill.plans.log import CommitConflict, FileEntry, Metadata
from lakemill.plans.table import LakeTable
from lakemill.sources import files as loose
from lakemill.sources.storage import Storage


def greedy_groups(sizes: list[int], limit: int) -> list[int]:
    """The group of each item, in order: a group ends before the item that would take it over the limit. Items stay whole."""
    out, group, held, count = [], 0, 0, 0
    for n in sizes:
        if count and held + n > limit:
            group, held, count = group + 1, 0, 0
        out.append(group)
        held, count = held + n, count + 1
    return out


@dataclass
class CompactionResult:
    files_processed: int = 0
    files_created: int = 0
    records: int = 0
    duplicates_eliminated: int = 0
    bytes_in: int = 0
    bytes_out: int = 0
    skipped: dict[str, str] = field(default_factory=dict)
    outputs: list[str] = field(default_factory=list)
    delete_failures: list[str] = field(default_factory=list)
    #: Where the next run may begin; None if nothing was processed.
    last_processed_ms: int | None = None

    @property
    def bytes_saved(self) -> int:
        return max(0, self.bytes_in - self.bytes_out)


@dataclass(frozen=True)
class FileCompactor:
    """Compacts the files of one prefix below ``root`` into ``.c`` files of about ``target_bytes`` of source bytes.

    A run's outputs are written aside and named by a journal before they get their names, so a run that dies is finished by
    the next one: no row is lost or doubled. ``dedup`` drops rows that equal an earlier one of the run.
    """

    spark: SparkSession
    root: str
    prefix: str
    after_ms: int | None = None
    until_ms: int | None = None
    target_bytes: int = 100 << 20
    dedup: bool = False
    delete_sources: bool = False
    codec: str = "snappy"

    def _pending(self, storage: Storage) -> tuple[list[FileMeta], dict[str, str], list[list[FileMeta]], int]:
        """The files to compact, why others aren't, the files of each output, and the rows of all."""
        if self.after_ms is not None and self.until_ms is not None and self.after_ms >= self.until_ms:
            raise ValueError("the window is empty")
        names = {p for p, *_ in storage.files(self.root)}
        found = [f for f in loose.list_files(self.spark, self.root, self.prefix, self.after_ms, self.until_ms) if not f.compacted and f.key + MARKER not in names]
        feet = loose.footers(self.spark, [f.key for f in found])
        skipped = {k: f.error for k, f in feet.items() if f.error}
        whole = [f for f in found if f.key not in skipped]
        skipped |= {f.key: "another schema" for f in whole if not feet[f.key].schema.equals(feet[whole[0].key].schema)}
        good = [f for f in whole if f.key not in skipped]
        groups: dict[int, list[FileMeta]] = defaultdict(list)
        for f, g in zip(good, greedy_groups([f.size for f in good], self.target_bytes), strict=True):
            groups[g].append(f)
        return good, skipped, list(groups.values()), sum(feet[f.key].rows for f in good)

    def _write(self, storage: Storage, groups: list[list[FileMeta]], aside: str) -> list[tuple[str, int, int]]:
        """Writes the outputs below ``aside``; (path, bytes, rows) of each."""
        into = self.spark.createDataFrame(list(enumerate(i for i, g in enumerate(groups) for _ in g)), "file_no int, output_no int")
        df = loose.read(self.spark, [f.key for g in groups for f in g], ordered=True, checked=True)
        if self.dedup:
            df = first_rows(df, [c for c in df.columns if c not in ("file_no", "row_no")], ["file_no", "row_no"])
        df = df.join(F.broadcast(into), "file_no")  # a row per file
        df = df.repartitionByRange(len(groups), "output_no").sortWithinPartitions("output_no", "file_no", "row_no")
        df.drop("file_no", "row_no").write.option("compression", loose.check_codec(self.codec)).partitionBy("output_no").parquet(aside)
        found = [(p, n) for p, n, _ in storage.files(aside)]
        feet = loose.footers(self.spark, [p for p, _ in found])
        return [(p, n, feet[p].rows) for p, n in found]

    def plan(self) -> CompactionResult:
        """What a run would do: its outputs are written aside, measured and dropped."""
        storage = Storage(self.spark)
        good, skipped, groups, total = self._pending(storage)
        r = CompactionResult(len(good), bytes_in=sum(f.size for f in good), skipped=skipped, last_processed_ms=good[-1].millis if good else None)
        if good:
            aside = f"{self.root}/_compaction/plan-{uuid.uuid4().hex}"
            try:
                made = self._write(storage, groups, aside)
            finally:
                storage.delete(aside)
            r.files_created, r.bytes_out, r.records = len(made), sum(n for _, n, _ in made), sum(n for *_, n in made)
            r.duplicates_eliminated = total - r.records
        return r

    def run(self) -> CompactionResult:
        storage = Storage(self.spark)
        self.recover(storage)
        good, skipped, groups, total = self._pending(storage)
        r = CompactionResult(len(good), bytes_in=sum(f.size for f in good), skipped=skipped)
        if not good:
            return r
        run = uuid.uuid4().hex
        aside = f"{self.root}/_compaction/{run}"
        made = self._write(storage, groups, aside)
        # names of outputs move on by a millisecond where two would share one
        taken: set[str] = {p.rsplit("/", 1)[-1] for p, *_ in storage.files(self.root)}
        moves = []
        for path, size, _ in made:
            g = groups[int(path.rsplit("output_no=", 1)[1].split("/")[0])]
            ms, part = max(f.millis for f in g), 0
            while (name := FileMeta.name(self.prefix, ms, True, part)) in taken:
                part += 1
            taken.add(name)
            moves.append((path, f"{self.root}/{name}", size))
        journal = {"moves": [m[:2] for m in moves], "sources": [f.key for f in good], "delete": self.delete_sources}
        storage.create(f"{self.root}/_compaction/{run}.json", json.dumps(journal))
        r.outputs, r.bytes_out, r.files_created = [m[1] for m in moves], sum(m[2] for m in moves), len(moves)
        r.records = sum(n for *_, n in made)
        r.duplicates_eliminated = total - r.records
        r.delete_failures = self._finish(storage, run, journal)
        r.last_processed_ms = max(f.millis for f in good)
        return r

    def _finish(self, storage: Storage, run: str, journal: dict) -> list[str]:
        for a, b in journal["moves"]:
            if storage.exists(a):
                storage.rename(a, b)
        with ThreadPoolExecutor(50) as pool:
            list(pool.map(lambda k: storage.create(k + MARKER, ""), journal["sources"]))
        failed = []
        if journal["delete"]:
            for k in journal["sources"]:
                try:
                    storage.delete(k)
                except Exception:
                    failed.append(k)
        storage.delete(f"{self.root}/_compaction/{run}.json")
        storage.delete(f"{self.root}/_compaction/{run}")
        return failed

    def recover(self, storage: Storage | None = None) -> int:
        """Finishes runs whose journal was written, drops what others left; the number finished."""
        storage = storage or Storage(self.spark)
        names = storage.names(f"{self.root}/_compaction")
        done = [n[:-5] for n in names if n.endswith(".json")]
        for run in done:
            self._finish(storage, run, json.loads(storage.read(f"{self.root}/_compaction/{run}.json")))
        for n in storage.names(f"{self.root}/_compaction"):
            storage.delete(f"{self.root}/_compaction/{n}")
        return len(done)


@dataclass(frozen=True)
class TableCompaction:
    files_in: int = 0
    files_out: int = 0
    partitions: int = 0
    records: int = 0
    duplicates_eliminated: int = 0
    bytes_in: int = 0
    bytes_out: int = 0
    snapshot_id: int | None = None


def eligible(entries: list[FileEntry], min_files: int = 5) -> dict[tuple, list[FileEntry]]:
    """Files by (partition spec, partition), for partitions of at least ``min_files``."""
    groups: dict[tuple, list[FileEntry]] = defaultdict(list)
    for e in entries:
        groups[e.spec_id, tuple(sorted((k, str(v)) for k, v in e.partition.items()))].append(e)
    return {k: v for k, v in groups.items() if len(v) >= min_files}


def needs_compaction(table: LakeTable, min_files: int = 5) -> bool:
    m = table.metadata()
    return bool(eligible(table.log.live(m, m.refs.get("main")), min_files))


def compact_table(table: LakeTable, min_files: int = 5, target_bytes: int = 100 << 20, dedup: bool | list[str] = False, tries: int = 3) -> TableCompaction:
    """Rewrites the partitions of at least ``min_files`` files into files of about ``target_bytes``, as one replace snapshot.

    ``dedup``: True takes the table's identifiers (all columns without any), or name the key columns; of equal rows the one
    stays that was added first, by file order and row. Only the chosen files take part. A commit that lands in between is
    followed if all rewritten files are still live, else nothing changes. If nothing would be left, nothing is committed.
    """
    m = table.metadata()
    live = table.log.live(m, m.refs.get("main"))
    groups = eligible(live, min_files)
    chosen = [e for e in live if (e.spec_id, tuple(sorted((k, str(v)) for k, v in e.partition.items()))) in groups]
    if not chosen:
        return TableCompaction()
    stored = {c.stored: c.name for c in m.columns}
    schema = T.StructType([T.StructField(c.stored, c.dtype, True) for c in m.columns])
    df = loose.read(table.spark, [e.path for e in chosen], schema, ordered=bool(dedup), checked=True)
    df = df.select(*[F.col(f"`{s}`").alias(n) for s, n in stored.items()], *(("file_no", "row_no") if dedup else ()))
    before = sum(e.rows for e in chosen)
    if dedup:
        keys = dedup if isinstance(dedup, list) else [c for c in m.identifiers if c in stored.values()] or list(stored.values())
        df = first_rows(df, keys, ["file_no", "row_no"])
    outputs = sum(max(1, math.ceil(sum(e.bytes for e in g) / target_bytes)) for g in groups.values())
    df = df.drop("file_no", "row_no")
    if not m.partitions:
        df = df.repartition(outputs) if not m.sort else df.repartitionByRange(outputs, *[s.expression() for s in m.sort])
    # by the partition whose rows are largest, so that no file is over the target
    a_row = max((sum(e.bytes for e in g) / max(1, sum(e.rows for e in g)) for g in groups.values()), default=1.0)
    written = table.write_files(df, m, most_rows=max(1, int(target_bytes / max(a_row, 1e-9))))
    if not written:
        return TableCompaction()
    gone, made = {e.path for e in chosen}, []

    def change(now: Metadata) -> Metadata:
        if not gone <= {e.path for e in table.log.live(now, now.refs.get("main"))}:
            raise CommitConflict("files were removed while they were compacted")
        s = table.log.next_snapshot(now, now.refs.get("main"), "replace", written, sorted(gone), {"lakemill.operation": "compaction"})
        made[:] = [s]
        return dataclasses.replace(now, snapshots=now.snapshots | {s.id: s}, refs=now.refs | {"main": s.id}, sequence=s.sequence)

    table.log.commit(change, tries + 1)
    rows = sum(e.rows for e in written)
    return TableCompaction(len(chosen), len(written), len(groups), rows, before - rows, sum(e.bytes for e in chosen), sum(e.bytes for e in written), made[0].id)


class Scheduler:
    """Compacts a table every ``period`` seconds while it needs it; errors are kept and the next turn goes on."""

    def __init__(self, table: LakeTable, period: float = 300.0, min_files: int = 5, **how: object) -> None:
        self.table, self.period, self.min_files, self.how = table, period, min_files, how
        self.errors: list[Exception] = []
        self.results: list[TableCompaction] = []

    def turn(self) -> None:
        try:
            if needs_compaction(self.table, self.min_files):
                self.results.append(compact_table(self.table, self.min_files, **self.how))
        except Exception as e:
            self.errors.append(e)

    def run(self, stop) -> None:  # noqa: ANN001 (a threading.Event)
        while not stop.is_set():
            began = time.monotonic()
            self.turn()
            missed = math.floor((time.monotonic() - began) / self.period)
            stop.wait(max(0.0, (missed + 1) * self.period - (time.monotonic() - began)))
