"""Processing only what is new or changed, with the target as the only state.

Output rows carry the key and version of the source row they came from. A run anti-joins the source against them,
writes what is missing beside the published files and publishes both as the target's next version by one atomic
create. A run that fails before that leaves nothing that a reader or a later run would see.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.session import cut
from lakemill.sources.storage import Storage


class Conflict(RuntimeError):
    """Another run published this version first."""


def pending(source: DataFrame, done: DataFrame, key: list[str], version: str, scope: list[str] | None = None) -> DataFrame:
    """Source rows whose key has no row in ``done`` with this version or a later one.

    ``scope``: the part of the key by which versions count. In a log that is read in order, a row that is done stands for all
    rows of its scope up to its version. Null keys and versions compare as values (a null version is older than any). Repeated source rows give one row:
    that of the newest version, of equals any. Columns of ``done`` other than key and version are ignored.
    """
    scope = scope or key
    newest = done.groupBy(*scope).agg(F.max(version).alias("__v"), F.max(F.col(version).isNull()).alias("__n"))
    newest = newest.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(scope)], "__v", "__n")
    rows = source.groupBy(*key).agg(F.max(F.struct(F.col(version), F.struct(*[c for c in source.columns if c not in (*key, version)]) if set(source.columns) - {*key, version} else F.lit(0))).alias("__r"))
    rest = [c for c in source.columns if c not in (*key, version)]
    rows = rows.select(*key, F.col(f"__r.{version}").alias(version), *[F.col(f"__r.col2.{c}").alias(c) for c in rest]).select(*source.columns)
    on = F.lit(True)
    for i, k in enumerate(scope):
        on = on & rows[k].eqNullSafe(newest[f"__{i}"])
    later = F.coalesce(newest["__v"] >= rows[version], rows[version].isNull() & (newest["__n"] | newest["__v"].isNotNull()), F.lit(False))
    return rows.join(newest, on & later, "left_anti")


@dataclass
class Target:
    """A versioned table in a folder: ``versions/N.json`` lists the data folders that make up version N. ``scope``: see ``pending``.

    What else the file names (see ``run``) is part of the version and passes on to the next one.
    """

    spark: SparkSession
    path: str
    key: list[str]
    version: str
    scope: list[str] | None = None

    def __post_init__(self) -> None:
        self.storage = Storage(self.spark)

    def manifest(self) -> tuple[int, dict]:
        """The newest version's number and what its file says; 0 and no parts before the first."""
        n = max((int(n.removesuffix(".json")) for n in self.storage.names(f"{self.path}/versions") if n.endswith(".json")), default=0)
        return n, json.loads(self.storage.read(f"{self.path}/versions/{n}.json")) if n else {"parts": []}

    def current(self) -> tuple[int, list[str]]:
        n, m = self.manifest()
        return n, m["parts"]

    def stage(self, rows: DataFrame) -> str:
        """Writes rows that no version names yet; the name of their part."""
        part = f"beside-{self.storage.unique()}"
        try:
            rows.write.parquet(f"{self.path}/data/{part}")
        except BaseException:
            self.storage.delete(f"{self.path}/data/{part}")
            raise
        return part

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the newest by default); None before the first."""
        n, parts = self.current()
        if version is not None and version != n:
            parts = json.loads(self.storage.read(f"{self.path}/versions/{version}.json"))["parts"]
        return self.spark.read.parquet(*[f"{self.path}/data/{p}" for p in parts]) if parts else None

    def replace(self, rows: DataFrame, onto: int | None = None) -> int:
        """Publishes ``rows`` as the whole next version (``onto``: see ``run``); its number. Earlier versions stay readable."""
        n, m = self.manifest()
        if onto is not None and n != onto:
            raise Conflict(f"version {onto + 1} of {self.path} was published by another run")
        part = f"{n + 1}-{self.storage.unique()}"
        rows.write.parquet(f"{self.path}/data/{part}")
        if not self.storage.create(f"{self.path}/versions/{n + 1}.json", json.dumps(m | {"parts": [part]})):
            self.storage.delete(f"{self.path}/data/{part}")
            raise Conflict(f"version {n + 1} of {self.path} was published by another run")
        return n + 1

    def run(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame] | None = None, done: DataFrame | None = None, beside: dict | None = None, onto: int | None = None) -> DataFrame:
        """Processes what is new and publishes it; returns the rows added, read from what was published.

        ``done``: further rows of key and version that count as processed. ``transform`` must keep key and version.
        ``beside``: what the version's file is to say besides its parts. ``onto``: the version that must still be the newest.
        """
        n, m = self.manifest()
        if onto is not None and n != onto:
            raise Conflict(f"version {onto + 1} of {self.path} was published by another run")
        parts = m["parts"]
        had = self.read() if parts else None
        cols = [*self.key, self.version]
        known = [x.select(*cols) for x in (had, done) if x is not None]
        fresh = source
        if known:
            every = known[0]
            for x in known[1:]:
                every = every.unionByName(x)
            fresh = pending(source, every, self.key, self.version, self.scope)
        else:
            fresh = pending(source, source.select(*cols).limit(0), self.key, self.version)
        part = f"{n + 1}-{self.storage.unique()}"
        (transform or (lambda x: x))(fresh).write.parquet(f"{self.path}/data/{part}")
        if not self.storage.create(f"{self.path}/versions/{n + 1}.json", json.dumps(m | (beside or {}) | {"parts": [*parts, part]})):
            self.storage.delete(f"{self.path}/data/{part}")
            raise Conflict(f"version {n + 1} of {self.path} was published by another run")
        return self.spark.read.parquet(f"{self.path}/data/{part}")


def main_line(snapshots: DataFrame) -> DataFrame:
    """Snapshots on each table's main line: the head of branch ``main`` and its chain of parents in the log.

    Ancestry is found by jumps of growing length over (table, snapshot), so a long chain takes a logarithmic number of joins
    and no table is gathered in one task. Ids are looked up within their table; repeated rows count once; a parent that
    isn't in the log ends the chain, as does a cycle. Of heads with equal ``sequence_number`` the larger id counts.
    """
    log = snapshots.where("table_name IS NOT NULL AND snapshot_id IS NOT NULL").groupBy("table_name", "snapshot_id").agg(
        F.max(F.struct("sequence_number", "parent_snapshot_id", "operation", "branch")).alias("r")).select("table_name", "snapshot_id", "r.*")
    log = cut(log)
    heads = log.where("branch = 'main'").groupBy("table_name").agg(F.max(F.struct("sequence_number", "snapshot_id")).alias("h")).select("table_name", F.col("h.snapshot_id").alias("snapshot_id"))
    here = log.select("table_name", F.col("snapshot_id").alias("jump"))
    jumps = cut(log.select("table_name", "snapshot_id", F.col("parent_snapshot_id").alias("jump")).join(here, ["table_name", "jump"], "left_semi"))
    reached, size = cut(heads), heads.count()
    while size:
        onward = jumps.select("table_name", F.col("snapshot_id").alias("jump"), F.col("jump").alias("next"))
        step, far, every = reached, jumps, reached
        for _ in range(RADIX - 1):  # from all that is reached up to three jumps on, and jumps of four times the length
            step = step.join(jumps, ["table_name", "snapshot_id"]).select("table_name", F.col("jump").alias("snapshot_id"))
            far = far.join(onward, ["table_name", "jump"]).select("table_name", "snapshot_id", F.col("next").alias("jump"))
            every = every.unionByName(step)
        reached = cut(every.distinct())
        size, before = reached.count(), size
        if size == before:
            break
        jumps = cut(far)
    return log.join(reached, ["table_name", "snapshot_id"], "left_semi")


#: How much longer jumps along the chain of parents get from round to round.
RADIX = 4
#: Into how many parts a table's snapshots are dealt where each meets the table's pollers.
SALTS = 16


def snapshot_work(snapshots: DataFrame, states: DataFrame) -> DataFrame:
    """``process_name, table_name, snapshot_id, sequence_number``: what each poller reads in all, the main line without ``replace``.

    ``replace`` snapshots bring no new rows. A table's snapshots are dealt to ``SALTS`` parts, each of which meets all its pollers.
    """
    line = main_line(snapshots).where("operation IS NULL OR operation <> 'replace'").select("table_name", "snapshot_id", "sequence_number", F.pmod(F.xxhash64("snapshot_id"), F.lit(SALTS)).alias("__salt"))
    pollers = states.where("process_name IS NOT NULL AND table_name IS NOT NULL").select("process_name", "table_name").distinct()
    pollers = pollers.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return line.join(pollers, ["table_name", "__salt"]).select("process_name", "table_name", "snapshot_id", "sequence_number")


def acked(snapshots: DataFrame, states: DataFrame) -> DataFrame:
    """What each poller has done, as rows of ``snapshot_work``: its ``acked`` row of newest ``recorded_at`` (of equals the larger id).

    No row if nothing was acked or that snapshot isn't in the log: then the whole main line is unread.
    """
    got = F.when(F.col("outcome") == "acked", F.struct("recorded_at", "last_snapshot_id"))
    last = states.where("process_name IS NOT NULL AND table_name IS NOT NULL").groupBy("process_name", "table_name").agg(F.max(got).alias("a")).select("process_name", "table_name", F.col("a.last_snapshot_id").alias("snapshot_id"))
    at = snapshots.where("sequence_number IS NOT NULL").groupBy("table_name", "snapshot_id").agg(F.max("sequence_number").alias("sequence_number"))
    return last.join(at, ["table_name", "snapshot_id"]).select("process_name", "table_name", "snapshot_id", "sequence_number")


def unread_snapshots(snapshots: DataFrame, states: DataFrame) -> DataFrame:
    """(process, table, snapshot, sequence number) of what each poller has still to read (see ``snapshot_work`` and ``acked``)."""
    return pending(snapshot_work(snapshots, states), acked(snapshots, states), ["process_name", "table_name", "snapshot_id"], "sequence_number", ["process_name", "table_name"])
