"""Queries of loose files, sinks, pollers and commands, over the whole tables, each with the same result in SQL."""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill import cli
from lakemill.functions.naming import FileMeta
from lakemill.functions.transforms import Transform
from lakemill.plans.compact import compact_table
from lakemill.plans.schema import PartitionField, SortField
from lakemill.plans.table import LakeTable, TableConfig
from lakemill.plans.wap import WapTransaction
from lakemill.queries.engine import KEY, _catalog, _events, _schema
from lakemill.queries.registry import Registry
from lakemill.session import shared_path, table
from lakemill.sources import files as loose
from lakemill.sources.storage import Storage
from lakemill.streaming import poll
from lakemill.streaming.sink import LakeSink, ParquetSink, Rotation

R = Registry()


@dataclass
class Nation:
    n_nationkey: int
    n_name: str


def _named(spark: SparkSession, df: DataFrame, root: str, prefix: str, part: str, millis: Callable[[int], int]) -> None:
    """``df`` as files ``prefix.millis.parquet`` below ``root``, one for each value of ``part``, an expression over it."""
    store = Storage(spark)
    df.withColumn("__p", F.expr(part)).repartition("__p").write.option("maxRecordsPerFile", 0).partitionBy("__p").parquet(f"{root}-aside")
    for p, _, _ in store.files(f"{root}-aside"):
        k = int(p.rsplit("__p=", 1)[1].split("/")[0])
        store.rename(p, f"{root}/{FileMeta.name(prefix, millis(k))}")


def _nations(spark: SparkSession, sf: str) -> str:
    """A file per nation, named by its key, between a marker and files of other names and prefixes."""
    root, store = shared_path(spark, "nations"), Storage(spark)
    _named(spark, table(spark, sf, "nation"), root, "nation", "n_nationkey", lambda k: k)
    for name in ("nation.5.parquet.processed", "nation_v2.7.parquet", "nation.x.parquet", "readme.txt"):
        store.write(f"{root}/{name}", "no rows")
    return root


# -- reading


@R.add(sql="SELECT n_nationkey AS millis, true AS has_size FROM nation WHERE n_nationkey > 4 AND n_nationkey <= 20")
def list_folder(spark: SparkSession, sf: str) -> DataFrame:
    found = loose.list_files(spark, _nations(spark, sf), "nation", 4, 20)
    return spark.createDataFrame([(f.millis, bool(f.size)) for f in found], "millis int, has_size boolean")


@R.add(sql="SELECT n_nationkey, n_name FROM nation")
def read_unordered(spark: SparkSession, sf: str) -> DataFrame:
    """All files at once; an empty, a cut and a missing one are left out."""
    root, store = _nations(spark, sf), Storage(spark)
    store.write(f"{root}/nation.100.parquet", "")
    store.write(f"{root}/nation.101.parquet", "PAR1 and no more")
    paths = [f.key for f in loose.list_files(spark, root, "nation")]
    return loose.read(spark, [*paths, f"{root}/nation.102.parquet"], strict=False).select("n_nationkey", "n_name")


@R.add(sql="SELECT 'good' AS file, count(*) AS n, CAST(NULL AS VARCHAR) AS why FROM nation UNION ALL VALUES ('empty', 0, 'empty'), ('missing', 0, 'missing'), ('short', 0, 'too short')")
def read_single(spark: SparkSession, sf: str) -> DataFrame:
    """One file at a time: what has no footer is refused with the reason."""
    root, store = shared_path(spark, "single"), Storage(spark)
    table(spark, sf, "nation").coalesce(1).write.parquet(f"{root}/rows")
    store.write(f"{root}/empty", "")
    store.write(f"{root}/short", "PAR1")
    out = []
    for name, path in (("good", store.files(f"{root}/rows")[0][0]), ("empty", f"{root}/empty"), ("short", f"{root}/short"), ("missing", f"{root}/missing")):
        try:
            out.append((name, loose.read(spark, [path]).count(), None))
        except loose.BadParquet as e:
            out.append((name, 0, str(e).rsplit(": ", 1)[1]))
    return spark.createDataFrame(out, "file string, n long, why string")


@R.add(sql="SELECT n_nationkey, true AS whole FROM nation")
def read_bytes(spark: SparkSession, sf: str) -> DataFrame:
    found = loose.list_files(spark, _nations(spark, sf), "nation")
    data = [(f, loose.raw_bytes(spark, f.key)) for f in found]
    return spark.createDataFrame([(f.millis, len(d) == f.size and d[:4] == d[-4:] == b"PAR1") for f, d in data], "n_nationkey int, whole boolean")


@R.add(sql="SELECT n_nationkey, n_name FROM nation")
def rows_as_objects(spark: SparkSession, sf: str) -> DataFrame:
    got = loose.items(table(spark, sf, "nation").select("n_nationkey", "n_name"), Nation)
    return spark.createDataFrame([(n.n_nationkey, n.n_name) for n in got], "n_nationkey int, n_name string")


@R.add(sql="SELECT s_suppkey AS n_nationkey, s_name AS n_name FROM supplier")
def rows_as_objects_lazily(spark: SparkSession, sf: str) -> DataFrame:
    """Objects one partition at a time, into a row sink and back."""
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("n_nationkey"), F.col("s_name").alias("n_name"))
    sink = ParquetSink(shared_path(spark, "objects").removeprefix("file:"), "supplier", df.schema, Rotation(max_rows=500, batch_rows=100))
    sink.write_all(loose.stream_items(df, Nation))
    return loose.read(spark, sink.commit())


@R.add(sql="SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def arrow_files(spark: SparkSession, sf: str) -> DataFrame:
    """A table as an Arrow file and as an Arrow stream, and back."""
    import pyarrow as pa

    df, path = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), shared_path(spark, "arrow").removeprefix("file:")
    loose.to_arrow_file(df, path)
    out = io.BytesIO()
    loose.to_arrow_stream(df, out)
    return loose.from_arrow(spark, path).unionByName(loose.from_arrow(spark, pa.ipc.open_stream(out.getvalue()).read_all()))


@R.add(sql="SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 1")
def remove_files(spark: SparkSession, sf: str) -> DataFrame:
    root, store = _nations(spark, sf), Storage(spark)
    for f in loose.list_files(spark, root, "nation"):
        if f.millis % 2 == 0:
            store.delete(f.key)
    return spark.createDataFrame([(f.millis,) for f in loose.list_files(spark, root, "nation")], "n_nationkey int")


# -- sinks


@R.add(sql="SELECT 'ZSTD' AS codec, CAST(ceil(count(*) / 30.0) AS BIGINT) AS row_groups, count(*) AS n FROM supplier")
def sink_properties(spark: SparkSession, sf: str) -> DataFrame:
    """The codec and the rows of a row group that a sink was told, as its files have them."""
    df = table(spark, sf, "supplier")
    sink = ParquetSink(shared_path(spark, "properties").removeprefix("file:"), "supplier", df.schema, Rotation(batch_rows=90), codec="zstd", row_group=30)
    sink.write_all(df.toLocalIterator())
    meta = [pq.read_metadata(p) for p in sink.commit()]
    codec = {m.row_group(g).column(0).compression for m in meta for g in range(m.num_row_groups)}
    return spark.createDataFrame([(",".join(codec), sum(m.num_row_groups for m in meta), sum(m.num_rows for m in meta))], "codec string, row_groups long, n long")


@R.add(sql="SELECT * FROM events")
def sink_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Six commits in the background of which two may wait; the sink is closed once all are made."""
    e = table(spark, sf, "events")
    t = _catalog(spark).create(TableConfig(_schema(e)))
    sink = LakeSink(t, "events", shared_path(spark, "wal"), max_pending=2)
    for k in range(6):
        sink.commit_frame(e.where(F.pmod(F.col(KEY), F.lit(6)) == k), wait=False)
    sink.close()
    return t.scan()


@R.add(sql="SELECT * FROM events")
def sink_by_branch(spark: SparkSession, sf: str) -> DataFrame:
    """Commits by branches: the first published at once, the second only when told; rows rolled back are never there."""
    e = table(spark, sf, "events")
    t = _catalog(spark).create(TableConfig(_schema(e), wap=True))
    LakeSink(t, "a", shared_path(spark, "wal"), wap=True).commit_frame(e.where("event_id % 2 = 0"))
    sink = LakeSink(t, "b", shared_path(spark, "wal"), wap=True, auto_publish=False)
    sink.write_all(e.limit(10).toLocalIterator())
    sink.rollback()
    sink.commit_frame(e.where("event_id % 2 <> 0"))
    assert t.current().summary["added-records"] == e.where("event_id % 2 = 0").count()
    sink.publish()
    return t.scan()


@R.add(sql="SELECT r_regionkey, r_name, CAST(1 AS BIGINT) AS n_snapshots FROM region")
def append_nothing(spark: SparkSession, sf: str) -> DataFrame:
    """Appends without rows make no snapshot and no file is read for them."""
    df = table(spark, sf, "region").select("r_regionkey", "r_name")
    t = _catalog(spark).create(TableConfig(_schema(df)))
    for rows in (df.limit(0), df, df.limit(0)):
        t.append(rows)
    return t.scan().withColumn("n_snapshots", F.lit(t.snapshots().count()))


# -- tables


@R.add(sql="SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 100 = 0")
def compact_while_appending(spark: SparkSession, sf: str) -> DataFrame:
    """An append lands between a compaction's writing and its commit: the compaction is followed by it, and both stay."""
    t, _ = _events(spark, sf, 5)
    extra = table(spark, sf, "events").where(F.pmod(F.col(KEY), F.lit(100)) == 0)

    class Slow(LakeTable):
        def write_files(self, *a: object, **k: object) -> list:
            out = super().write_files(*a, **k)
            t.append(extra)
            return out

    compact_table(Slow(spark, t.location))
    return t.scan()


@R.add(sql="SELECT 'column' AS kind, column_name AS name, CAST(ordinal_position AS BIGINT) AS id FROM (SELECT column_name, row_number() OVER () AS ordinal_position FROM (DESCRIBE events)) UNION ALL VALUES ('partition', 'ts_day', 1000), ('partition', 'user_id_bucket_8', 1001), ('sort', 'value desc', 0), ('sort', 'event_id', 1)")
def table_info(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of columns and partition fields and the sort order, as a table tells them."""
    e = table(spark, sf, "events")
    how = {"partitions": (PartitionField("ts", Transform("day")), PartitionField("user_id", Transform("bucket", 8))), "sort": (SortField("value", True), SortField(KEY))}
    i = _catalog(spark).create(TableConfig(_schema(e, **how))).info()
    rows = [("column", c["name"], c["id"]) for c in i["schema"]] + [("partition", p["name"], p["field_id"]) for p in i["partitions"]]
    rows += [("sort", s["column"] + " desc" * s["descending"], k) for k, s in enumerate(i["sort"])]
    return spark.createDataFrame(rows, "kind string, name string, id long")


@R.add(sql="SELECT count(*) AS n, 'main' AS branches, 'false' AS wap FROM events WHERE event_id % 2 = 0")
def branch_abandoned(spark: SparkSession, sf: str) -> DataFrame:
    """A transaction is abandoned: its branch is deleted, main keeps its rows; a property is set and another removed."""
    e = table(spark, sf, "events")
    t = _catalog(spark).create(TableConfig(_schema(e), wap=True, properties={"owner": "x"}))
    t.append(e.where("event_id % 2 = 0"))
    tx = WapTransaction(t, "given-up")
    tx.write(e.where("event_id % 2 <> 0"))
    tx.abandon()
    t.set_properties({"write.wap.enabled": "false", "owner": None})
    p = t.metadata().properties
    assert "owner" not in p
    return t.scan().agg(F.count(F.lit(1)).alias("n"), F.lit(",".join(t.metadata().refs)).alias("branches"), F.lit(p["write.wap.enabled"]).alias("wap"))


# -- pollers


def _three_files(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Events as three files 30 minutes apart, which is more than a poller looks back, and one that is compacted already."""
    root, e, store = shared_path(spark, "polled"), table(spark, sf, "events"), Storage(spark)
    _named(spark, e, root, "events", "pmod(event_id, 3)", lambda k: 1000 + 1_800_000 * k)
    first = loose.list_files(spark, root, "events")[0]
    store.copy(first.key, f"{root}/events.3600000.c.parquet")
    return root, e


@R.add(sql="SELECT * FROM events")
def poller_retry(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest file fails in the first turn, which goes on to the others; a later turn, of another instance, takes it up."""
    root, _ = _three_files(spark, sf)
    state, failures = shared_path(spark, "state"), ["once"]

    def consume(f: FileMeta, rows: DataFrame) -> DataFrame:
        if f.millis == 1000 and failures:
            raise OSError(failures.pop())
        return rows

    new = lambda: poll.FilePoller(spark, root, "events", "p", state, consume)
    assert len(new().poll()) == 2
    assert [f.millis for f in new().poll()] == [1000] and not new().poll()
    return new().rows()


@R.add(sql="SELECT * FROM events")
def poller_exactly_once(spark: SparkSession, sf: str) -> DataFrame:
    """A turn dies after its rows are written and before they are published; the next one publishes rows and record once."""
    root, _ = _three_files(spark, sf)
    state, publish = shared_path(spark, "state"), poll.FilePoller._publish
    p = poll.FilePoller(spark, root, "events", "p", state, lambda f, rows: rows)

    def dies(*_: object) -> None:
        raise OSError("the process dies")

    try:
        poll.FilePoller._publish = dies
        p.poll()
    except OSError:
        pass
    finally:
        poll.FilePoller._publish = publish
    again = poll.FilePoller(spark, root, "events", "p", state, lambda f, rows: rows)
    assert again.rows() is None and len(again.poll()) == 3 and not again.poll()
    return again.rows()


# -- commands


def _command(spark: SparkSession, *args: str) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        assert cli.main(list(args), spark) == 0
    return out.getvalue()


@R.add(sql="SELECT event_id, event_type FROM events WHERE event_type = 'click' AND user_id >= 10")
def command_scan(spark: SparkSession, sf: str) -> DataFrame:
    t, s = _events(spark, sf, 2)
    n = sum(x.summary["added-records"] for x in s)
    lines = _command(spark, "scan", t.location, "--filter", "event_type = click", "--filter", "user_id >= 10", "--columns", "event_id,event_type", "--limit", str(n), "--snapshot-id", str(s[-1].id)).splitlines()
    return spark.createDataFrame([(r["event_id"], r["event_type"]) for r in map(json.loads, lines)], T.StructType([t.metadata().struct()[c] for c in ("event_id", "event_type")]))


@R.add(sql="SELECT * FROM events")
def command_table_compact(spark: SparkSession, sf: str) -> DataFrame:
    t, _ = _events(spark, sf, 6)
    r = json.loads(_command(spark, "table-compact", t.location, "--dedup"))
    i = json.loads(_command(spark, "info", t.location))
    assert r["files_in"] > r["files_out"] and i["current_snapshot"] == r["snapshot_id"] and i["snapshots"] == 7
    return t.scan()


@R.add(sql="SELECT count(*) AS n, 3 AS planned, 3 AS processed FROM events")
def command_compact(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _three_files(spark, sf)
    plan, run = (json.loads(_command(spark, "compact", root, "events", "--codec", "zstd", *more)) for more in (["--plan"], []))
    return loose.read(spark, run["outputs"]).agg(F.count(F.lit(1)).alias("n"), F.lit(plan["files_processed"]).alias("planned"), F.lit(run["files_processed"]).alias("processed"))
