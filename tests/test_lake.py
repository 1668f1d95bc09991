"""Tables, schemas, sinks, pollers, compaction and branches: the behaviour of the engine, and what must not go wrong."""

import dataclasses
import json
import random
import tempfile
import threading
import time
from datetime import date, datetime, timedelta
from decimal import Decimal
from pathlib import Path
from typing import Annotated

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill import cli
from lakemill.functions.naming import FileMeta, NameError_
from lakemill.functions.predicate import FilterError, Predicate, literal
from lakemill.functions.transforms import Transform, TransformError, murmur3_bytes
from lakemill.operators import dedup
from lakemill.operators.incremental import Conflict
from lakemill.plans.compact import FileCompactor, Scheduler, compact_table, greedy_groups, needs_compaction
from lakemill.plans.log import CommitConflict, NoSuchSnapshot
from lakemill.plans.schema import PartitionField, SchemaError, SortField, TableSchema, first_columns, fixed_binary, lake, lake_schema, reconcile, spark_type
from lakemill.plans.table import Catalog, TableConfig
from lakemill.plans.wap import WapError, WapTransaction
from lakemill.settings import Settings
from lakemill.sources import files as loose
from lakemill.session import checkpoint_dir
from lakemill.sources.storage import Storage, UnsupportedStore
from lakemill.sources.upload import FileUpload
from lakemill.stats import NAMES, Counters, counters, observed
from lakemill.streaming import poll
from lakemill.streaming.sink import LakeSink, ParquetSink, Rotation, SinkClosed, file_ordinals, stream_to_table, write_files
from tests.conftest import rows

PAIR = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "lake"))


def pair(spark, ids, name="n"):
    return spark.createDataFrame([(i, f"{name}{i}") for i in ids], PAIR)


def make(catalog, struct=PAIR, wap=False, **how):
    return catalog.create(TableConfig(TableSchema(struct, namespace="a.b", table="t", **how), wap=wap))


# -- names, filters, transforms


def test_file_names():
    f = FileMeta.parse("x/sensor_data.1234567890123.parquet", 5)
    assert (f.prefix, f.millis, f.size, f.compacted) == ("sensor_data", 1234567890123, 5, False)
    assert FileMeta.parse("a.7.c.parquet").compacted and f.as_compacted().key == "sensor_data.1234567890123.c.parquet"
    assert FileMeta.name("a", 5, True, 2) == "a.7.c.parquet"
    for bad in ("invalid", "no_timestamp.parquet", "data.c.parquet", "a.1.parquet.processed", "a,b.1.parquet", "a.99999999999999999.parquet", "A.1.parquet"):
        with pytest.raises(NameError_):
            FileMeta.parse(bad)
    with pytest.raises(NameError_):
        FileMeta.name("a.b", 1)


def test_filter_grammar():
    p = Predicate.parse
    assert p("a>=5") == Predicate("a", ">=", 5) and p("a != 'x=1'") == Predicate("a", "!=", "x=1") and p("name = a>=b") == Predicate("name", "=", "a>=b")
    assert [literal(x) for x in ("'1'", '"t"', "TRUE", "7", "-7.5", "1e3", "x", "1_0")] == ["1", "t", True, 7, -7.5, 1000.0, "x", "1_0"]
    for bad in ("a", "= 5", "a <"):
        with pytest.raises(FilterError):
            p(bad)
    assert not p("a > 5").may_match(1, 5) and p("a >= 5").may_match(1, 5) and not p("a < 1").may_match(1, 5) and p("a <= 1").may_match(1, 5)
    assert not p("a = 9").may_match(1, 5) and not p("a != 1").may_match(1, 1) and p("a = x").may_match(1, 5) and p("a = 1").may_match(None, None)


def test_transforms(spark):
    assert murmur3_bytes(b"iceberg") == 1210000089 and murmur3_bytes((34).to_bytes(8, "little")) == 2017239379
    df = spark.createDataFrame([(34, "iceberg", datetime(2017, 11, 16, 22, 31, 8), date(2017, 11, 16), -7), (None, None, None, None, None)], "n long, s string, t timestamp_ntz, d date, k int")
    t = lambda text, c: Transform.parse(text)(c, df.schema[c].dataType)
    got = df.select(t("bucket[16]", "n"), t("bucket[16]", "s"), t("year", "t"), t("month", "t"), t("day", "t"), t("hour", "t"), t("day", "d"), t("truncate[10]", "k"), t("truncate[3]", "s"), t("bucket[8]", "d"), t("identity", "s")).collect()
    assert tuple(got[0]) == ((2017239379 & 0x7FFFFFFF) % 16, (1210000089 & 0x7FFFFFFF) % 16, 47, 574, 17486, 419686, 17486, -10, "ice", (murmur3_bytes((17486).to_bytes(8, "little")) & 0x7FFFFFFF) % 8, "iceberg")
    assert tuple(got[1]) == (None,) * 11
    rng = random.Random(1)
    longs = [rng.randrange(-(2**63), 2**63) for _ in range(50)] + [0, -1, 2**63 - 1]
    b = spark.createDataFrame([(x,) for x in longs], "x long").select("x", Transform("bucket", 1000)("x", T.LongType()).alias("b")).collect()
    assert all(r["b"] == (murmur3_bytes(r["x"].to_bytes(8, "little", signed=True)) & 0x7FFFFFFF) % 1000 for r in b)
    for bad in ("week", "bucket", "bucket[0]", "truncate"):
        with pytest.raises(TransformError):
            Transform.parse(bad)
    with pytest.raises(TransformError):
        t("hour", "d")
    assert Transform.parse("bucket(4)").field_name("x") == "x_bucket_4" and Transform.parse("day").field_name("x") == "x_day"


# -- schemas


def test_declared_schema():
    @lake_schema("readings", "a.b")
    class Reading:
        sensor_id: str = lake(identifier=True)
        timestamp: int = lake(identifier=True, sort="asc", partition="truncate[10]")
        temperature: float = lake(sort="desc", order=0)
        humidity: float | None = None
        tags: set[str] = dataclasses.field(default_factory=set)
        mac: Annotated[bytes, fixed_binary(6)] = b""
        big: Annotated[int, "u64"] = 0
        price: Decimal = Decimal(0)
        points: dict[str, list[int]] = dataclasses.field(default_factory=dict)

    s = Reading.lake_schema
    assert s.table == "readings" and s.identifiers == ("sensor_id", "timestamp")
    assert [f.column for f in s.sort] == ["temperature", "timestamp"] and s.partitions[0].name == "timestamp_truncate_10"
    types = {f.name: (f.dataType.simpleString(), f.nullable) for f in s.struct}
    assert types["humidity"] == ("double", True) and types["temperature"] == ("double", False) and types["big"] == ("decimal(20,0)", False)
    assert types["price"] == ("decimal(28,10)", False) and types["points"] == ("map<string,array<bigint>>", False) and types["mac"] == ("binary", False)
    with pytest.raises(SchemaError):

        @lake_schema("x")
        class Bad:
            a: int | None = lake(identifier=True)

    for hint in (int | str, object, dict[int | None, str], Annotated[int, "i7"]):
        with pytest.raises(SchemaError):
            spark_type(hint)


@pytest.mark.parametrize(("tag", "kind"), [("i8", "tinyint"), ("u8", "smallint"), ("u16", "int"), ("u32", "bigint"), ("f32", "float"), ("ntz", "timestamp_ntz")])
def test_tags(tag, kind):
    assert spark_type(Annotated[int, tag])[0].simpleString() == kind


def test_reconcile():
    struct = lambda *f: T.StructType([T.StructField(n, t) for n, t in f])
    cur = first_columns(struct(("id", T.IntegerType()), ("name", T.StringType())))
    r = reconcile(cur, struct(("email", T.StringType()), ("id", T.LongType())), 2, {"id", "name"})
    assert (r.added, r.dropped, r.widened, r.changed) == (["email"], ["name"], ["id"], True)
    assert [(c.id, c.name) for c in r.columns] == [(3, "email"), (1, "id")] and r.columns[0].nullable
    again = reconcile(r.columns, struct(("id", T.LongType()), ("name", T.LongType())), 3, {"id", "name", "email"})
    assert again.columns[1].id == 4 and again.columns[1].stored == "name__4"
    assert not reconcile(cur, struct(("id", T.IntegerType()), ("name", T.StringType())), 2, set()).changed
    with pytest.raises(SchemaError):
        reconcile(cur, struct(("id", T.StringType())), 2, set())
    for bad in ({"sort": (SortField("x"),)}, {"partitions": (PartitionField("x", Transform("identity")),)}):
        with pytest.raises(SchemaError):
            TableSchema(PAIR, **bad)


# -- tables


def test_append_scan_and_travel(spark, catalog):
    t = make(catalog)
    assert t.scan().count() == 0 and t.current() is None and t.append(pair(spark, [])) is None
    a, b = t.append(pair(spark, range(5)), timestamp_ms=1000), t.append(pair(spark, range(5, 8)), timestamp_ms=2000)
    assert t.scan().count() == 8 and t.scan(snapshot_id=a.id).count() == 5 and t.scan_since(a.id).count() == 3
    assert t.scan_range(b.id, a.id).count() == 0 and t.scan_range(a.id, a.id).count() == 0
    assert t.snapshot_at(1500).id == a.id and t.scan_at(2000).count() == 8 and t.earliest().id == a.id
    with pytest.raises(NoSuchSnapshot):
        t.scan_at(999)
    for wrong in (lambda: t.scan(snapshot_id=1), lambda: t.scan_since(1), lambda: t.scan(branch="x")):
        with pytest.raises(NoSuchSnapshot):
            wrong()
    assert rows(t.scan(["id"], ["id >= 6"])) == [(6,), (7,)] and t.scan(limit=3).count() == 3
    with pytest.raises(SchemaError):
        t.scan(filters=["nope = 1"])
    with pytest.raises(FileExistsError):
        make(catalog)
    assert catalog.create_if_not_exists(TableConfig(TableSchema(PAIR, namespace="a.b", table="t"))).location == t.location


def test_files_are_pruned_and_columns_too(spark, catalog):
    t = make(catalog)
    for k in range(4):
        t.append(pair(spark, range(k * 10, k * 10 + 10)))
    df = t.scan(["id"], ["id > 25", "id <= 33"])
    assert len(df.inputFiles()) < len(t.scan().inputFiles()) and df.count() == 8
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,25)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_incremental_reads_survive_compaction(spark, catalog):
    t = make(catalog)
    first = t.append(pair(spark, range(3)))
    for k in range(5):
        t.append(pair(spark, [10 + k]))
    compact_table(t, min_files=2)
    t.append(pair(spark, [99]))
    assert rows(t.scan_since(first.id), "id") == sorted([(10 + k,) for k in range(5)] + [(99,)], key=repr)
    assert t.scan().count() == 9


def test_long_histories_resolve(spark, catalog):
    t = make(catalog)
    made = [t.append(pair(spark, [k])) for k in range(20)]
    assert sum(bool(s.summary.get("full-list")) for s in made) == 1
    assert t.scan().count() == 20 and t.scan(snapshot_id=made[17].id).count() == 18


def test_partitions_and_sorting(spark, catalog):
    struct = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("at", T.TimestampNTZType())])
    t = make(catalog, struct, partitions=(PartitionField("kind", Transform("identity")), PartitionField("at", Transform("day"))), sort=(SortField("id", True),))
    data = [(i, random.Random(i).choice(["a/b", "c d", None]), datetime(2024, 1, 1 + i % 3)) for i in range(60)]
    t.append(spark.createDataFrame(data, struct))
    assert rows(t.scan()) == sorted(data, key=repr)
    m = t.metadata()
    for e in t.log.live(m, m.refs["main"]):
        got = pq.ParquetFile(e.path.removeprefix("file:")).read().to_pylist()
        assert [r["id"] for r in got] == sorted((r["id"] for r in got), reverse=True)
        assert {r["kind"] for r in got} == {e.partition["kind"]} and len({r["at"] for r in got}) == 1
    assert len({(e.partition["kind"], e.partition["at_day"]) for e in t.log.live(m, m.refs["main"])}) == 9


def test_rows_must_fit(spark, catalog):
    struct = T.StructType([T.StructField("a", T.ByteType(), False), T.StructField("m", T.BinaryType(), True, {"fixed": 2})])
    t = make(catalog, struct)
    ok = spark.createDataFrame([(5, bytearray(b"xy")), (6, None)], "a int, m binary")
    t.append(ok)
    assert t.scan().count() == 2
    for bad in (spark.createDataFrame([(500, None)], "a int, m binary"), spark.createDataFrame([(5, bytearray(b"x"))], "a int, m binary")):
        with pytest.raises(Exception):
            t.append(bad)
    for bad in (ok.drop("a"), ok.withColumn("z", F.lit(1))):
        with pytest.raises(SchemaError):
            t.append(bad)
    assert t.scan().count() == 2 and len(t.metadata().snapshots) == 1


def test_ensure(spark, catalog):
    cfg = lambda *f, **how: TableConfig(TableSchema(T.StructType([T.StructField(n, k, null) for n, k, null in f]), namespace="n", table="e", **how))
    one = cfg(("id", T.LongType(), False), ("name", T.StringType(), True), identifiers=("id",))
    t, what, r = catalog.ensure(one)
    assert (what, r) == ("created", None) and catalog.ensure(one)[1] == "up-to-date"
    t.append(spark.createDataFrame([(1, "x")], "id long, name string"))
    t, what, r = catalog.ensure(cfg(("id", T.LongType(), False), ("email", T.StringType(), True), ("score", T.DoubleType(), True), identifiers=("id",)))
    assert what == "evolved" and (r.added, r.dropped) == (["email", "score"], ["name"])
    t.append(spark.createDataFrame([(2, "e", 1.0)], "id long, email string, score double"))
    assert rows(t.scan()) == [(1, None, None), (2, "e", 1.0)]
    with pytest.raises(SchemaError):
        catalog.ensure(cfg(("id", T.LongType(), False)))


def test_commits_side_by_side(spark, catalog):
    t = make(catalog)
    entries = [t.write_files(pair(spark, [k])) for k in range(6)]
    pool = [threading.Thread(target=t.commit_files, args=(e,)) for e in entries]
    [x.start() for x in pool]
    [x.join() for x in pool]
    assert t.scan().count() == 6 and len(t.metadata().snapshots) == 6
    assert sorted(s.sequence for s in t.metadata().snapshots.values()) == [1, 2, 3, 4, 5, 6]


def test_a_random_history_equals_a_model(spark, catalog):
    rng, t = random.Random(7), make(catalog)
    model, states, n = [], {}, 0
    for _ in range(9):
        if rng.random() < 0.7 or not model:
            new = list(range(n, n + rng.randrange(1, 4)))
            n += 3
            states[t.append(pair(spark, new)).id] = list(model := model + new)
        else:
            r = compact_table(t, min_files=2)
            if r.snapshot_id:
                states[r.snapshot_id] = list(model)
    for i, want in states.items():
        assert rows(t.scan(["id"], snapshot_id=i)) == sorted([(x,) for x in want], key=repr)


# -- branches


def test_write_audit_publish(spark, catalog):
    t = make(catalog, wap=True)
    t.append(pair(spark, range(3)))
    tx = WapTransaction(t, "w1")
    with pytest.raises(WapError):
        tx.publish()
    assert tx.write(pair(spark, [10])) >= 1 and t.scan().count() == 3 and tx.audit().count() == 4
    with pytest.raises(WapError):
        tx.write(pair(spark, [11]))
    resumed = WapTransaction(t, "w1")
    assert resumed.state == "publisher"
    resumed.publish()
    assert t.scan().count() == 4 and WapTransaction(t, "w1").state == "complete"
    WapTransaction(t, "w1").publish()
    t.create_branch("wap-w2")
    assert WapTransaction(t, "w2").state == "writer" and "wap-w2" not in t.metadata().refs
    none = WapTransaction(t, "w3")
    assert none.write(pair(spark, [])) == 0
    none.publish()
    assert none.state == "complete" and t.scan().count() == 4


def test_first_rows_of_a_table_by_branch(spark, catalog):
    t = make(catalog, wap=True)
    tx = WapTransaction(t, "w")
    tx.write(pair(spark, [1]))
    assert t.scan().count() == 0
    tx.publish()
    assert t.scan().count() == 1


def test_branches_refuse(spark, catalog):
    t = make(catalog)
    assert t.create_branch("b") is None
    t.append(pair(spark, [1]))
    t.create_branch("b")
    t.append(pair(spark, [2]), branch="b")
    with pytest.raises(CommitConflict):
        t.create_branch("b")
    t.append(pair(spark, [3]))
    with pytest.raises(CommitConflict):
        t.publish_branch("b")
    assert rows(t.scan(), "id") == [(1,), (3,)]
    t.delete_branch("b")
    for wrong in (lambda: t.delete_branch("b"), lambda: t.publish_branch("b"), lambda: t.append(pair(spark, [9]), branch="b")):
        with pytest.raises(NoSuchSnapshot):
            wrong()
    for name in ("", "main"):
        with pytest.raises(ValueError):
            t.create_branch(name)
    with pytest.raises(WapError):
        WapTransaction(t, "x")


# -- compaction


def test_greedy_groups():
    assert greedy_groups([4, 4, 4, 20, 1, 0], 10) == [0, 0, 1, 2, 3, 3] and greedy_groups([], 5) == []


def test_table_compaction(spark, catalog):
    t = make(catalog)
    for k in range(6):
        t.append(pair(spark, [2 * k, 2 * k + 1]).coalesce(1))
    assert needs_compaction(t) and compact_table(t, min_files=7).files_in == 0
    r = compact_table(t)
    assert (r.files_in, r.files_out, r.records, r.duplicates_eliminated) == (6, 1, 12, 0) and t.scan().count() == 12
    assert t.metadata().snapshots[r.snapshot_id].operation == "replace" and not needs_compaction(t)


def test_table_compaction_with_dedup(spark, catalog):
    t = make(catalog)
    for _ in range(6):
        t.append(pair(spark, [1, 2]).coalesce(1))
    r = compact_table(t, dedup=True)
    assert (r.records, r.duplicates_eliminated) == (2, 10) and t.scan().count() == 2
    u = catalog.create(TableConfig(TableSchema(T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.LongType())]), ("id",), namespace="a", table="u")))
    for k in range(6):
        u.append(spark.createDataFrame([(1, 5 - k)], "id long, v long").coalesce(1))
    assert compact_table(u, dedup=True).duplicates_eliminated == 5 and rows(u.scan()) == [(1, 5)]  # the first added stays


def test_a_commit_while_compacting(spark, catalog, monkeypatch):
    t = make(catalog)
    for k in range(5):
        t.append(pair(spark, [k]).coalesce(1))
    write = t.write_files

    def slow(*a, **k):
        out = write(*a, **k)
        monkeypatch.undo()
        t.append(pair(spark, [100]))
        return out

    monkeypatch.setattr(t, "write_files", slow)
    compact_table(t)
    assert t.scan().count() == 6

    def other(*a, **k):
        out = write(*a, **k)
        monkeypatch.undo()
        compact_table(t, min_files=2)
        return out

    monkeypatch.setattr(t, "write_files", other)
    with pytest.raises(CommitConflict):
        compact_table(t, min_files=2)
    assert t.scan().count() == 6
    s = Scheduler(t, min_files=1)
    s.turn()
    assert s.results and not s.errors


def loose_files(spark, root, n=6, prefix="events"):
    root.mkdir(parents=True, exist_ok=True)
    for i in range(n):
        pq.write_table(pa.table({"id": [i, i + 1], "name": [f"n{i}", f"n{i + 1}"]}), root / FileMeta.name(prefix, 1000 + i))


def test_file_compaction(spark, tmp_path):
    root = tmp_path / "in"
    loose_files(spark, root)
    loose_files(spark, root, 2, "events_v2")
    (root / "events.2000.parquet").write_bytes(b"")
    (root / "events.2001.parquet").write_bytes(b"PAR1xxxxPAR2")
    pq.write_table(pa.table({"id": ["other"]}), root / "events.2002.parquet")
    size = (root / "events.1000.parquet").stat().st_size
    job = FileCompactor(spark, str(root), "events", target_bytes=int(size * 3.5))
    plan, r = job.plan(), job.run()
    assert (plan.files_processed, plan.files_created, plan.records) == (r.files_processed, r.files_created, r.records) == (6, 2, 12)
    assert len(r.skipped) == 3 and r.last_processed_ms == 1005 and r.bytes_saved == max(0, r.bytes_in - r.bytes_out)
    names = sorted(p.rsplit("/", 1)[1] for p in r.outputs)
    assert names == ["events.1002.c.parquet", "events.1005.c.parquet"]
    assert [x["id"] for p in sorted(r.outputs) for x in pq.read_table(p).to_pylist()] == [x for i in range(6) for x in (i, i + 1)]
    assert (root / "events.1000.parquet.processed").exists() and (root / "events.1000.parquet").exists()
    again = job.run()  # what has another schema is the first of the next run
    assert (again.files_processed, again.records) == (1, 1) and job.run().files_processed == 0
    with pytest.raises(ValueError):
        FileCompactor(spark, str(root), "events", 5, 5).run()


def test_file_compaction_with_dedup_and_deletion(spark, tmp_path):
    root = tmp_path / "in"
    loose_files(spark, root)
    r = FileCompactor(spark, str(root), "events", dedup=True, delete_sources=True).run()
    assert (r.records, r.duplicates_eliminated, r.delete_failures) == (7, 5, [])
    assert not (root / "events.1000.parquet").exists() and spark.read.parquet(*r.outputs).count() == 7


def test_file_compaction_that_dies(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    loose_files(spark, root)
    job = FileCompactor(spark, str(root), "events")
    monkeypatch.setattr(FileCompactor, "_finish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        job.run()
    monkeypatch.undo()
    assert not list(root.glob("*.c.parquet"))
    assert job.run().files_processed == 0 and len(list(root.glob("*.c.parquet"))) == 1  # the next run finishes it
    assert pq.read_table(next(root.glob("*.c.parquet"))).num_rows == 12 and not list((root / "_compaction").glob("*.json"))


# -- loose files


def test_listing_and_reading(spark, tmp_path):
    root = tmp_path / "in"
    loose_files(spark, root)
    loose_files(spark, root, 1, "events_v2")
    (root / "x.txt").write_text("no")
    assert [f.millis for f in loose.list_files(spark, str(root), "events", 1001, 1003)] == [1002, 1003]
    paths = [str(root / FileMeta.name("events", 1000 + i)) for i in (3, 0, 1)]
    got = loose.read(spark, paths, ordered=True).orderBy("file_no", "row_no").collect()
    assert [r["id"] for r in got] == [3, 4, 0, 1, 1, 2]
    with pytest.raises(loose.BadParquet):
        loose.read(spark, [*paths, str(root / "gone.parquet")])
    assert loose.read(spark, [*paths, str(root / "gone.parquet")], strict=False).count() == 6
    assert loose.read(spark, [], PAIR).count() == 0
    with pytest.raises(loose.BadParquet):
        loose.read(spark, [])
    assert loose.raw_bytes(spark, paths[0])[:4] == b"PAR1"

    @dataclasses.dataclass
    class Item:
        id: int
        name: str

    assert loose.items(loose.read(spark, paths[:1]), Item) == [Item(3, "n3"), Item(4, "n4")] == list(loose.stream_items(loose.read(spark, paths[:1]), Item))
    for codec in ("lzo", "brotli"):
        with pytest.raises(loose.UnsupportedCodec):
            loose.check_codec(codec)


def test_arrow_round_trip(spark, tmp_path):
    df = pair(spark, range(4))
    assert loose.to_arrow_file(df, str(tmp_path / "x.arrow")) == 4
    assert rows(loose.from_arrow(spark, str(tmp_path / "x.arrow"))) == rows(df)
    sink = pa.BufferOutputStream()
    assert loose.to_arrow_stream(df.limit(0), sink) == 0
    assert rows(loose.from_arrow(spark, df.toArrow().to_batches())) == rows(df)


# -- de-duplication


def test_first_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, "a", 0.0, {"x": 1, "y": 2}), (2, "a", -0.0, {"y": 2, "x": 1}), (3, None, nan, None), (4, None, nan, None), (5, "a", 1.0, {})], "id long, s string, d double, m map<string,int>")
    assert rows(dedup.first_rows(df, ["s", "d", "m"], ["id"]), "id") == [(1,), (3,), (5,)]
    assert rows(dedup.first_rows(df.drop("m"), ["s", "d"], ["id"]), "id") == [(1,), (3,), (5,)]
    assert dedup.first_rows(df.drop("id", "m")).count() == 3
    assert tuple(dedup.stats(df, ["s", "d"]).first()) == (5, 3, 2)
    assert tuple(dedup.stats(df.limit(0).drop("m")).first()) == (0, 0, 0)


# -- sinks


def test_sink_rotates_commits_and_rolls_back(tmp_path):
    s = ParquetSink(str(tmp_path), "ev", PAIR, Rotation(max_rows=100, batch_rows=50))
    s.write_all({"id": i, "name": "x"} for i in range(250))
    assert not list(tmp_path.glob("*.parquet"))
    paths = s.commit()
    assert [pq.read_metadata(p).num_rows for p in paths] == [100, 100, 50] and len(set(paths)) == 3 and s.rotations == ["row_count"] * 2
    s.write_all({"id": i, "name": "x"} for i in range(120))
    gone = s.rollback()
    assert len(gone) == 1 and len(list(tmp_path.glob("*.parquet"))) == 3 and not list((tmp_path / "_staging").iterdir())
    s.close()
    with pytest.raises(SinkClosed):
        s.write({"id": 1, "name": "x"})


def test_sink_rotates_by_time_and_size(tmp_path):
    now = [1000.0]
    s = ParquetSink(str(tmp_path), "ev", PAIR, Rotation(max_seconds=10, batch_rows=1), clock=lambda: now[0], auto_commit=True)
    s.write({"id": 1, "name": "x"})
    now[0] += 11
    s.write({"id": 2, "name": "x"})
    assert s.rotations == ["time"] and len(list(tmp_path.glob("*.parquet"))) == 1
    assert Rotation(max_bytes=5).reason(1, 5, 0) == "size" and Rotation().reason(1, 1, 1) is None


def test_small_batches_share_row_groups(tmp_path):
    s = ParquetSink(str(tmp_path), "ev", PAIR, Rotation(max_rows=250, batch_rows=1), row_group=100)
    s.write_all({"id": i, "name": "x"} for i in range(300))
    meta = [pq.read_metadata(p) for p in s.commit()]
    assert [[m.row_group(g).num_rows for g in range(m.num_row_groups)] for m in meta] == [[100, 100, 50], [50]]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.integers(0, 12), max_size=40), st.integers(1, 7), st.integers(1, 30), st.integers(1, 400), st.integers(1, 60), st.lists(st.integers(0, 15), max_size=12),
    st.booleans(),
)
def test_batches_go_where_rows_go(gaps, batch_rows, max_rows, max_bytes, max_seconds, cuts, first_by_row):
    times = [100 + sum(gaps[: i + 1]) for i in range(len(gaps))]
    found, schema = [], pa.schema([pa.field("id", pa.int64())])
    for arrow in (False, True):
        now = [0.0]
        with tempfile.TemporaryDirectory() as at:
            s = ParquetSink(at, "ev", schema, Rotation(max_rows, max_bytes, max_seconds, batch_rows), clock=lambda: now[0], row_group=5)
            if arrow:
                t, rest = pa.table({"id": pa.array(range(len(times)), pa.int64()), "us": pa.array([x * 1_000_000 for x in times], pa.int64())}), []
                if first_by_row and times:
                    now[0] = times[0]
                    s.write({"id": 0})
                    t = t.slice(1)
                for n in cuts:
                    rest, t = [*rest, t.slice(0, n)], t.slice(n)
                s.write_batches([*rest, t], at="us")
            else:
                for i, x in enumerate(times):
                    now[0] = x
                    s.write({"id": i})
            now[0] = times[-1] if times else 0
            found.append(([(Path(p).name, pq.read_table(p)["id"].to_pylist()) for p in s.commit()], s.rotations))
    assert found[0] == found[1] and [i for _, ids in found[0][0] for i in ids] == list(range(len(times)))


def test_rotation_by_time_query(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    day, first = timedelta(days=1), datetime(2024, 1, 1, 0, 0, 0, 123457)
    for k, ts in enumerate(([], [None, None], [first, first + day, first + day, first + 2 * day - timedelta(microseconds=1), first + 2 * day, None, first + 9 * day, first - 20_000 * day])):
        sf = tmp_path / str(k)
        sf.mkdir()
        pq.write_table(pa.table({"event_id": pa.array(range(len(ts)), pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "props": pa.array(["x"] * len(ts), pa.string())}), sf / "events.parquet")
        want = duckdb.sql(e.oracle_sql()["rotate_by_time"].replace("FROM events", f"FROM '{sf}/events.parquet'")).fetchall()
        assert rows(e.queries()["rotate_by_time"](spark, str(sf)), "file_no", "n") == sorted(want, key=repr), ts


@pytest.mark.parametrize("auto", [True, False])
def test_sink_recovers(tmp_path, auto):
    staging = tmp_path / "_staging"
    staging.mkdir()
    pq.write_table(pa.table({"id": [1], "name": ["x"]}), staging / "ev.1.parquet")
    pq.write_table(pa.table({"id": [1], "name": ["x"]}), staging / "ev_other.1.parquet")
    (staging / "ev.2.parquet").write_bytes(b"PAR1 cut")
    (staging / "ev.3.parquet.tmp").write_bytes(b"PAR1")
    ParquetSink(str(tmp_path), "ev", PAIR, auto_commit=auto)
    assert [p.name for p in staging.iterdir()] == ["ev_other.1.parquet"]
    assert (tmp_path / "ev.1.parquet").exists() == auto


def test_bulk_writer_and_ordinals(spark, tmp_path):
    write_files(spark.range(1000).coalesce(1), str(tmp_path / "o"), max_rows=300, row_group=100)
    metas = [pq.read_metadata(p) for p in sorted((tmp_path / "o").glob("*.parquet"))]
    assert sorted(m.num_rows for m in metas) == [100, 300, 300, 300] and all(m.num_row_groups == m.num_rows // 100 for m in metas)
    got = file_ordinals(spark.range(250).toDF("id"), ["id"], Rotation(max_rows=100, batch_rows=30)).groupBy("file_no").count()
    assert rows(got) == [(0, 120), (1, 120), (2, 10)]


def test_lake_sink(spark, catalog, tmp_path):
    t = make(catalog)
    s = LakeSink(t, "events", str(tmp_path / "wal"))
    s.write_all({"id": i, "name": "x"} for i in range(5))
    assert t.scan().count() == 0 and s.rollback() == []
    s.write_all({"id": i, "name": "x"} for i in range(3))
    assert s.commit() and t.scan().count() == 3 and s.commit() == []
    # what was recorded but not committed is committed once; other labels are left
    entries = t.write_files(pair(spark, [7]))
    s.wal.record("events", t.location, "main", entries)
    s.wal.record("events-raw", t.location, "main", t.write_files(pair(spark, [8])))
    assert LakeSink(t, "events", str(tmp_path / "wal")).recover() == 0 and t.scan().count() == 4
    assert len(s.wal.pending("events-raw")) == 1


def test_failed_commits_are_told(spark, catalog, tmp_path, monkeypatch):
    t = make(catalog)
    s = LakeSink(t, "e", str(tmp_path / "wal"))
    monkeypatch.setattr(t, "commit_files", lambda *a: (_ for _ in ()).throw(CommitConflict("no")))
    s.write({"id": 1, "name": "x"})
    with pytest.raises(CommitConflict):
        s.commit()
    monkeypatch.undo()
    assert LakeSink(t, "e", str(tmp_path / "wal")) and t.scan().count() == 1


def test_lake_sink_by_branch(spark, catalog, tmp_path):
    t = make(catalog, wap=True)
    t.append(pair(spark, [1]))
    s = LakeSink(t, "e", str(tmp_path / "wal"), wap=True, auto_publish=False)
    s.write({"id": 2, "name": "x"})
    s.commit()
    assert t.scan().count() == 1
    s.publish()
    assert t.scan().count() == 2


# -- pollers


def test_file_poller(spark, tmp_path):
    root = tmp_path / "in"
    loose_files(spark, root, 3)
    loose_files(spark, root, 1, "events_v2")
    (root / "events.1500.parquet").write_bytes(b"")
    pq.write_table(pa.table({"id": [1]}), root / "events.1002.c.parquet")
    seen = []
    p = poll.FilePoller(spark, str(root), "events", "p", str(tmp_path / "state"), lambda f, df: seen.append((f.millis, df.count())))
    p.poll()
    assert seen == [(1000, 2), (1001, 2), (1002, 2)] and p.failed[str(next(iter(p.failed)))][1] == "empty"
    p.poll()
    assert len(seen) == 3
    pq.write_table(pa.table({"id": [1]}), root / "events.1001500.parquet")
    pq.write_table(pa.table({"id": [1]}), root / "events.1003.parquet")
    again = poll.FilePoller(spark, str(root), "events", "p", str(tmp_path / "state"), lambda f, df: seen.append((f.millis, df.count())))
    again.poll()
    assert seen[3:] == [(1003, 1), (1001500, 1)]
    pq.write_table(pa.table({"id": [1]}), root / "events.1004.parquet")  # later than the offset allows
    again.poll()
    assert len(seen) == 5
    boom = poll.FilePoller(spark, str(root), "events", "q", str(tmp_path / "state"), lambda f, df: 1 / 0, attempts=2)
    assert boom.poll() == [] and boom.poll() == [] and all(n == 2 for n, _ in boom.failed.values())


def test_file_poller_publishes_rows_with_state(spark, tmp_path):
    root, state = tmp_path / "in", str(tmp_path / "state")
    loose_files(spark, root, 3)

    def consume(f, df):
        return df.withColumn("x", F.raise_error(F.lit("late"))) if f.millis == 1001 else df.where("id % 2 = 0").select("id", F.lit(f.millis).alias("ms"))

    p = poll.FilePoller(spark, str(root), "events", "p", state, consume)
    assert p.rows() is None
    assert [f.millis for f in p.poll()] == [1000, 1002] and len(p.failed) == 1  # rows that fail when they are written are their file's failure
    assert rows(p.rows()) == [(0, 1000), (2, 1002)] and p.state.manifest()[0] == 1
    other = poll.FilePoller(spark, str(root), "events", "q", state, lambda f, df: df.select("name"))
    other.poll()
    assert other.rows().count() == 6
    again = poll.FilePoller(spark, str(root), "events", "p", state, lambda f, df: df.select("id", F.lit(f.millis).alias("ms"), F.lit("more").alias("y")))
    again.poll()
    again.poll()
    again.clean(keep=1)
    assert rows(again.rows()) == [(0, 1000, None), (1, 1001, "more"), (2, 1001, "more"), (2, 1002, None)]


def test_file_poller_publishes_nothing_if_another_took_the_file(spark, tmp_path):
    root, state = tmp_path / "in", str(tmp_path / "state")
    loose_files(spark, root, 1)
    first = poll.FilePoller(spark, str(root), "events", "p", state, lambda f, df: df)
    second = poll.FilePoller(spark, str(root), "events", "p", state, lambda f, df: (first.poll(), df)[1])
    with pytest.raises(Conflict):
        second.poll()
    assert first.rows().count() == 2 and len(list((tmp_path / "state" / "data").iterdir())) == 2
    third = poll.FilePoller(spark, str(root), "events", "q", state, lambda f, df: (poll.FilePoller(spark, str(root), "events", "r", state, lambda f, df: df).poll(), df)[1])
    assert len(third.poll()) == 1 and third.rows().count() == 2 and first.rows().count() == 2


def test_file_poller_tries_old_failures_again(spark, tmp_path):
    root, state, hour = tmp_path / "in", str(tmp_path / "state"), 3_600_000
    root.mkdir()
    for i in range(6):  # a backlog of hours
        pq.write_table(pa.table({"id": [i]}), root / FileMeta.name("events", 1000 + i * hour))
    (root / "events.1000.parquet").write_bytes(b"")
    fails = {1000 + hour: 1, 1000 + 2 * hour: 9}

    def consume(f, df):
        fails[f.millis] = fails.get(f.millis, 0) - 1
        if fails[f.millis] >= 0:
            raise ValueError("not now")
        return df

    new = lambda: poll.FilePoller(spark, str(root), "events", "p", state, consume)
    p = new()
    assert [f.millis // hour for f in p.poll()] == [3, 4, 5] and [n for n, _ in p.failed.values()] == [1, 1, 1]
    pq.write_table(pa.table({"id": [0]}), root / "events.1000.parquet")
    p = new()  # another instance knows what failed
    assert [f.millis // hour for f in p.poll()] == [0, 1] and [n for n, _ in p.failed.values()] == [2]
    assert new().poll() == [] and new().poll() == []
    assert fails[1000 + 2 * hour] == 6  # three attempts and no more
    assert rows(p.rows()) == [(0,), (1,), (3,), (4,), (5,)]


def test_stream_leaves_compacted_files_alone(spark, tmp_path, catalog):
    root, schema = tmp_path / "in", "id long, name string"
    loose_files(spark, root, 3)
    pq.write_table(pa.table({"id": [9], "name": ["one digit"]}), root / "events.5.parquet")
    t = catalog.create(TableConfig(TableSchema(spark.createDataFrame([], schema).schema, namespace="a", table="streamed")))
    turn = lambda: stream_to_table(poll.stream_files(spark, str(root), "events", schema), t, str(tmp_path / "progress")).awaitTermination()
    turn()
    before = rows(t.scan())
    assert len(before) == 7
    assert FileCompactor(spark, str(root), "events").run().files_created == 1
    turn()
    assert rows(t.scan()) == before


def test_lookback():
    assert poll.Lookback(start_ms=5).after(None, 100) == 5 and poll.Lookback(start_ms=5).after(1_000_000, 0) == 400_000
    assert poll.Lookback(most_ms=30).after(None, 100) == 70 and poll.Lookback(most_ms=30).after(600_010, 100) == 70


def test_retention(spark):
    d = lambda i: datetime(2024, 1, 1, 0, i // 60, i % 60)
    data = [("p", f"f{i}", "a", d(i), None) for i in range(150)] + [("p", f"g{i}", "b", d(i), None) for i in range(100)]
    df = spark.createDataFrame(data, "process_name string, file_name string, file_type string, file_timestamp timestamp_ntz, processed_at timestamp_ntz")
    kept = poll.retained(df, now=datetime.fromtimestamp(1_800_000_000))
    assert rows(kept.groupBy("file_type").count()) == [("a", 101), ("b", 100)]


def test_state_is_cleaned(spark, tmp_path):
    loose_files(spark, tmp_path / "in", 4)
    p = poll.FilePoller(spark, str(tmp_path / "in"), "events", "p", str(tmp_path / "state"), lambda f, df: None, offset_ms=0)
    p.poll()
    p.clean(keep=2)
    assert p.state.read().count() == 3 and p.poll() == []


def test_upload(spark, tmp_path):
    up = FileUpload(spark, str(tmp_path / "store"), wait=0.01, attempts=2)
    for i in range(7):
        (tmp_path / f"f{i}").write_bytes(b"x" * i)
        up.submit(str(tmp_path / f"f{i}"))
    up.submit(str(tmp_path / "absent"))
    assert len(up.drain()) == 7 and (tmp_path / "store" / "f3").read_bytes() == b"xxx" and not (tmp_path / "f3").exists()
    (tmp_path / "g").write_bytes(b"x")
    bad = FileUpload(spark, "nosuch://x", wait=0.01, attempts=2)
    bad.submit(str(tmp_path / "g"))
    with pytest.raises(Exception):
        bad.drain()
    assert (tmp_path / "g").exists()


def test_settings():
    s = Settings.parse('bucket = "b"\nendpoint = "http://x"')
    assert s.region == "us-west-2" and s.root == "s3a://b" and s.spark_conf()["spark.hadoop.fs.s3a.bucket.b.path.style.access"] == "true"
    for bad in ("", 'bucket = "b"\nwhat = 1'):
        with pytest.raises(TypeError):
            Settings.parse(bad)


def test_snapshot_poller(spark, catalog):
    t = make(catalog)
    p = poll.SnapshotPoller(t)
    assert p.poll() is None
    t.append(pair(spark, [1]))
    d = p.poll()
    t.append(pair(spark, [2]))
    assert p.poll() is d  # not acknowledged: the same again
    d.ack()
    d = p.poll()
    assert rows(d.rows, "id") == [(2,)]
    d.ack()
    assert p.poll() is None
    assert rows(next(poll.SnapshotPoller(t, t.earliest().id).deltas()).rows, "id") == [(2,)]


# -- command line and counters


def test_commands(spark, catalog, tmp_path, capsys):
    t = make(catalog)
    for k in range(5):
        t.append(pair(spark, [k]).coalesce(1))
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)
    assert [json.loads(x)["id"] for x in run("scan", t.location, "--filter", "id >= 3", "--columns", "id", "--limit", "9")[1].splitlines()] == [3, 4]
    assert json.loads(run("table-compact", t.location)[1])["files_in"] == 5
    assert json.loads(run("info", t.location)[1])["snapshots"] == 6
    loose_files(spark, tmp_path / "in")
    assert json.loads(run("compact", str(tmp_path / "in"), "events", "--plan")[1])["files_processed"] == 6
    assert json.loads(run("compact", str(tmp_path / "in"), "events")[1])["records"] == 12
    assert run("compact", str(tmp_path / "in"), "events", "--start", "5", "--end", "5")[0] == 2


def test_counters(spark):
    c = Counters()
    c.add("x", 2, "a")
    c.add("x", 3, "a")
    c.set("y", 7)
    with c.timed("t"):
        pass
    assert {(r["name"], r["label"]): (r["times"], r["total"]) for r in c.table(spark).collect()}["x", "a"] == (2, 5.0)
    df, o = observed(spark.range(7), "n")
    df.collect()
    assert o.get["rows"] == 7


# -- stores, bounds, timers


@pytest.fixture
def mounted(spark, tmp_path):
    """A folder under another Hadoop scheme than that of local disks."""
    (tmp_path / "disk").mkdir()
    name = f"lake{random.randrange(10**9)}"  # file systems are cached by name
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./data", f"file://{tmp_path}/disk")
    return f"viewfs://{name}/data"


def test_tables_on_another_store(spark, mounted):
    c = Catalog(spark, f"{mounted}/w")
    t = c.create(TableConfig(TableSchema(PAIR, namespace="a", table="t")))
    with pytest.raises(FileExistsError):
        c.create(TableConfig(TableSchema(PAIR, namespace="a", table="t")))
    for i in range(5):
        t.append(pair(spark, [i, 10 + i]))
    e = t.log.live(t.metadata(), t.current().id)
    assert all(x.path.startswith("viewfs:") and x.high["id"] == x.low["id"] + 10 or x.rows == 1 for x in e)
    assert {p.split(":")[0] for p in t.scan(filters=["id >= 14"]).inputFiles()} == {"viewfs"} and t.scan(filters=["id >= 14"]).count() == 1
    assert compact_table(t).files_in == len(e) and t.scan().count() == 10
    sink = LakeSink(t, "s", f"{mounted}/wal")
    sink.wal.record("s", t.location, "main", t.write_files(pair(spark, [99])))
    assert LakeSink(t, "s", f"{mounted}/wal").table.scan().count() == 11 and not sink.wal.pending("s")


def test_loose_files_on_another_store(spark, mounted, tmp_path):
    loose_files(spark, tmp_path / "disk" / "in")
    (tmp_path / "disk" / "in" / "events.5000.parquet").write_bytes(b"PAR1xxxxPAR2")
    job = FileCompactor(spark, f"{mounted}/in", "events", dedup=True)
    plan, r = job.plan(), job.run()
    assert (plan.records, plan.duplicates_eliminated) == (r.records, r.duplicates_eliminated) == (7, 5) and len(r.skipped) == len(plan.skipped) == 1
    assert plan.bytes_out == r.bytes_out != r.bytes_in and not list((tmp_path / "disk" / "in" / "_compaction").glob("*"))
    assert loose.read(spark, r.outputs).count() == 7


def test_a_store_without_atomic_creation_is_refused(spark, tmp_path, monkeypatch):
    store = Storage(spark)
    assert store.create(str(tmp_path / "a" / "x"), "1") and not store.create(str(tmp_path / "a" / "x"), "2")
    assert store.read(str(tmp_path / "a" / "x")) == "1" and [p.name for p in (tmp_path / "a").iterdir() if "tmp" in p.name and "crc" not in p.name] == []
    monkeypatch.setattr(Storage, "_scheme", staticmethod(lambda fs: "nowhere"))
    with pytest.raises(UnsupportedStore):
        store.create(str(tmp_path / "a" / "y"), "1")
    assert not (tmp_path / "a" / "y").exists()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("X", (), {"getCheckpointDir": staticmethod(lambda: type("Y", (), {"isEmpty": staticmethod(lambda: True)}))})

    with pytest.raises(RuntimeError):
        checkpoint_dir(type("S", (), {"sparkContext": Context}))


def test_footers_by_threads_and_by_a_job(spark, tmp_path):
    loose_files(spark, tmp_path)
    (tmp_path / "events.2000.parquet").write_bytes(b"")
    paths = [str(p) for p in sorted(tmp_path.glob("*.parquet"))] + [str(tmp_path / "missing")]
    a, b = loose.footers(spark, paths), loose.footers(spark, paths, on_driver=1)
    assert a == b and [a[p].rows for p in paths] == [2] * 6 + [0, 0] and [a[p].error for p in paths[6:]] == ["empty", "missing"]


TYPED = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("n", T.TimestampNTZType()), T.StructField("d", T.DateType()), T.StructField("m", T.DecimalType(10, 2)), T.StructField("s", T.StringType())])


@pytest.mark.parametrize("part", [(), (PartitionField("d", Transform.parse("month")),), (PartitionField("id", Transform.parse("bucket[4]")),), (PartitionField("s", Transform.parse("truncate[2]")), PartitionField("n", Transform.parse("day")))], ids=["plain", "month", "bucket", "two"])
def test_pruned_scans_lose_no_row(spark, catalog, part):
    t = make(catalog, TYPED, partitions=part)
    data = [(i, datetime(2024, 1 + i % 3, 1 + i, 12), datetime(2024, 1 + i % 3, 1 + i, 12), date(2024, 1 + i % 3, 1 + i), Decimal(i) / 4, f"name{i:02d}") for i in range(24)] + [(None,) * 6]
    for k in range(4):
        t.append(spark.createDataFrame(data[k::4], TYPED))
    everything = spark.createDataFrame(data, TYPED)
    fewer = 0
    for column, values in {"id": ["7", "100"], "ts": ["2024-02-05", "2024-02-05 12:00:00"], "n": ["2024-02-05T12:00:00", "2024-03-30"], "d": ["2024-02-05", "2025-01-01"], "m": ["2.5", "3", "99.25"], "s": ["name07", "zzz"]}.items():
        for v in values:
            for op in ("=", "!=", "<", "<=", ">", ">="):
                df = t.scan(filters=[f"{column} {op} {v}"])
                assert rows(df, "id") == rows(everything.where(Predicate.parse(f"{column} {op} {v}").expression()), "id"), (column, op, v)
                fewer += len(df.inputFiles()) < len(t.scan().inputFiles())
    assert fewer > 30


def test_partitions_compact_to_a_target_size(spark, catalog):
    t = make(catalog, PAIR, partitions=(PartitionField("id", Transform.parse("truncate[1000]")),))
    for k in range(5):
        t.append(pair(spark, range(k, 3000, 5)))
    before = t.files().groupBy("partition").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0]
    r = compact_table(t, target_bytes=before // 2)
    assert r.files_in == 15 and 6 <= r.files_out <= 12 and t.scan().count() == 3000


def test_sinks_rotate_without_rows(spark, catalog, tmp_path):
    sink = ParquetSink(str(tmp_path / "out"), "p", pa.schema([("x", pa.int64())]), Rotation(max_seconds=0.05), auto_commit=True, check_seconds=0.02)
    sink.write({"x": 1})
    until = time.time() + 20
    while not list((tmp_path / "out").glob("p.*.parquet")) and time.time() < until:
        time.sleep(0.02)
    assert sink.rotations == ["time"] and sink.close() == [] and len(list((tmp_path / "out").glob("p.*.parquet"))) == 1
    t = make(catalog)
    lake_sink = LakeSink(t, "s", str(tmp_path / "wal"), Rotation(max_seconds=0.05), auto_commit=True, check_seconds=0.02)
    lake_sink.write({"id": 1, "name": "a"})
    while (t.current() is None) and time.time() < until:
        time.sleep(0.05)
    lake_sink.close()
    assert lake_sink.rotations == ["time"] and t.scan().count() == 1


def test_lake_sink_counts_bytes_and_rolls_back_files(spark, catalog, tmp_path):
    t = make(catalog)
    sink = LakeSink(t, "s", str(tmp_path / "wal"), Rotation(max_bytes=2000, batch_rows=50))
    sink.write_all({"id": i, "name": "x" * 20} for i in range(300))
    assert set(sink.rotations) == {"size"} and sink.staged and t.current() is None
    gone = sink.rollback()
    assert gone and not any(t.storage.exists(p) for p in gone) and sink.commit() == []
    sink.write_all({"id": i, "name": "x" * 20} for i in range(300))
    sink.close()
    assert t.scan().count() == 300 and len(t.snapshots().collect()) == 1


def test_lake_sink_takes_batches_as_rows(spark, catalog, tmp_path):
    t = make(catalog)
    data, found = [{"id": i, "name": "x" * (i % 40)} for i in range(1000)], []
    for how in (Rotation(max_bytes=4000, batch_rows=30), Rotation(max_rows=130, batch_rows=50), Rotation(max_rows=7, batch_rows=50)):
        for arrow in (False, True):
            sink = LakeSink(t, "s", str(tmp_path / "wal"), how)
            if arrow:
                sink.write_all(data[:20])
                sink.write_batches(pa.Table.from_pylist(data[a:b], pa.schema([("id", pa.int64()), ("name", pa.string())])) for a, b in ((20, 20), (20, 333), (333, 340), (340, 1000)))
            else:
                sink.write_all(data)
            found.append([len(sink.rotations), sink.rotations[0], [e.rows for e in sink.staged], sink.held_rows])
            assert len(sink.staged) == len(sink.rotations) > 2  # a file for each, and no job
            sink.close()
            assert rows(t.scan(snapshot_id=t.current().id)) and t.current().summary["added-records"] == 1000
        assert found[-1] == found[-2]
    assert rows(t.scan()) == sorted([(x["id"], x["name"]) for x in data for _ in range(6)], key=repr)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_rows_written_by_arrow_are_found(spark, catalog, zone):
    struct = T.StructType([*TYPED, T.StructField("x", T.DoubleType()), T.StructField("b", T.BinaryType()), T.StructField("y", T.ByteType())])
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = make(catalog, struct)
        t.evolve(TableSchema(T.StructType([f for f in struct if f.name != "s"]), namespace="a.b", table="t"))
        t.evolve(TableSchema(struct, namespace="a.b", table="t"))  # the column has another name in files now
        assert [c.stored for c in t.metadata().columns if c.name == "s"] != ["s"]
        times = [datetime(1899, 1, 1 + i, 12) if i % 5 == 0 else datetime(2024, 1 + i % 3, 1 + i, 12) for i in range(24)]
        data = [(i, v, v, v.date(), Decimal(i) / 4, f"name{i:02d}", float("nan") if i == 9 else i / 2, b"\x00" * i, i) for i, v in enumerate(times)] + [(None,) * 9]
        for k in range(4):
            assert len(t.commit_files(t.write_arrow(spark.createDataFrame(data[k::4], struct).toArrow())).summary) > 0
        everything = spark.createDataFrame(data, struct)
        assert str(rows(t.scan())) == str(rows(everything)) and len(t.scan().inputFiles()) == 4
        fewer = 0
        for f in ("x > 11.5", "x >= 100", "x < 1", "x = 2.5", "id >= 22", "s = name07", "m >= 5.75", "d < 1950-01-01", "ts >= 2024-03-20 00:00:00", "n < 1899-01-02T00:00:00"):
            df = t.scan(["id"], filters=[f])
            assert rows(df) == rows(everything.where(Predicate.parse(f).expression()).select("id")), f
            fewer += len(df.inputFiles()) < 4
        assert fewer > 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_arrow_of_other_tables_goes_by_spark(spark, catalog):
    nested = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.ArrayType(T.StringType())), T.StructField("m", T.MapType(T.StringType(), T.IntegerType()))])
    for k, (struct, how) in enumerate(((PAIR, {"partitions": (PartitionField("id", Transform.parse("truncate[100]")),)}), (PAIR, {"sort": (SortField("id", descending=True),)}), (nested, {}))):
        t = catalog.create(TableConfig(TableSchema(struct, namespace="a", table=f"t{k}", **how)))
        df = pair(spark, range(300)) if struct is PAIR else spark.createDataFrame([(i, ["a"] * (i % 3), {"k": i}) for i in range(300)], struct)
        t.commit_files(t.write_arrow(df.toArrow()))
        assert rows(t.scan()) == rows(df) and (k or {e.partition[f.name] for f in t.metadata().partitions for e in t.log.live(t.metadata(), t.current().id)} == {"0", "100", "200"})
    t = make(catalog)
    assert t.write_arrow(pair(spark, []).toArrow()) == []
    with pytest.raises(SchemaError):
        t.write_arrow(pa.table({"id": pa.array([1], pa.int64()), "other": ["x"]}))
    t.commit_files(t.write_arrow(pa.table({"id": pa.array([1], pa.int64())})))
    assert rows(t.scan()) == [(1, None)]


def test_branch_commits_are_taken_up(spark, catalog, tmp_path):
    t = make(catalog, wap=True)
    wal = str(tmp_path / "wal")
    sink = LakeSink(t, "s", wal, wap=True)
    for wap_id, publish, commits in (("a", True, False), ("b", True, True), ("c", False, False)):
        entries = t.write_files(pair(spark, [ord(wap_id)]))
        sink.wal.record("s", t.location, f"wap-{wap_id}", entries, wap_id, publish)
        if commits:
            WapTransaction(t, wap_id).commit(entries)
        last = LakeSink(t, "s", wal, wap=True)
        assert not last.wal.pending("s")
    assert rows(t.scan(), "id") == [(ord("a"),), (ord("b"),)]
    last.publish()
    assert t.scan().count() == 3


def test_a_delta_held_too_long_comes_again(spark, catalog):
    t = make(catalog)
    t.append(pair(spark, [1]))
    p, stop, go = poll.SnapshotPoller(t), threading.Event(), threading.Event()
    with pytest.raises(TimeoutError):
        p.run(lambda d: go.wait(10), stop, every=0.01, timeout=0.2)
    go.set()
    seen = []

    def take(d):
        seen.append(d.snapshot.id)
        if len(seen) == 2:
            d.ack()
            stop.set()

    p.run(take, stop, every=0.01)
    assert seen == [t.current().id] * 2 and p.poll() is None


def test_what_is_counted(spark, tmp_path):
    loose_files(spark, tmp_path)
    before = {n: v[1] for (n, _), v in counters.values.items()}
    loose.read(spark, [str(tmp_path / "events.1000.parquet"), str(tmp_path / "gone")], strict=False)
    list(loose.stream_items(loose.read(spark, [str(tmp_path / "events.1000.parquet")]), lambda **r: r))
    loose.raw_bytes(spark, str(tmp_path / "events.1000.parquet"))
    now = {n: v[1] for (n, _), v in counters.values.items()}
    grown = {n: now[n] - before.get(n, 0) for n in now}
    assert (grown["source.files"], grown["source.errors"], grown["source.rows"]) == (2, 1, 2) and grown["source.bytes"] > 12 and grown["source.seconds"] > 0
    assert set(now) <= set(NAMES) | {n for n in before if n not in NAMES}


def test_a_hint_may_lag_or_be_broken(spark, catalog):
    t = make(catalog)
    for k in range(3):
        t.append(pair(spark, [k]).coalesce(1))
    hint = f"{t.location}/metadata/newest.txt"
    for text in ("0", "1", "", "x1", "99"):
        t.storage.write(hint, text)
        assert t.log.version() == 3 and t.scan().count() == 3
    t.storage.delete(hint)
    assert t.log.version() == 3 and t.append(pair(spark, [9])) and t.log.version() == 4 and t.storage.read(hint) == "4"


def test_old_snapshots_expire(spark, catalog):
    t = catalog.create(TableConfig(TableSchema(PAIR, namespace="a.b", table="t"), max_snapshot_age_ms=1000, min_snapshots=2))
    s = [t.append(pair(spark, [k, 100 + k]).coalesce(1), timestamp_ms=1000 * (k + 1)) for k in range(12)]
    t.create_branch("b")
    t.append(pair(spark, [50]), branch="b", timestamp_ms=12_500)
    before = rows(t.scan()), rows(t.scan(branch="b")), rows(t.scan_range(s[10].id))
    assert len(t.expire(now_ms=11_000)) == 9 and t.expire(now_ms=11_000) == []
    assert (rows(t.scan()), rows(t.scan(branch="b")), rows(t.scan_range(s[10].id))) == before and len(t.snapshots().collect()) == 4
    assert t.scan(snapshot_id=s[10].id).count() == 22 and t.expire(now_ms=10**9) == [s[9].id] == [x.id for x in s[9:10]]
    with pytest.raises(NoSuchSnapshot):
        t.scan(snapshot_id=s[3].id)
    t.append(pair(spark, [13]), timestamp_ms=20_000)
    assert compact_table(t, min_files=2).files_in == 13 and t.scan().count() == 25 and t.publish_branch  # history goes on


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from([None, {}, {"a": 1}, {"b": 2, "a": 1}, {"a": 1, "b": 2}])), max_size=12))
def test_first_rows_with_maps(spark, data):
    df = spark.createDataFrame([(i, k, m) for i, (k, m) in enumerate(data)], "id long, k long, m map<string,int>")
    seen, want = set(), []
    for i, (k, m) in enumerate(data):
        key = k, None if m is None else tuple(sorted(m.items()))
        if key not in seen:
            seen.add(key)
            want.append((i, k, m))
    assert rows(dedup.first_rows(df, ["k", "m"], ["id"])) == sorted(want, key=repr)
