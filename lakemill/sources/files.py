"""Parquet files outside tables: listing by name and time, reads in order or not, raw bytes, Arrow, and checks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, TypeVar

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions.naming import FileMeta, NameError_
from lakemill.sources.storage import Storage
from lakemill.stats import counters

#: So many files are looked at on the driver; more on local disks by a job.
MANY = 256
#: A Parquet file has at least its two magic numbers and a footer length.
SMALLEST = 12
CODECS = ("snappy", "gzip", "lz4", "lz4_raw", "zstd", "uncompressed")
Item = TypeVar("Item")


class UnsupportedCodec(ValueError):
    pass


class BadParquet(ValueError):
    pass


def check_codec(codec: str) -> str:
    if codec.lower() not in CODECS:
        raise UnsupportedCodec(f"unsupported codec {codec!r}; there are {', '.join(CODECS)}")
    return codec.lower()


def list_files(spark: SparkSession, root: str, prefix: str | None = None, after_ms: int | None = None, until_ms: int | None = None) -> list[FileMeta]:
    """Data files below ``root`` of exactly this prefix with ``after < time <= until``, by time and key; other names are skipped."""
    out = []
    for path, size, _ in Storage(spark).files(root):
        try:
            f = FileMeta.parse(path, size)
        except NameError_:
            continue
        if (prefix is None or f.prefix == prefix) and (after_ms is None or f.millis > after_ms) and (until_ms is None or f.millis <= until_ms):
            out.append(f)
    return sorted(out, key=lambda f: (f.millis, f.key))


def window(files: DataFrame, after_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """The same window over a listing that is a table (see ``operators.listing``)."""
    if after_ms is not None:
        files = files.where(F.col("millis") > after_ms)
    return files if until_ms is None else files.where(F.col("millis") <= until_ms)


def check_sizes(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """path -> why it can't be a Parquet file, by its length and magic numbers (of many files, by its footer); nothing for good files."""
    if len(paths) > MANY and None not in map(local_path, paths):
        return {p: f.error for p, f in footers(spark, paths).items() if f.error}
    store = Storage(spark)

    def one(path: str) -> str | None:
        fs, p = store._at(path)
        if not fs.exists(p):
            return "missing"
        n = fs.getFileStatus(p).getLen()
        if n == 0:
            return "empty"
        if n < SMALLEST:
            return "too short"
        stream = fs.open(p)
        try:
            stream.seek(n - 4)
            return None if bytes(stream.readNBytes(4)) == b"PAR1" else "no footer"
        finally:
            stream.close()

    with ThreadPoolExecutor(8) as pool:
        return {p: why for p, why in zip(paths, pool.map(one, paths), strict=True) if why}


@dataclass(frozen=True)
class Footer:
    """What a file's footer says; ``error`` says why it can't be read."""

    rows: int = 0
    schema: pa.Schema | None = None
    error: str | None = None


def _footer(path: str, length: int | None, source: Any) -> Footer:
    if length is None:
        return Footer(error="missing")
    if length < SMALLEST:
        return Footer(error="too short" if length else "empty")
    try:
        f = pq.ParquetFile(source())
        return Footer(f.metadata.num_rows, f.schema_arrow)
    except (pa.ArrowException, OSError) as e:
        return Footer(error=f"no footer: {e}"[:300])


def local_path(path: str) -> str | None:
    """The path on a local disk; None for other stores."""
    return path if path.startswith("/") else "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def footers(spark: SparkSession, paths: list[str], on_driver: int = MANY) -> dict[str, Footer]:
    """path -> footer, each file opened once: on the driver by threads, of more than ``on_driver`` files on local disks by a job.

    Other stores are read through Hadoop's file systems, which only the driver reaches.
    """
    local = [local_path(p) for p in paths]
    if len(paths) <= on_driver or None in local:
        store = Storage(spark)

        def one(path: str) -> Footer:
            at = local_path(path)
            if at is not None:
                return _footer(path, os.path.getsize(at) if os.path.exists(at) else None, lambda: at)
            return _footer(path, store.length(path), lambda: store.open(path))

        with ThreadPoolExecutor(16) as pool:
            return dict(zip(paths, pool.map(one, paths), strict=True))

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [_footer(p, os.path.getsize(p) if os.path.exists(p) else None, lambda p=p: p) for p in f["at"]]
            yield pd.DataFrame({"path": f["path"], "rows": [g.rows for g in got], "schema": [g.schema.serialize().to_pybytes() if g.schema is not None else None for g in got], "error": [g.error for g in got]})

    df = spark.createDataFrame(list(zip(paths, local, strict=True)), "path string, at string").repartition(max(1, len(paths) // 64))
    got = df.mapInPandas(some, "path string, rows long, schema binary, error string").collect()  # one row per file
    return {r["path"]: Footer(r["rows"], pa.ipc.read_schema(pa.py_buffer(r["schema"])) if r["schema"] is not None else None, r["error"]) for r in got}


def read(spark: SparkSession, paths: list[str], schema: T.StructType | None = None, strict: bool = True, ordered: bool = False, checked: bool = False) -> DataFrame:
    """The rows of Parquet files, one read for all. ``checked``: the files are known to be good.

    ``strict``: missing, empty or cut files are an error, else they are left out. ``ordered`` adds ``file_no`` and
    ``row_no``, the order of the list and of rows within a file. No paths: no rows, and ``schema`` is needed.
    """
    with counters.timed("source.seconds"):
        bad = {} if checked else check_sizes(spark, paths)
    counters.add("source.files", len(paths) - len(bad))
    if bad:
        counters.add("source.errors", len(bad))
    if bad and strict:
        raise BadParquet("; ".join(f"{p}: {why}" for p, why in bad.items()))
    good = [p for p in paths if p not in bad]
    if not good:
        if schema is None:
            raise BadParquet("no files and no schema")
        df = spark.createDataFrame([], schema)
        return df.withColumn("file_no", F.lit(0)).withColumn("row_no", F.lit(0).cast("long")) if ordered else df
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if not ordered:
        return reader.parquet(*good)
    store = Storage(spark)
    full = {store._at(p)[0].makeQualified(store._at(p)[1]).toUri().toString(): i for i, p in enumerate(good)}
    rows = [(_plain(p), i) for p, i in full.items()]
    number = spark.createDataFrame(rows, "__path string, file_no int")
    df = reader.parquet(*good)
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    return df.select("*", path.alias("__path"), F.col("_metadata.row_index").alias("row_no")).join(number, "__path").drop("__path")


def _plain(uri: str) -> str:
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def raw_bytes(spark: SparkSession, path: str) -> bytes:
    data = Storage(spark).read_bytes(path)
    counters.add("source.bytes", len(data))
    return data


def items(df: DataFrame, make: type[Item]) -> list[Item]:
    """All rows as objects of a class: for results of known size."""
    got = [make(**r.asDict(recursive=True)) for r in df.collect()]
    counters.add("source.rows", len(got))
    return got


def stream_items(df: DataFrame, make: type[Item]) -> Iterator[Item]:
    """Rows as objects, one partition in memory at a time."""
    for r in df.toLocalIterator():
        counters.add("source.rows")
        yield make(**r.asDict(recursive=True))


def stream_batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow, in order, one partition in memory at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["batch"])

    for r in df.mapInArrow(pack, "batch binary").toLocalIterator():
        for b in pa.ipc.open_stream(pa.py_buffer(r["batch"])):
            counters.add("source.rows", len(b))
            yield b


def from_arrow(spark: SparkSession, source: Any) -> DataFrame:
    """A table, record batches or the path of an Arrow IPC file as a DataFrame."""
    if isinstance(source, str):
        with pa.OSFile(source) as f:
            return spark.createDataFrame(pa.ipc.open_file(f).read_all())
    return spark.createDataFrame(source if isinstance(source, pa.Table) else pa.Table.from_batches(source))


def to_arrow_file(df: DataFrame, path: str) -> int:
    """Writes an Arrow IPC file; the number of rows."""
    t = df.toArrow()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    return t.num_rows


def to_arrow_stream(df: DataFrame, sink: Any) -> int:
    t = df.toArrow()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return t.num_rows
