"""Consolidating small files: which to merge, into which outputs, and the merge by joining bytes.

The plan is a relation (one row per file with its output); the merge copies bytes, never parses records: text files
with newline-delimited records are joined with exactly one newline at each boundary and one header, complete zstandard
frames are joined as they are (a sequence of frames is a valid zstandard stream). Lengths and checksums are checked
against what was read before an output is given its name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.operators.listing import data_files, marked
from lakemill.operators.ordered import Scan, scan

DAY_MS = 86_400_000
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
SKIPPABLE = {bytes([x, 0x2A, 0x4D, 0x18]) for x in range(0x50, 0x60)}


def candidates(listing: DataFrame, smallest: int = 12, small: int = 1 << 20, least: int = 5) -> DataFrame:
    """``key, prefix, day, millis, size`` of the files worth merging.

    A file counts if it is a data file, not compacted, without a ``.processed`` marker, of a known size in
    [``smallest``, ``small``), and if its prefix and UTC day (``day``: days since 1970) hold at least ``least`` such
    files. Each key counts once, with its newest listing row.
    """
    files = data_files(listing).where((~F.col("compacted")) & (F.col("size") >= smallest) & (F.col("size") < small))
    files = files.join(marked(listing), "key", "left_anti").withColumn("day", F.floor(F.col("millis") / DAY_MS).cast("long"))
    full = files.groupBy("prefix", "day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return files.join(full.drop("n"), ["prefix", "day"], "left_semi").select("key", "prefix", "day", "millis", "size")


def plan(files: DataFrame, target: int = 128 << 20, slice_ms: int = 600_000, ending: str = ".c.parquet") -> DataFrame:
    """Gives each file of ``candidates`` its output: adds ``output_no`` and ``output_key`` within prefix and day.

    Files go in order of (millis, key); one belongs to the output in which the bytes before it fall, so outputs are
    between ``target`` less one file and ``target`` plus one file (the last of a day is what is left), and no file is
    lost or taken twice. The running size is a scan over slices of the day, so a hot day is spread. Outputs are named
    by the time of their last file and their number, so no two share a name, and by ``ending``: what the joined bytes are.
    """
    x = scan(files.withColumn("__slice", F.floor(F.col("millis") / slice_ms)), ["prefix", "day"], "__slice", ["millis", "key"], [Scan("before", "size", "sum", "before")])
    x = x.withColumn("output_no", F.floor(F.col("before") / target).cast("long")).drop("before", "__slice")
    last = x.groupBy("prefix", "day", "output_no").agg(F.max("millis").alias("last_millis"), F.count(F.lit(1)).alias("output_files"), F.sum("size").alias("output_bytes"))
    name = F.concat_ws("", F.col("prefix"), F.lit("/"), F.lpad(F.col("day").cast("string"), 6, "0"), F.lit("/"), F.col("prefix"), F.lit("."), (F.col("last_millis") + F.col("output_no")).cast("string"), F.lit(ending))
    return x.join(last, ["prefix", "day", "output_no"]).withColumn("output_key", name)


def outputs(planned: DataFrame) -> DataFrame:
    """One row per output of ``plan``: files, bytes and range of event times."""
    return planned.groupBy("prefix", "day", "output_no", "output_key").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.min("millis").alias("first_millis"), F.max("millis").alias("last_millis"))


class BadFile(ValueError):
    """A source that can't be joined: cut off, of another header, or changed since it was listed."""


def frames_end(data: bytes) -> int:
    """The length of the complete zstandard frames that ``data`` consists of; raises ``BadFile`` if it is anything else.

    Walks frame and block headers only; nothing is decompressed.
    """
    at, n = 0, len(data)

    def need(k: int) -> None:
        if at + k > n:
            raise BadFile("zstandard frame cut off")

    while at < n:
        need(4)
        magic = data[at : at + 4]
        if magic in SKIPPABLE:
            need(8)
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            need(8 + size)
            at += 8 + size
            continue
        if magic != ZSTD_MAGIC:
            raise BadFile("not a zstandard frame")
        at += 4
        need(1)
        head = data[at]
        single, checksum = head >> 5 & 1, head >> 2 & 1
        size = 1 + (0 if single else 1) + (0, 1, 2, 4)[head & 3] + ((1 if single else 0), 2, 4, 8)[head >> 6]
        need(size)
        at += size
        while True:
            need(3)
            block = int.from_bytes(data[at : at + 3], "little")
            length = 1 if block >> 1 & 3 == 1 else block >> 3
            need(3 + length)
            at += 3 + length
            if block & 1:
                break
        need(4 * checksum)
        at += 4 * checksum
    return at


def join_lines(parts: Iterable[bytes], header: bool = False) -> Iterator[bytes]:
    """The bytes of newline-delimited files one after the other, with one newline at each boundary.

    With ``header`` the first line of every file must be the same and is kept once. Empty files add nothing; a byte
    order mark at the start of a file is dropped, line ends inside are left as they are.
    """
    first: bytes | None = None
    for data in parts:
        body = data.removeprefix(b"\xef\xbb\xbf")
        if not body:
            continue
        if header:
            line, sep, rest = body.partition(b"\n")
            line = line.removesuffix(b"\r")
            if first is None:
                first = line
                yield line + b"\n"
            elif line != first:
                raise BadFile("files have different headers")
            body = rest if sep else b""
            if not body:
                continue
        yield body
        if not body.endswith(b"\n"):
            yield b"\n"


def join_frames(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of complete zstandard files one after the other."""
    for data in parts:
        frames_end(data)
        if data:
            yield data


def kept(data: bytes, first: bool, form: str = "lines", header: bool = False) -> list[memoryview | bytes]:
    """What of a file must be in its output, by positions in the file; ``first``: no file before it had content.

    This says apart from the joins what these must yield, so that an output can be checked against its sources.
    """
    view, begin = memoryview(data), 3 if form == "lines" and data[:3] == b"\xef\xbb\xbf" else 0
    if begin == len(data) or form == "zstd":
        return [view[begin:]]
    out: list[memoryview | bytes] = []
    if header:
        end = data.find(b"\n", begin)
        stop = len(data) if end < 0 else end
        if first:
            out += [view[begin : stop - (stop > begin and data[stop - 1] == 13)], b"\n"]
        begin = len(data) if end < 0 else end + 1
    return [*out, view[begin:], *([b"\n"] if begin < len(data) and data[-1] != 10 else [])]


def _store(path: str) -> tuple:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    # tasks reach stores by pyarrow's own clients, which know this scheme by its plain name
    uri = "s3" + path.removeprefix("s3a") if path.startswith("s3a://") else path
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), path)


def concatenate(spark: SparkSession, planned: DataFrame, root: str, out: str, form: str = "lines", header: bool = False) -> DataFrame:
    """Carries out a plan over files below ``root`` that the executors can read; returns a report, one row per output.

    ``planned``: ``output_key, millis, key, size``. Each output is one task's: files are read one at a time, their length
    checked against ``size`` (null: not known), written to a hidden name, read back, checked by length and checksum
    against what the sources must give (see ``kept``) and only then renamed; an output that exists already with this length
    and checksum is left alone, so a repeated task does no harm.
    ``error`` is null or says why an output was not written; then none of its files may be removed.
    """
    join = {"lines": lambda parts: join_lines(parts, header), "zstd": join_frames}[form]

    def merge(key: tuple, files: pd.DataFrame) -> pd.DataFrame:
        import os

        from pyarrow import fs as pafs

        store, base = _store(root)
        dest, dest_base = _store(out)
        read = {"n": 0, "length": 0, "crc": 0}

        def summed(path: str) -> tuple[int, int, str]:
            crc, length, digest = 0, 0, hashlib.sha256()
            with dest.open_input_stream(path) as f:
                while piece := f.read(1 << 20):
                    crc, length = zlib.crc32(piece, crc), length + len(piece)
                    digest.update(piece)
            return length, crc, digest.hexdigest()

        def parts() -> Iterator[bytes]:
            for name, size in zip(files["key"], files["size"], strict=True):
                with store.open_input_stream(f"{base}/{name}") as f:
                    data = f.read()
                if size is not None and not pd.isna(size) and len(data) != int(size):
                    raise BadFile(f"{name}: {len(data)} bytes, listed with {int(size)}")
                for piece in kept(data, not read["length"], form, header):
                    read["length"], read["crc"] = read["length"] + len(piece), zlib.crc32(piece, read["crc"])
                read["n"] += len(data)
                yield data

        files = files.sort_values(["millis", "key"], kind="stable")
        path, error, wrote, digest = f"{dest_base}/{key[0]}", None, 0, None
        tmp = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{os.getpid()}.tmp")
        try:
            dest.create_dir(os.path.dirname(path), recursive=True)
            with dest.open_output_stream(tmp) as f:
                for piece in join(parts()):
                    f.write(piece)
            wrote, crc, digest = summed(tmp)
            if (wrote, crc) != (read["length"], read["crc"]):
                raise BadFile(f"{wrote} bytes were written, checksum {crc}; the sources give {read['length']}, {read['crc']}")
            there = dest.get_file_info(path)
            if there.type == pafs.FileType.File and there.size == wrote and summed(path)[1] == crc:
                dest.delete_file(tmp)
            else:
                dest.move(tmp, path)
        except (BadFile, OSError) as e:
            error = str(e)[:500]
            if dest.get_file_info(tmp).type != pafs.FileType.NotFound:
                dest.delete_file(tmp)
        return pd.DataFrame({"output_key": [key[0]], "n_files": [len(files)], "bytes_in": [read["n"]], "bytes_out": [0 if error else wrote], "sha256": [None if error else digest], "error": [error]})

    return planned.select("output_key", "millis", "key", "size").groupBy("output_key").applyInPandas(merge, "output_key string, n_files long, bytes_in long, bytes_out long, sha256 string, error string")


def write_lines(records: DataFrame, root: str, file: str = "file_key", order: str = "record_id", line: str = "payload") -> DataFrame:
    """Writes each file's lines below ``root`` as it would have come in; ``key, size, n_lines`` of each file.

    Lines go out as they are read, so the longest file needs no memory; null lines are left out, and so is the newline at the
    end of a file unless its last line is empty. A repeated task writes the same bytes again.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        store.create_dir(base, recursive=True)
        now, out, size, n, last = None, None, 0, 0, ""

        def close() -> tuple | None:
            nonlocal size
            if out is None:
                return None
            if n and not last:
                out.write(b"\n")
                size += 1
            out.close()
            return (now, size, n)

        for frame in frames:
            done = []
            for key, text in zip(frame["k"], frame["l"], strict=True):
                if key != now:
                    if (row := close()) is not None:
                        done.append(row)
                    now, out, size, n = key, store.open_output_stream(f"{base}/{key}"), 0, 0
                data = (b"\n" if n else b"") + text.encode()
                out.write(data)
                size, n, last = size + len(data), n + 1, text
            yield pd.DataFrame(done, columns=["key", "size", "n_lines"])
        if (row := close()) is not None:
            yield pd.DataFrame([row], columns=["key", "size", "n_lines"])

    x = records.where(F.col(file).isNotNull() & F.col(line).isNotNull()).select(F.col(file).alias("k"), F.col(order).alias("o"), F.col(line).alias("l"))
    return x.repartition("k").sortWithinPartitions("k", "o", "l").select("k", "l").mapInPandas(write, "key string, size long, n_lines long")
