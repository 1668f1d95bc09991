"""The few file operations that commits need, through Hadoop's file systems, so any store Spark reads can hold a table."""

from __future__ import annotations

import io
import os
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import SparkSession

#: What a failing call to the JVM raises, known to Spark or not.
STORE_ERRORS = (Py4JJavaError, CapturedException)

#: Schemes of stores whose rename is atomic and fails where the target exists.
ATOMIC_RENAME = {"hdfs", "webhdfs", "swebhdfs", "ofs", "o3fs", "abfs", "abfss"}
#: The option of Hadoop's file builders by which an object is only created if there is none; stores that don't know it refuse.
CONDITIONAL = "fs.option.create.conditional.overwrite"


class UnsupportedStore(RuntimeError):
    """The store can't create a file only if there is none, so two commits could both win."""


class StoreFile(io.RawIOBase):
    """A file of any store for reading at any place, as footers need it."""

    def __init__(self, stream: Any, length: int) -> None:
        self.stream, self.length, self.at = stream, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + (0, self.at, self.length)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, into: Any) -> int:
        data = self.read(len(into))
        into[: len(data)] = data
        return len(data)

    def read(self, n: int = -1) -> bytes:
        left = max(0, self.length - self.at)
        n = left if n is None or n < 0 else min(n, left)
        if not n:
            return b""
        self.stream.seek(self.at)
        data = bytes(self.stream.readNBytes(n))
        self.at += len(data)
        return data

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


class Storage:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    @staticmethod
    def unique() -> str:
        return uuid.uuid4().hex

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """(path, length, modification time) of the files below, hidden ones left out."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found, it = [], fs.listFiles(p, True)
        while it.hasNext():
            x = it.next()
            if not x.getPath().getName().startswith((".", "_")):
                found.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
        return sorted(found)

    def read(self, path: str) -> str:
        return self.read_bytes(path).decode()

    def read_bytes(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def open(self, path: str) -> StoreFile:
        fs, p = self._at(path)
        return StoreFile(fs.open(p), fs.getFileStatus(p).getLen())

    def length(self, path: str) -> int | None:
        """None if there is no such file."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen() if fs.exists(p) else None

    def create(self, path: str, text: str) -> bool:
        """Writes a file that must not exist yet; False if it does.

        On local disks the text is written under another name and put in place by an exclusive hard link; on stores with an
        atomic rename that refuses to overwrite (``ATOMIC_RENAME``) by that; elsewhere by a conditional create of the store,
        and one without is refused (``UnsupportedStore``).
        """
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        if fs.getUri().getScheme() == "viewfs":  # what lies behind the mount point counts
            p = self.jvm.org.apache.hadoop.fs.Path(fs.resolvePath(p.getParent()), p.getName())
            fs = p.getFileSystem(self.conf)
        scheme = self._scheme(fs)
        if scheme != "file" and scheme not in ATOMIC_RENAME:
            return self._create_if_none(fs, p, text)
        tmp = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{self.unique()}.tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if scheme == "file":
            try:
                os.link(tmp.toUri().getPath(), p.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(tmp, False)
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            return False
        return True

    @staticmethod
    def _scheme(fs: Any) -> str:
        return fs.getUri().getScheme()

    def _create_if_none(self, fs: Any, p: Any, text: str) -> bool:
        if fs.exists(p):
            return False
        try:
            out = fs.createFile(p).must(CONDITIONAL, True).build()
        except STORE_ERRORS as e:
            raise UnsupportedStore(f"{self._scheme(fs)} can't create {p.toString()} only if there is none") from e
        try:
            out.write(bytearray(text.encode()))
            out.close()
            return True
        except STORE_ERRORS:
            if fs.exists(p):  # another writer's object came first
                return False
            raise

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def put(self, local: str, path: str) -> None:
        """Moves a file of this process's own disk here."""
        fs, p = self._at(path)
        fs.copyFromLocalFile(True, True, self.jvm.org.apache.hadoop.fs.Path(f"file:{os.path.abspath(local)}"), p)

    def delete(self, path: str, tries: int = 3) -> bool:
        fs, p = self._at(path)
        for i in range(tries):
            try:
                return fs.delete(p, True)
            except Exception:
                if i == tries - 1:
                    raise
        return False

    def copy(self, a: str, b: str) -> bool:
        fs, p = self._at(a)
        to, q = self._at(b)
        to.mkdirs(q.getParent())
        return self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, self.conf)

    def rename(self, a: str, b: str) -> bool:
        fs, p = self._at(a)
        q = self.jvm.org.apache.hadoop.fs.Path(b)
        fs.mkdirs(q.getParent())
        return fs.rename(p, q)
