"""Names of data files: ``[directory/]prefix.millis.parquet``, compacted ``[directory/]prefix.millis.c.parquet``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anchored, so that markers and other names never pass for data files.
PATTERN = r"^(?:.*/)?([a-z0-9_]+)\.([0-9]{1,18})(\.c)?\.parquet$"
MARKER = ".processed"


class NameError_(ValueError):
    """A name that is not a data file's, or whose time is out of range."""


@dataclass(frozen=True)
class FileMeta:
    key: str
    prefix: str
    millis: int
    size: int | None = None
    compacted: bool = False

    @classmethod
    def parse(cls, key: str, size: int | None = None) -> FileMeta:
        m = re.match(PATTERN, key, re.DOTALL)
        if not m:
            raise NameError_(f"not a data file: {key!r}")
        if int(m[2]) > 253_402_300_799_999:
            raise NameError_(f"time out of range: {key!r}")
        return cls(key, m[1], int(m[2]), size, bool(m[3]))

    @staticmethod
    def name(prefix: str, millis: int, compacted: bool = False, part: int = 0) -> str:
        """The file name; ``part`` > 0 moves the time on by milliseconds so that two files of one run never share a name."""
        if not re.fullmatch(r"[a-z0-9_]+", prefix):
            raise NameError_(f"not a prefix: {prefix!r}")
        return f"{prefix}.{millis + part}{'.c' if compacted else ''}.parquet"

    def as_compacted(self) -> FileMeta:
        return FileMeta(self.name(self.prefix, self.millis, True), self.prefix, self.millis, self.size, True)


def is_data_file(key: Column) -> Column:
    return key.rlike(PATTERN)


def prefix_of(key: Column) -> Column:
    """The prefix in a data file's name; null for other names."""
    return F.nullif(F.regexp_extract(key, PATTERN, 1), F.lit(""))


def millis_of(key: Column) -> Column:
    """The event time in a data file's name; null for other names."""
    return F.nullif(F.regexp_extract(key, PATTERN, 2), F.lit("")).cast("long")


def compacted_of(key: Column) -> Column:
    return F.regexp_extract(key, PATTERN, 3) == ".c"


def file_name(prefix: Column, millis: Column, compacted: Column) -> Column:
    return F.concat(prefix, F.lit("."), millis.cast("string"), F.when(compacted, ".c").otherwise(""), F.lit(".parquet"))
