"""Partition transforms as column expressions, by the public table-format specification."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.operators.readings import epoch_micros


class TransformError(ValueError):
    pass


@dataclass(frozen=True)
class Transform:
    """``identity``, ``year``, ``month``, ``day``, ``hour``, ``bucket[N]`` or ``truncate[W]``."""

    kind: str
    width: int | None = None

    @classmethod
    def parse(cls, text: str) -> Transform:
        m = re.fullmatch(r"(identity|year|month|day|hour)|(bucket|truncate)[\[(](\d+)[\])]", text.strip())
        if not m or (m[2] and int(m[3]) < 1):
            raise TransformError(f"not a transform: {text!r}")
        return cls(m[1]) if m[1] else cls(m[2], int(m[3]))

    def __str__(self) -> str:
        return self.kind if self.width is None else f"{self.kind}[{self.width}]"

    def field_name(self, column: str) -> str:
        if self.kind == "identity":
            return column
        return f"{column}_{self.kind}" if self.width is None else f"{column}_{self.kind}_{self.width}"

    def of(self, value: Any, dtype: T.DataType) -> Any:
        """The partition value of one value as ``predicate.comparable`` makes it (times are micros, dates days); None if it can't be told."""
        if self.kind == "identity":
            return value if isinstance(dtype, (T.IntegralType, T.StringType, T.BooleanType)) else None
        if self.kind in ("year", "month", "day", "hour"):
            if not isinstance(value, int):
                return None
            hours = value // 3_600_000_000 if not isinstance(dtype, T.DateType) else value * 24
            if self.kind in ("day", "hour"):
                return hours // 24 if self.kind == "day" else hours
            day = date(1970, 1, 1) + timedelta(days=hours // 24)
            return day.year - 1970 if self.kind == "year" else (day.year - 1970) * 12 + day.month - 1
        if self.kind == "truncate":
            if isinstance(value, int) and isinstance(dtype, T.IntegralType):
                return value - value % self.width
            return value[: self.width] if isinstance(value, str) and isinstance(dtype, T.StringType) else None
        if isinstance(value, int) and isinstance(dtype, T.IntegralType):
            return (murmur3_bytes(value.to_bytes(8, "little", signed=True)) & 0x7FFFFFFF) % self.width
        return (murmur3_bytes(value.encode()) & 0x7FFFFFFF) % self.width if isinstance(value, str) and isinstance(dtype, T.StringType) else None

    def may_match(self, part: str | None, op: str, value: Any, dtype: T.DataType) -> bool:
        """False only if no row of this partition value can meet ``column op value``; a null meets nothing."""
        if part is None:
            return False
        at = self.of(value, dtype)
        if at is None:
            return True
        known = part if isinstance(at, str) else {"true": True, "false": False}.get(part) if isinstance(at, bool) else int(part)
        if op == "=":
            return known == at
        if op == "!=":
            return not (self.kind == "identity" and known == at)
        if self.kind == "bucket" or known is None:
            return True
        # the other transforms never turn an order around
        return known >= at if op in (">", ">=") else known <= at

    def __call__(self, column: str, dtype: T.DataType) -> Column:
        """The partition value of a column; null stays null."""
        c = F.col(column)
        if self.kind == "identity":
            return c
        if self.kind in ("year", "month", "day", "hour"):
            if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)) or (self.kind == "hour" and isinstance(dtype, T.DateType)):
                raise TransformError(f"{self} does not apply to {dtype.simpleString()}")
            if self.kind == "year":
                return F.year(c) - 1970
            if self.kind == "month":
                return (F.year(c) - 1970) * 12 + F.month(c) - 1
            if self.kind == "day":
                return F.datediff(c, F.lit("1970-01-01").cast("date"))
            return F.floor(epoch_micros(column) / 3_600_000_000).cast("int")
        if self.kind == "truncate":
            if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                return (c - F.pmod(c, F.lit(self.width).cast(dtype))).cast(dtype)
            if isinstance(dtype, T.StringType):
                return F.substring(c, 1, self.width)
            raise TransformError(f"{self} does not apply to {dtype.simpleString()}")
        return bucket(column, dtype, self.width)


def _seed_zero() -> int:
    """The int whose 32-bit murmur3 from seed 42 is 0: what Spark's ``hash`` must see first to go on from seed 0."""
    m = 1 << 32
    back = lambda x, n: (x >> n | x << (32 - n)) % m
    h = back((4 - 0xE6546B64) * pow(5, -1, m) % m, 13)
    x = back((h ^ 42) * pow(0x1B873593, -1, m) % m, 15) * pow(0xCC9E2D51, -1, m) % m
    return x - m if x >= m >> 1 else x


def murmur3_long(c: Column) -> Column:
    """32-bit murmur3 (x86, seed 0) of a long's eight bytes, little-endian, by Spark's own hash within generated code."""
    return F.when(c.isNotNull(), F.hash(F.lit(_seed_zero()), c).cast("long"))


def murmur3_bytes(data: bytes) -> int:
    mask, h = 0xFFFFFFFF, 0
    rot = lambda x, n: (x << n | x >> (32 - n)) & mask
    whole = len(data) // 4 * 4
    for k in np.frombuffer(data[:whole], dtype="<u4").tolist():
        h = rot(h ^ rot(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64 & mask
    if data[whole:]:
        h ^= rot(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


@F.pandas_udf(T.LongType())
def murmur3_binary(s: pd.Series) -> pd.Series:
    """Murmur3 of bytes; each distinct value of a batch is hashed once. Spark's own hash differs in seed and tail."""
    codes, values = pd.factorize(s)
    hashes = [murmur3_bytes(bytes(v)) for v in values]
    return pd.Series([None if c < 0 else hashes[c] for c in codes], dtype="Int64")


def bucket(column: str, dtype: T.DataType, n: int) -> Column:
    c = F.col(column)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        h = murmur3_long(c.cast("long"))
    elif isinstance(dtype, T.DateType):
        h = murmur3_long(F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        h = murmur3_long(epoch_micros(column))
    elif isinstance(dtype, T.StringType):
        h = murmur3_binary(F.encode(c, "utf-8"))
    elif isinstance(dtype, T.BinaryType):
        h = murmur3_binary(c)
    elif isinstance(dtype, T.DecimalType):
        raise TransformError("bucket of decimals is not supported")
    else:
        raise TransformError(f"bucket does not apply to {dtype.simpleString()}")
    return F.pmod(h.bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")
