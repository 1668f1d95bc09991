"""Filters: a small text grammar, conjunctions, and which files their statistics rule out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal
from functools import reduce
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = (">=", "<=", "!=", "=", ">", "<")


class FilterError(ValueError):
    pass


def literal(text: str) -> Any:
    """Quoted text is a string; then true or false, whole number, number; anything else is a string."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            if "_" not in text:
                return kind(text)
        except ValueError:
            pass
    return text


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: Any

    @classmethod
    def parse(cls, text: str) -> Predicate:
        """``column op value``: the operator furthest left counts, the longest of those that begin there."""
        at, op = min(((i, o) for o in OPERATORS if (i := text.find(o)) >= 0), key=lambda x: (x[0], -len(x[1])), default=(-1, ""))
        if at < 0:
            raise FilterError(f"no operator in {text!r}")
        column, value = text[:at].strip(), text[at + len(op) :].strip()
        if not column or not value:
            raise FilterError(f"no column or no value in {text!r}")
        return cls(column, op, literal(value))

    def expression(self) -> Column:
        """Rows for which this is null are not selected."""
        c, v = F.col(f"`{self.column}`"), F.lit(self.value)
        return {"=": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[self.op]

    def may_match(self, low: Any, high: Any) -> bool:
        """False only if no value between ``low`` and ``high`` can meet this."""
        if low is None or high is None:
            return True
        try:
            if self.op == "=":
                return low <= self.value <= high
            if self.op == "!=":
                return not (low == high == self.value)
            if self.op in (">", ">="):
                return high > self.value or (self.op == ">=" and high == self.value)
            return low < self.value or (self.op == "<=" and low == self.value)
        except TypeError:
            return True


EPOCH = datetime(1970, 1, 1)


def comparable(value: Any, dtype: T.DataType, zone: str = "UTC") -> Any:
    """A literal as it compares with bounds of a column: times as UTC micros, dates as days, decimals as they are.

    None where it can't be told, so that nothing is ruled out. ``zone``: the session's, in which texts without one are read.
    """
    try:
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            t = value if isinstance(value, datetime) else datetime.fromisoformat(value) if isinstance(value, str) else None
            if t is None or (t.tzinfo is not None and isinstance(dtype, T.TimestampNTZType)):
                return None
            if isinstance(dtype, T.TimestampType):
                t = (t if t.tzinfo is not None else t.replace(tzinfo=ZoneInfo(zone))).astimezone(UTC).replace(tzinfo=None)
            return (t - EPOCH) // timedelta(microseconds=1)
        if isinstance(dtype, T.DateType):
            d = date.fromisoformat(value) if isinstance(value, str) else value if type(value) is date else None
            return (d - EPOCH.date()).days if d is not None else None
        if isinstance(dtype, T.StringType):
            return value if isinstance(value, str) else None
        return None if isinstance(value, str) else value
    except (ValueError, KeyError):
        return None


def bound(value: Any, dtype: T.DataType) -> Any:
    """A stored bound as it compares with ``comparable``: decimals are kept as text."""
    return Decimal(value) if isinstance(dtype, T.DecimalType) and isinstance(value, str) else value


def storable(value: Any) -> Any:
    """A bound from a footer as it is kept: see ``comparable``; None if it isn't kept."""
    if isinstance(value, datetime):
        return ((value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value) - EPOCH) // timedelta(microseconds=1)
    if isinstance(value, date):
        return (value - EPOCH.date()).days
    if isinstance(value, Decimal):
        return str(value)
    return value if isinstance(value, (bool, int, str)) or (isinstance(value, float) and value == value) else None


def conjunction(predicates: list[Predicate | str]) -> Column:
    parsed = [Predicate.parse(p) if isinstance(p, str) else p for p in predicates]
    return reduce(lambda a, b: a & b, (p.expression() for p in parsed)) if parsed else F.lit(True)
