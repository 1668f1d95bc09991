"""Declared schemas, their reconciliation with a table's, and partition and sort specifications."""

from __future__ import annotations

import dataclasses
import types
import typing
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions.transforms import Transform


class SchemaError(ValueError):
    pass


#: Names for ``Annotated[int, ...]`` and the like. Unsigned 64-bit needs 20 digits; times of day are microseconds.
TAGS: dict[str, T.DataType] = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "ntz": T.TimestampNTZType(), "time": T.LongType(), "binary": T.BinaryType(),
}
PLAIN: dict[Any, T.DataType] = {
    bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(),
    datetime: T.TimestampType(), date: T.DateType(), Decimal: T.DecimalType(28, 10),
}


def fixed_binary(n: int) -> str:
    """Tag of a binary value of exactly n bytes; the length is checked on write."""
    if n < 1:
        raise SchemaError("a fixed length is at least 1")
    return f"fixed[{n}]"


def spark_type(hint: Any) -> tuple[T.DataType, bool, dict]:
    """(type, nullable, column metadata) of an annotation."""
    if typing.get_origin(hint) is typing.Annotated:
        inner, *tags = typing.get_args(hint)
        base, nullable, meta = spark_type(inner)
        for tag in tags:
            if tag in TAGS:
                base = TAGS[tag]
            elif isinstance(tag, str) and tag.startswith("fixed["):
                meta = meta | {"fixed": int(tag[6:-1])}
                base = T.ArrayType(T.BinaryType()) if isinstance(base, T.ArrayType) else T.BinaryType()
            else:
                raise SchemaError(f"unknown tag {tag!r}")
        return base, nullable, meta
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) != 1 or len(args) != 2:
            raise SchemaError(f"unsupported union {hint}")
        base, _, meta = spark_type(rest[0])
        return base, True, meta
    if origin in (list, set, frozenset):
        base, _, _ = spark_type(args[0])
        return T.ArrayType(base, True), False, {"set": True} if origin is not list else {}
    if origin is dict:
        k, k_null, _ = spark_type(args[0])
        if k_null:
            raise SchemaError("map keys can't be null")
        return T.MapType(k, spark_type(args[1])[0], True), False, {}
    if dataclasses.is_dataclass(hint):
        return struct_of(hint), False, {}
    if hint in PLAIN:
        return PLAIN[hint], False, {}
    raise SchemaError(f"unsupported type {hint}")


def struct_of(cls: type) -> T.StructType:
    hints = typing.get_type_hints(cls, include_extras=True)
    out = []
    for f in dataclasses.fields(cls):
        base, nullable, meta = spark_type(hints[f.name])
        out.append(T.StructField(f.name, base, nullable, meta))
    return T.StructType(out)


def lake(identifier: bool = False, sort: str | None = None, order: int | None = None, partition: str | None = None, **rest: Any) -> Any:
    """A dataclass field with table attributes: ``sort`` is asc or desc with an optional priority ``order``."""
    return field(metadata={"lake": {"identifier": identifier, "sort": sort, "order": order, "partition": partition}}, **rest)


@dataclass(frozen=True)
class SortField:
    column: str
    descending: bool = False

    def expression(self) -> Column:
        c = F.col(f"`{self.column}`")
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()


@dataclass(frozen=True)
class PartitionField:
    column: str
    transform: Transform

    @property
    def name(self) -> str:
        return self.transform.field_name(self.column)


@dataclass(frozen=True)
class TableSchema:
    struct: T.StructType
    identifiers: tuple[str, ...] = ()
    sort: tuple[SortField, ...] = ()
    partitions: tuple[PartitionField, ...] = ()
    namespace: str = "default"
    table: str = "table"

    def __post_init__(self) -> None:
        names = set(self.struct.names)
        for f in (*self.sort, *self.partitions):
            if f.column not in names:
                raise SchemaError(f"no column {f.column}")
        for i in self.identifiers:
            if i in names and self.struct[i].nullable:
                raise SchemaError(f"identifier {i} can't be null")
        if len({p.name for p in self.partitions}) != len(self.partitions):
            raise SchemaError("two partition fields have one name")

    @property
    def known_identifiers(self) -> list[str]:
        return [i for i in self.identifiers if i in self.struct.names]


def lake_schema(table: str, namespace: str = "default"):  # noqa: ANN201
    """Makes a class a dataclass with ``lake_schema``, its ``TableSchema``."""

    def apply(cls: type) -> type:
        cls = cls if dataclasses.is_dataclass(cls) else dataclass(cls)
        struct, ids, sort, parts = struct_of(cls), [], [], []
        for i, f in enumerate(dataclasses.fields(cls)):
            a = f.metadata.get("lake", {})
            if a.get("identifier"):
                if struct[f.name].nullable:
                    raise SchemaError(f"identifier {f.name} can't be optional")
                ids.append(f.name)
            if a.get("sort"):
                if a["sort"] not in ("asc", "desc"):
                    raise SchemaError(f"not a sort direction: {a['sort']}")
                sort.append((i if a["order"] is None else a["order"], i, SortField(f.name, a["sort"] == "desc")))
            if a.get("partition"):
                parts.append(PartitionField(f.name, Transform.parse(a["partition"])))
        cls.lake_schema = TableSchema(struct, tuple(ids), tuple(s for *_, s in sorted(sort, key=lambda x: x[:2])), tuple(parts), namespace, table)
        return cls

    return apply


#: Changes of type that lose nothing.
WIDER = {("byte", "short"), ("byte", "int"), ("byte", "bigint"), ("short", "int"), ("short", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("int", "bigint"), ("float", "double")}


def widens(old: T.DataType, new: T.DataType) -> bool:
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return old.scale == new.scale and new.precision >= old.precision
    return (old.simpleString(), new.simpleString()) in WIDER


@dataclass(frozen=True)
class Column_:
    """A table's column: its id, and the name its values have in files."""

    id: int
    name: str
    dtype: T.DataType
    nullable: bool
    stored: str
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Reconciled:
    columns: list[Column_]
    added: list[str]
    dropped: list[str]
    widened: list[str]

    @property
    def changed(self) -> bool:
        return bool(self.added or self.dropped or self.widened)


def first_columns(struct: T.StructType) -> list[Column_]:
    return [Column_(i, f.name, f.dataType, f.nullable, f.name, dict(f.metadata)) for i, f in enumerate(struct, 1)]


def reconcile(current: list[Column_], struct: T.StructType, highest: int, used: set[str]) -> Reconciled:
    """The table's columns for ``struct``, by name and in its order.

    Kept columns keep id and file name; a wider type is taken on, any other change of type is an error. New columns are
    optional, with the next ids; one that reuses a name of a dropped column gets another name in files, so old values
    don't come back.
    """
    have = {c.name: c for c in current}
    out, added, widened = [], [], []
    for f in struct:
        if f.name in have:
            c = have[f.name]
            if c.dtype != f.dataType and c.dtype.simpleString() != f.dataType.simpleString():
                if not widens(c.dtype, f.dataType):
                    raise SchemaError(f"{f.name} can't change from {c.dtype.simpleString()} to {f.dataType.simpleString()}")
                c = dataclasses.replace(c, dtype=f.dataType)
                widened.append(f.name)
            out.append(c)
        else:
            highest += 1
            out.append(Column_(highest, f.name, f.dataType, True, f"{f.name}__{highest}" if f.name in used else f.name, dict(f.metadata)))
            added.append(f.name)
    return Reconciled(out, added, [c.name for c in current if c.name not in struct.names], widened)


def conform(df: DataFrame, columns: list[Column_]) -> DataFrame:
    """``df`` with the table's columns by name under their names in files, cast to their types.

    A column that ``df`` lacks is null, which is an error if it is required; extra columns are an error. Sets lose repeated
    elements; values of a fixed length are checked.
    """
    known = {c.name for c in columns}
    extra = [n for n in df.columns if n not in known]
    if extra:
        raise SchemaError(f"columns the table doesn't have: {', '.join(extra)}")
    out = []
    for c in columns:
        if c.name not in df.columns:
            if not c.nullable:
                raise SchemaError(f"{c.name} is required")
            out.append(F.lit(None).cast(c.dtype).alias(c.stored))
            continue
        x = F.col(f"`{c.name}`").cast(c.dtype)
        if c.metadata.get("set"):
            x = F.array_distinct(x)
        if n := c.metadata.get("fixed"):
            wrong = F.exists(x, lambda e: F.length(e) != n) if isinstance(c.dtype, T.ArrayType) else F.length(x) != n
            x = F.when(wrong, F.raise_error(F.lit(f"{c.name} must be {n} bytes long"))).otherwise(x)
        out.append(x.alias(c.stored))
    return df.select(*out)
