"""De-duplication in which the first row of a defined order stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def comparable(c: Column, dtype: T.DataType) -> Column:
    """A column as a value that rows can be grouped by: maps become sorted entries."""
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(c))
    return c


def first_rows(df: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The first row of each distinct key (all columns if None) by ``order`` (then all other columns).

    Nulls are equal to each other, and so are NaN and 0.0 and -0.0. Without an order the rows of equal keys differ in nothing
    that counts, and plain grouping with a partial aggregate on each task is used; with one, the least row is an
    aggregate too (a struct of order and row, maps as their sorted entries), so a hot key is reduced before it is shuffled.
    """
    types = {f.name: f.dataType for f in df.schema}
    keys = keys or [c for c in df.columns if c not in (order or [])]
    if not order and set(keys) == set(df.columns) and not any(isinstance(t, T.MapType) for t in types.values()):
        return df.dropDuplicates()
    is_map = {c for c in df.columns if isinstance(types[c], T.MapType)}
    named = [comparable(F.col(f"`{k}`"), types[k]).alias(f"__k{i}") for i, k in enumerate(keys)]
    rank = [*(order or []), *(c for c in df.columns if c not in (order or []))]
    least = F.min(F.struct(*[comparable(F.col(f"`{c}`"), types[c]).alias(c) for c in rank]))
    value = lambda c: F.map_from_entries(f"__r.`{c}`") if c in is_map else F.col(f"__r.`{c}`")
    return df.groupBy(*named).agg(least.alias("__r")).select(*[value(c).alias(c) for c in df.columns])


def stats(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row: ``total``, ``unique_rows`` and ``eliminated``."""
    types = {f.name: f.dataType for f in df.schema}
    keys = keys or df.columns
    per = df.groupBy(*[comparable(F.col(f"`{k}`"), types[k]).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("eliminated"))
