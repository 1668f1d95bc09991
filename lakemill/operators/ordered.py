"""Scans along an order (running maximum, running sum, row rank) that never sort a whole key in one task.

Each key's sequence is cut into slices by a column that rises with the order. A slice is scanned on its own
by a window over (key, slice); what all earlier slices add is a window over one row per slice, so the work of
a key that holds a third of all rows is spread over its slices.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    """``out`` is ``kind`` ("max" or "sum") of ``value`` over the rows before this one.

    ``frame``: "before" takes the rows before this one in ``order``, "upto" this row too, "strict" only rows whose
    (single, numeric) order value is smaller, so that ties don't see each other.
    """

    out: str
    value: str
    kind: str = "max"
    frame: str = "before"


def scan(df: DataFrame, keys: list[str], slice_col: str, order: list[Column | str], scans: list[Scan]) -> DataFrame:
    """Adds the columns of ``scans``. Without rows before, a max is null and a sum 0.

    Rows whose slice is null form a slice before all others; null keys are a key of their own. A max over structs
    gives "the last row before" (a lag that crosses slices).
    """
    own = [*keys, slice_col]
    make = {"max": F.max, "sum": F.sum}
    carried = df.groupBy(*own).agg(*[make[s.kind](s.value).alias(f"__s{i}") for i, s in enumerate(scans)])
    earlier = Window.partitionBy(*keys).orderBy(F.col(slice_col).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(own)], *[make[s.kind](f"__s{i}").over(earlier).alias(f"__c{i}") for i, s in enumerate(scans)])
    same = None
    for i, c in enumerate(own):
        x = df[c].eqNullSafe(carried[f"__k{i}"])
        same = x if same is None else same & x
    joined = df.join(carried, same, "left").drop(*[f"__k{i}" for i in range(len(own))])
    w = Window.partitionBy(*own).orderBy(*order)
    frames = {
        "before": w.rowsBetween(Window.unboundedPreceding, -1),
        "upto": w.rowsBetween(Window.unboundedPreceding, 0),
        "strict": w.rangeBetween(Window.unboundedPreceding, -1),
    }
    for i, s in enumerate(scans):
        local, carry = make[s.kind](s.value).over(frames[s.frame]), F.col(f"__c{i}")
        if s.kind == "max":
            joined = joined.withColumn(s.out, F.greatest(carry, local))
        else:
            joined = joined.withColumn(s.out, F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)))
    return joined.drop(*[f"__c{i}" for i in range(len(scans))])


def chunks(df: DataFrame, keys: list[str], slice_col: str, order: list[str], rows: int, halo: int) -> DataFrame:
    """Cuts each key's sequence into chunks of exactly ``rows`` rows (the last may be shorter).

    Adds ``chunk``, ``rank`` (from 0) and ``core``; the ``halo`` rows before and after a chunk come along with
    ``core`` false, so that what a row needs of its neighbours lies in its own chunk. ``halo`` must not exceed ``rows``.
    """
    if halo > rows:
        raise ValueError("halo exceeds rows")
    ranked = scan(df.withColumn("__one", F.lit(1).cast("long")), keys, slice_col, order, [Scan("rank", "__one", "sum", "before")]).drop("__one")
    own = F.floor(F.col("rank") / rows)
    at = F.pmod(F.col("rank"), F.lit(rows))
    into = F.array_compact(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= rows - halo, own + 1)))
    return ranked.withColumn("__own", own).withColumn("chunk", F.explode(into)).withColumn("core", F.col("chunk") == F.col("__own")).drop("__own")
