"""Irregular readings onto a regular grid by compact-kernel local polynomial regression.

The index of nearby readings is one row of moments per (sensor, period). The kernel 1 - u**2 is a polynomial and its
support is a whole number of periods, so the weighted sums of a grid time follow exactly from the moments of the
periods around it: no reading is joined with a grid time, and one shuffle of readings is all.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.operators.readings import is_number, usable


def _poly(names: list[str], k: int, shift: Column) -> Column:
    """Sum of (e + shift)**k from the sums of e**i in ``names``."""
    total = F.lit(0.0)
    for i in range(k + 1):
        total = total + F.lit(float(comb(k, i))) * F.pow(shift, F.lit(float(k - i))) * F.col(names[i]) if k > i else total + F.col(names[i])
    return total


def regular_grid(readings: DataFrame, value: str = "temperature", period: int = 900, reach: int = 2, min_support: float = 2.0, block: int = 96) -> DataFrame:
    """One row per sensor and period between its first and last usable reading with a number.

    Columns: ``sensor_id``, ``period_start`` (epoch seconds), ``value`` (local linear estimate at the period's middle),
    ``n_readings`` (distinct reading times in the period), ``n_near`` (in the kernel's support), ``effective_support``
    ((sum w)**2 / sum w**2) and ``status``: ``observed``, ``filled`` (no reading in the period but at least
    ``min_support``) or ``missing`` (``value`` null). The kernel reaches ``reach`` whole periods to both sides.

    Readings with a null or NaN value and unusable ones count for nothing; readings of one sensor at one second are
    averaged and count once, so repeats change nothing. A level is fitted where all near readings share one time.
    No readings, no rows. ``value`` may be any numeric column; other columns are ignored.
    """
    half = (reach + 0.5) * period
    x = usable(readings).where(is_number(value)).select("sensor", "event_time", F.col(value).cast("double").alias("y"))
    x = x.withColumn("p", F.floor(F.col("event_time") / period))
    once = x.repartition("sensor", "p").groupBy("sensor", "p", "event_time").agg(F.avg("y").alias("y"))
    e = (F.col("event_time") - F.col("p") * period - period / 2) / half
    sums = [F.sum(F.pow(e, F.lit(float(k)))).alias(f"m{k}") if k else F.count(F.lit(1)).cast("double").alias("m0") for k in range(5)]
    sums += [F.sum(F.col("y") * F.pow(e, F.lit(float(k)))).alias(f"y{k}") for k in range(4)]
    index = once.groupBy("sensor", "p").agg(*sums)

    spread = index.withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(-reach, reach + 1)])))
    shift = F.col("j") * F.lit(-period / half)
    m, y = [f"m{k}" for k in range(5)], [f"y{k}" for k in range(4)]
    d = {k: _poly(m, k, shift) for k in range(5)}
    q = {k: _poly(y, k, shift) for k in range(4)}
    parts = spread.select(
        "sensor", (F.col("p") + F.col("j")).alias("p"), F.when(F.col("j") == 0, F.col("m0")).otherwise(0.0).alias("own"), F.col("m0").alias("near"),
        (d[0] - d[2]).alias("s0"), (d[1] - d[3]).alias("s1"), (d[2] - d[4]).alias("s2"), (d[0] - 2 * d[2] + d[4]).alias("ww"),
        (q[0] - q[2]).alias("t0"), (q[1] - q[3]).alias("t1"), F.lit(0).alias("grid"),
    )

    ends = x.groupBy("sensor").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    blocks = ends.select("sensor", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("b") / block))).alias("k")).repartition("sensor", "k")
    grid = blocks.select("sensor", F.explode(F.sequence(F.greatest("a", F.col("k") * block), F.least("b", F.col("k") * block + block - 1))).alias("p"))
    zeros = [F.lit(0.0).alias(c) for c in ("own", "near", "s0", "s1", "s2", "ww", "t0", "t1")]
    whole = parts.unionByName(grid.select("sensor", "p", *zeros, F.lit(1).alias("grid")))
    g = whole.groupBy("sensor", "p").agg(*[F.sum(c).alias(c) for c in ("own", "near", "s0", "s1", "s2", "ww", "t0", "t1")], F.max("grid").alias("grid")).where("grid = 1")

    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    near = F.col("s0") > 1e-9  # a reading on the edge of the support has weight 0
    fit = F.when(near & (det > 1e-9 * F.col("s0") * F.col("s0")), (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).when(near, F.col("t0") / F.col("s0"))
    support = F.when(near, F.col("s0") * F.col("s0") / F.col("ww")).otherwise(0.0)
    status = F.when(F.col("own") > 0, "observed").when(near & (support >= min_support), "filled").otherwise("missing")
    return g.select(
        F.col("sensor").alias("sensor_id"), (F.col("p") * period).cast("long").alias("period_start"), F.when(status != "missing", fit).alias("value"),
        F.col("own").cast("long").alias("n_readings"), F.col("near").cast("long").alias("n_near"), support.alias("effective_support"), status.alias("status"),
    )
