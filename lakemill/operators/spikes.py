"""Implausible readings: an isolation forest per source over level, difference, season and run length, and physical limits.

A sensor's values of one metric form a series with a forest of its own. Every tree grows over all of its readings and over
planted faults, so that it has cuts where faults lie. Every reading is scored. The threshold is the series' own: what
two in a hundred of all its readings reach, or less if planted faults of some shape, one on each reading, score lower. A reading at or above it is nominated, and
only what is nominated meets the exact definition of a spike or a stuck run; physical limits are an explicit rule.

What a forest misses is caught exactly: a spike must stand clear of its neighbours to both sides by the same distance
(``reach``), which sliding extremes tell of every reading, and a stuck run is a run length of 12. Readings of that kind
below the threshold are nominated by ``rule``.

A sensor is one group of one task, from features to verdict, as long as it has at most ``whole_rows`` readings; those of
larger ones are cut into chunks with the neighbours a reading needs (``ordered.chunks``), and share the series' model.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.operators.ordered import chunks
from lakemill.operators.readings import is_number, sensor_name, usable
from lakemill.session import cut, stored

#: Physical limits: metric -> (lowest, highest) possible value.
LIMITS = {"temperature": (-60.0, 85.0), "humidity": (0.0, 100.0)}
SPIKE_LENGTH, SIDE, STUCK = 3, 5, 12
#: A forest sees features no further out than this many scatters, else a few extreme values take up all its levels.
FURTHEST = 30.0
#: What a forest sees of a reading, in units of its series' scatter but for the last.
FEATURES = ("level", "before", "after", "season", "run")
#: A forest grows over one planted fault for so many readings; faults depart by so much more than the rule asks.
PLANT_EVERY, PLANT_BY = 16, 1.15
#: The share of its own readings that a series nominates at least, and of planted faults of one shape that may score less.
NOMINATED, PLANTED_BELOW, SHAPES = 0.02, 0.1, 9
#: A short series has this many planted faults, so that every shape is among those its forest grows over.
FAULTS, SEED = PLANT_EVERY * SHAPES, 11
SERIES = ["sensor", "metric"]
#: Rows that are scored at once.
BLOCK = 16_384


def series(readings: DataFrame, metrics: dict[str, tuple[float, float]] = LIMITS) -> DataFrame:
    """``sensor, metric, event_time, reading_id, v``: each usable number of each metric; nulls and NaN are skipped."""
    x = usable(readings)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    return x.select("sensor", "event_time", "reading_id", each.alias("x")).select("sensor", "x.metric", "event_time", "reading_id", "x.v").where(is_number("v"))


# -- one series in arrays


def _lagged(v: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(v), np.nan)
    if k > 0:
        out[k:] = v[:-k] if k < len(v) else []
    elif k < 0:
        out[:k] = v[-k:] if -k < len(v) else []
    else:
        out[:] = v
    return out


def _middle(x: np.ndarray) -> np.ndarray:
    """Row-wise median without NaN; NaN where all are."""
    x = np.sort(x, axis=1)  # NaN last
    n = np.sum(~np.isnan(x), axis=1)
    at = np.maximum(n - 1, 0)
    rows = np.arange(len(x))
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, (x[rows, at // 2] + x[rows, (at + 1) // 2]) / 2, np.nan)


def departure(v: np.ndarray, at: np.ndarray | None = None, longest: int = SPIKE_LENGTH, side: int = SIDE) -> np.ndarray:
    """How far each value (of those at ``at``) departs, as one of up to ``longest`` successive ones, from the level before and after.

    For each group of successive values that holds this one, the least distance of any member from the nearer of the
    two levels (medians of ``side`` values), if all lie to the same side of both; the greatest over the groups. 0 where
    there is no such group; groups at an end of the series, with no level on one side, don't count.
    """
    at = np.arange(len(v)) if at is None else at
    best, edge = np.zeros(len(at)), side + longest
    around = np.r_[np.full(edge, np.nan), v, np.full(edge, np.nan)]
    for length in range(1, longest + 1):
        for k in range(length):
            start = (at - k + edge)[:, None]
            before, after = _middle(around[start + np.arange(-side, 0)]), _middle(around[start + np.arange(length, length + side)])
            high, low = np.fmax(before, after), np.fmin(before, after)
            group = around[start + np.arange(length)]
            with np.errstate(invalid="ignore"):
                d = np.fmax(group.min(axis=1) - high, low - group.max(axis=1))
            best = np.fmax(best, np.where(np.isnan(before) | np.isnan(after), 0.0, np.nan_to_num(d)))
    return best


def run_lengths(v: np.ndarray) -> np.ndarray:
    """The number of successive equal values that each value is among."""
    if not len(v):
        return np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    n = np.diff(np.r_[start, len(v)])
    return np.repeat(n, n)


def reach(v: np.ndarray, side: int = SIDE) -> np.ndarray:
    """How far each value is clear of a neighbour on either side (negative if it is not): never less than a ``departure`` above 0.

    Up to three values depart together and a level is the middle of five, so each side has, among the five values next to a
    departing one, at least one no further out than the level there.
    """
    before, after = [_lagged(v, k) for k in range(1, side + 1)], [_lagged(v, -k) for k in range(1, side + 1)]
    with np.errstate(invalid="ignore"):
        up = v - np.maximum(np.fmin.reduce(before), np.fmin.reduce(after))
        down = np.minimum(np.fmax.reduce(before), np.fmax.reduce(after)) - v
    return np.nan_to_num(np.fmax(up, down))


def local(v: np.ndarray) -> dict[str, np.ndarray]:
    """The features of each value that its neighbours give, unscaled: ``level, before, after, run``; 0 where there are none."""
    around = np.stack([_lagged(v, k) for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)
    with np.errstate(invalid="ignore"):
        return {
            "level": np.nan_to_num(v - _middle(around)), "before": np.nan_to_num(v - _lagged(v, 1)), "after": np.nan_to_num(v - _lagged(v, -1)),
            "run": np.minimum(run_lengths(v), STUCK),
        }


def _half(x: np.ndarray) -> float:
    """The value at the middle of the sorted ones, the lower of two."""
    return _nth(x, (len(x) - 1) // 2)


def _nth(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, k)[k])


#: Scatter of a reading about its level from the median distance: 1.4826 of it, less what the noise of ten neighbours' median adds.
FROM_MEDIAN = 1.4826 / math.sqrt(1 + math.pi / 2 / (2 * SIDE))


def scatter_of(level: np.ndarray) -> float:
    size = np.abs(level)
    mad = _half(size) if len(size) else 0.0
    if mad == 0 and (size > 0).any():
        mad = _half(size[size > 0])
    return mad * FROM_MEDIAN


def usual_of(event_time: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The middle value of each hour of the day; 0 for hours without readings."""
    hour = (event_time % 86_400) // 3600
    order = np.lexsort((v, hour))
    n = np.bincount(hour, minlength=24)
    at = np.cumsum(n) - n + np.maximum(n - 1, 0) // 2
    return np.where(n > 0, v[order][np.minimum(at, len(v) - 1)], 0.0) if len(v) else np.zeros(24)


def vectors(x: dict[str, np.ndarray], event_time: np.ndarray, v: np.ndarray, usual: np.ndarray, scatter: float) -> np.ndarray:
    """A row of ``FEATURES`` per reading."""
    unit = scatter if scatter > 0 else 1.0
    with np.errstate(over="ignore"):
        season = (v - usual[(event_time % 86_400) // 3600]) / unit
        out = np.column_stack([x["level"] / unit, x["before"] / unit, x["after"] / unit, np.nan_to_num(season), x["run"]])
    return np.clip(out, -FURTHEST, FURTHEST).astype(np.float32)


# -- forests


Forest = tuple[np.ndarray, np.ndarray, np.ndarray]


@lru_cache(maxsize=8)
def _draws(trees: int, depth: int, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """What chance decides at each node: the order in which features are tried, and where between its bounds the line lies."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    return np.argsort(rng.random((trees, nodes, features)), axis=2), rng.random((trees, nodes))


def _depth(leaves: int) -> int:
    return max(1, math.ceil(math.log2(max(leaves, 2))))


def _bare(trees: int, depth: int) -> Forest:
    shape = trees, 2 ** (depth + 1) - 1
    return np.full(shape, -1, dtype=np.int8), np.full(shape, np.inf, dtype=np.float32), np.zeros(shape, dtype=np.float32)


def _of_level(x: np.ndarray, level: int) -> np.ndarray:
    """A level's nodes of all trees, those of a tree one after the other."""
    return x[:, 2**level - 1 : 2 ** (level + 1) - 1].reshape(x.shape[0] << level, *x.shape[2:])


def _extend(model: Forest, level: int, count: np.ndarray, choice: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> None:
    """Grows a level: each node's rows, the feature that cuts it (-1: none can), its bounds, and the drawn place of the line.

    Path length is that of a leaf with its correction for the rows that are still together there. Below a leaf all nodes
    lead to the left and have its path length, so a walk needs no test for leaves.
    """
    feature, threshold, path = model
    here, shape = slice(2**level - 1, 2 ** (level + 1) - 1), (len(feature), 2**level)
    count, choice = count.reshape(shape), choice.reshape(shape)
    parent = (np.arange(here.start, here.stop) - 1) // 2
    below = feature[:, parent] < 0 if level else np.zeros(shape, dtype=bool)
    leaf = below | (choice < 0) | (count < 2)
    path[:, here] = np.where(below, path[:, parent], level + _c(count)) if level else level + _c(count)
    feature[:, here] = np.where(leaf, -1, choice)
    with np.errstate(invalid="ignore"):
        line = low + at * (high - low)
    threshold[:, here] = np.where(leaf, np.inf, line.reshape(shape))


def _down(flat: np.ndarray, row: np.ndarray, at: np.ndarray, model: Forest, level: int) -> np.ndarray:
    """The nodes of the next level that rows at nodes ``at`` of this one go to."""
    feature, line = np.maximum(_of_level(model[0], level), 0).astype(np.intp), _of_level(model[1], level)
    return 2 * at + (flat.take(row + feature.take(at)) > line.take(at))


def _grown(x: np.ndarray, trees: int, leaves: int, seed: int) -> tuple[Forest, np.ndarray]:
    """``forest``, and each row's path lengths in all trees put together."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    n, f = x.shape
    flat, depth, total = x.ravel(), _depth(leaves), np.zeros(n, dtype=np.float32)
    model, (tries, places) = _bare(trees, depth), _draws(trees, depth, f, seed)
    step = max(1, 16 * BLOCK // max(n, 1))  # trees that grow at once
    for a in range(0, trees, step):
        part = tuple(m[a : a + step] for m in model)
        g = len(part[0])
        of, nodes, size = np.tile(np.arange(n) * f, g), np.arange(g), np.full(g, n)  # rows, those of a node one after the other
        for level in range(depth + 1):
            k = g << level
            count, choice, low, high = np.zeros(k, dtype=np.int64), np.full(k, -1), np.zeros(k), np.zeros(k)
            count[nodes] = size
            if level < depth:
                tried, open_, rows, here = _of_level(tries[a : a + step], level), nodes, size, slice(None)
                values = np.empty(len(of), dtype=np.float32)
                for j in range(f):
                    wanted = tried[open_, j]
                    value, start = flat.take(of[here] + np.repeat(wanted, rows)), np.cumsum(rows) - rows
                    values[here] = value
                    least, most = np.minimum.reduceat(value, start), np.maximum.reduceat(value, start)
                    got = most > least
                    choice[open_[got]], low[open_[got]], high[open_[got]] = wanted[got], least[got], most[got]
                    more = ~got & (rows > 1)  # constant in this feature: the next one
                    if not more.any():
                        break
                    left = np.flatnonzero(np.repeat(more, rows))
                    here, open_, rows = left if j == 0 else here[left], open_[more], rows[more]
            _extend(part, level, count, choice, low, high, _of_level(places[a : a + step], level))
            if level < depth:
                right = values > np.repeat(_of_level(part[1], level)[nodes], size)
                n_right = np.add.reduceat(right, np.cumsum(size) - size, dtype=np.intp)
                of, nodes, size = np.concatenate([of[~right], of[right]]), np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([size - n_right, n_right])
                nodes, size = nodes[size > 0], size[size > 0]
        path = np.empty(g * n, dtype=np.float32)
        path[of // f + np.repeat((nodes >> depth) * n, size)] = np.repeat(_of_level(part[2], depth)[nodes], size)
        for each in path.reshape(g, n):
            total += each
    return model, total


def forest(x: np.ndarray, trees: int, leaves: int, seed: int) -> Forest:
    """Isolation trees over the rows of ``x``, each over all of them, grown level by level: (feature, threshold, path length) per node.

    Nodes are numbered as in a heap. Trees are as deep as ``leaves`` leaves need; rows that are still together there count by the
    mean path length among so many. A node is cut in the first feature, in the order drawn for it, that differs among its rows.
    So a forest follows from numbers and bounds of rows per node, whatever the order of rows and wherever they lie.
    """
    return _grown(x, trees, leaves, seed)[0]


def bounds(x: np.ndarray, model: Forest, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What rows ``x`` add to a level's nodes of a forest that has grown down to there: number, least and greatest of each feature."""
    n, f = x.shape
    trees = len(model[0])
    k = trees << level
    flat, columns, row = x.ravel(), np.ascontiguousarray(x.T), np.arange(n) * f
    count, low, high = np.zeros(k, dtype=np.int64), np.full((k, f), np.inf, dtype=np.float32), np.full((k, f), -np.inf, dtype=np.float32)
    for t in range(trees):
        at, part = np.zeros(n, dtype=np.intp), tuple(m[t : t + 1] for m in model)
        for above in range(level):
            at = _down(flat, row, at, part, above)
        mine = np.bincount(at, minlength=1 << level)
        nodes = np.flatnonzero(mine)
        order, start = np.argsort(at.astype(np.min_scalar_type((1 << level) - 1)), kind="stable"), np.cumsum(mine[nodes]) - mine[nodes]
        nodes = nodes + (t << level)
        count[nodes] = mine[mine > 0]
        for j, column in enumerate(columns):
            value = column.take(order)
            low[nodes, j], high[nodes, j] = np.minimum.reduceat(value, start), np.maximum.reduceat(value, start)
    return count, low, high


def extend(model: Forest, level: int, count: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int) -> None:
    """Grows a level from the ``bounds`` of all rows: as ``forest`` does where all rows are at hand."""
    trees, f = len(model[0]), low.shape[1]
    depth = _depth(model[0].shape[1] // 2)
    tries, places = _draws(trees, depth, f, seed)
    tries = _of_level(tries, level)
    free = np.take_along_axis(high > low, tries, axis=1)
    choice = np.where(free.any(axis=1) & (level < depth), tries[np.arange(len(tries)), free.argmax(axis=1)], -1)
    pick = np.arange(len(tries)), np.maximum(choice, 0)
    _extend(model, level, count, choice, low[pick].astype(float), high[pick].astype(float), _of_level(places, level))


def _c(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among n."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


def _as_score(path: np.ndarray, trees: int, size: int) -> np.ndarray:
    return 2.0 ** (-path.astype(float) / trees / max(float(_c(size)), 1e-9))


def score(model: Forest, x: np.ndarray, size: int) -> np.ndarray:
    """Anomaly score in (0, 1), near 1 isolated early; ``size`` is the number of rows that the forest grew over."""
    feature, threshold, path = model
    x = np.ascontiguousarray(x, dtype=np.float32)
    depth, total = int(math.log2(feature.shape[1] + 1)) - 1, np.zeros(len(x), dtype=np.float32)
    feature = np.maximum(feature, 0)  # below a leaf
    for a in range(0, len(x), BLOCK):
        block = x[a : a + BLOCK]
        flat, row, sum_ = block.ravel(), np.arange(len(block), dtype=np.intp) * x.shape[1], total[a : a + BLOCK]
        for f, line, p in zip(feature.astype(np.intp), threshold, path, strict=True):
            node = np.zeros(len(block), dtype=np.intp)
            for _ in range(depth):
                right = flat.take(row + f.take(node)) > line.take(node)
                node *= 2
                node += 1
                node += right
            sum_ += p.take(node)
    return _as_score(total, len(feature), size)


def plant(x: np.ndarray, rank: np.ndarray, n: int, times: float) -> tuple[np.ndarray, np.ndarray]:
    """Faults on readings like those of ``x``, which are at places ``rank`` of a series of ``n``: their numbers and their features.

    Fault i is on reading i modulo n and of shape i modulo ``SHAPES``: the first, middle, last and only one of a spike, up and
    down, and stuck ones. Every reading has one, those of a series shorter than ``FAULTS`` have more.
    """
    by, m = times * PLANT_BY, max(n, FAULTS)
    shift = np.array([(by * s, by * s * b, by * s * a, by * s, 0) for s in (1, -1) for b in (1, 0) for a in (1, 0)] + [(0, 0, 0, 0, 0)], dtype=np.float32)
    i = (np.asarray(rank) + n * np.arange(-(-m // max(n, 1)))[:, None]).ravel()
    on = np.tile(np.arange(len(x)), -(-m // max(n, 1)))[i < m]
    i = i[i < m]
    y = x[on] + shift[i % SHAPES]
    stuck = i % SHAPES == SHAPES - 1
    y[stuck, :3], y[stuck, 4] = 0, STUCK  # among equal neighbours nothing differs
    return i, np.clip(y, -FURTHEST, FURTHEST)


def grown_over(x: np.ndarray, number: np.ndarray, faults: np.ndarray) -> np.ndarray:
    """What a forest grows over: all readings and one planted fault for every ``PLANT_EVERY``."""
    return np.concatenate([x, faults[number % PLANT_EVERY == 0]])


def train(x: np.ndarray, times: float, trees: int, leaves: int, seed: int = SEED) -> tuple[Forest, np.ndarray, float]:
    """A series' forest from the rows of all its readings, their scores, and the threshold, from the scores of all of them and of a fault on each."""
    number, faults = plant(x, np.arange(len(x)), len(x), times)
    rows = grown_over(x, number, faults)
    model, path = _grown(rows, trees, leaves, seed)
    own, planted = _as_score(path[: len(x)], trees, len(rows)), score(model, faults, len(rows))
    shapes = [planted[number % SHAPES == k] for k in range(SHAPES)]
    least = min(_nth(p, math.floor(len(p) * PLANTED_BELOW)) for p in shapes)
    return model, own, min(_nth(own, len(own) - math.ceil(len(own) * NOMINATED)), least)


def verdicts(v: np.ndarray, x: dict[str, np.ndarray], scores: np.ndarray, threshold: float, scatter: float, limits: tuple[float, float], times: float) -> dict[str, np.ndarray]:
    """What becomes of each reading: ``by`` ("forest", "rule" or null: not nominated), ``limit``, ``spike``, ``stuck``."""
    far = max(times * scatter, 1e-9)
    forest_, rule = scores >= threshold, (reach(v) > far) | (x["run"] >= STUCK)
    at = np.flatnonzero(forest_ | rule)
    spike, stuck = np.zeros(len(v), dtype=bool), np.zeros(len(v), dtype=bool)
    spike[at], stuck[at] = departure(v, at) > far, x["run"][at] >= STUCK
    return {"by": np.where(forest_, "forest", np.where(rule, "rule", None)), "limit": (v < limits[0]) | (v > limits[1]), "spike": spike, "stuck": stuck}


# -- series over a cluster

OUT = "sensor string, metric string, event_time long, reading_id long, v double, score double, by string, limit boolean, spike boolean, stuck boolean"
_ARROW = pa.schema([("sensor", pa.string()), ("metric", pa.string()), ("event_time", pa.int64()), ("reading_id", pa.int64()), ("v", pa.float64()), ("score", pa.float64()), ("by", pa.string()), ("limit", pa.bool_()), ("spike", pa.bool_()), ("stuck", pa.bool_())])


def _features(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rank", kind="stable")
    pdf = pdf.assign(**local(pdf["v"].to_numpy(dtype=float)))
    return pdf.loc[pdf["core"], ["sensor", "metric", "chunk", "rank", "event_time", "reading_id", "v", *FEATURES[:3], "run"]]


FEATURE_SCHEMA = "sensor string, metric string, chunk long, rank long, event_time long, reading_id long, v double, level double, before double, after double, run long"


def cut_up(points: DataFrame, chunk_rows: int = 20_000) -> DataFrame:
    """``series`` in chunks with their neighbours; ``rank`` is a reading's place in its series, in order of event time, then ``reading_id``."""
    return chunks(points.withColumn("__day", F.floor(F.col("event_time") / 86_400)), SERIES, "__day", ["event_time", "reading_id", "v"], chunk_rows, max(STUCK, SIDE + SPIKE_LENGTH) + 1).drop("__day")


def features(points: DataFrame, chunk_rows: int = 20_000) -> DataFrame:
    """The features of every reading of ``series``. ``run`` is exact up to ``STUCK`` (12): a chunk brings more neighbours than that."""
    return cut_up(points, chunk_rows).groupBy(*SERIES, "chunk").applyInPandas(_features, FEATURE_SCHEMA)


def nth(rows: DataFrame, keys: list[str], value: str, share: float, at: Callable[[Column], Column]) -> DataFrame:
    """Per key ``n`` and ``value``: the one at place ``at(n)`` from 0, about ``share`` of ``n``, in ascending order. Exact.

    Sketches only bound where it lies (their ranks are off by one in 10,000 at most, the bounds leave three); the values
    between the bounds, about one in 1,250, are counted out, and it is an error if it isn't among them. Nulls are left out.
    """
    x = rows.select(*keys, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    sketch = F.percentile_approx("__v", [max(share - 3e-4, 0.0), min(share + 3e-4, 1.0)], 10_000)
    per = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch.alias("__s"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    few = F.col("n") < 10_000
    per = per.select(*keys, "n", F.when(few, F.col("__min")).otherwise(F.col("__s")[0]).alias("__low"), F.when(few, F.col("__max")).otherwise(F.col("__s")[1]).alias("__high"))
    v = F.col("__v")
    placed = x.join(per, keys).withColumn("__side", F.when(v < F.col("__low"), -1).when(v > F.col("__high"), 1).otherwise(0))
    counted = placed.groupBy(*keys, "n", "__side", F.when(F.col("__side") == 0, v).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__side", "__v").rowsBetween(Window.unboundedPreceding, 0))
    found = counted.withColumn("__upto", upto).where(F.col("__upto") > at(F.col("n"))).groupBy(*keys, "n").agg(F.min(F.struct("__side", "__v")).alias("__f"))
    outside = F.raise_error(F.lit(f"{value}: a sketch did not bound the value asked for"))
    return found.select(*keys, "n", F.when(F.col("__f.__side") == 0, F.col("__f.__v")).otherwise(outside).alias(value))


def _lower_half(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def statistics(feats: DataFrame) -> DataFrame:
    """Per series: ``n`` and ``scatter``: about one standard deviation of a reading around its local level.

    Scatter is 1.4826 times the median absolute distance from the level (of ten neighbours, whose own noise adds a
    sixth to the variance); where more than half of a series repeats its level, the mean absolute distance over the
    changing readings takes its place. Medians are exact.
    """
    size = feats.select(*SERIES, F.abs("level").alias("mad"))
    moving = nth(size.where("mad > 0").withColumnRenamed("mad", "mad_moving"), SERIES, "mad_moving", 0.5, _lower_half).drop("n")
    s = nth(size, SERIES, "mad", 0.5, _lower_half).join(moving, SERIES, "left")
    mad = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.coalesce("mad_moving", F.lit(0.0)))
    return s.select(*SERIES, "n", (mad * FROM_MEDIAN).alias("scatter"))


def _of_whole_sensors(points: DataFrame, metrics: dict, times: float, trees: int, leaves: int, only_bad: bool) -> DataFrame:
    """From features to verdict in one group per sensor. ``points``: ``sensor, event_time, reading_id`` and the metrics."""

    def judge(key: tuple, whole: pa.Table) -> pa.Table:
        out = []
        for metric, limits in metrics.items():
            v = whole.column(metric).to_numpy()
            t = whole.filter(pa.array(~np.isnan(v)))
            v, time, ids = t.column(metric).to_numpy(), t.column("event_time").to_numpy(), t.column("reading_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            if not len(v):
                continue
            order = np.lexsort((v, ids, time))
            v, time, ids = v[order], time[order], ids[order]
            x = local(v)
            scatter = scatter_of(x["level"])
            rows = vectors(x, time, v, usual_of(time, v), scatter)
            _, s, threshold = train(rows, times, trees, leaves)
            got = verdicts(v, x, s, threshold, scatter, limits, times)
            keep = np.flatnonzero(got["limit"] | got["spike"] | got["stuck"]) if only_bad else np.arange(len(v))
            n = len(keep)
            columns = [pa.repeat(key[0], n), pa.repeat(pa.scalar(metric), n), time[keep], t.column("reading_id").combine_chunks().take(pa.array(order[keep])), v[keep], s[keep], *[got[c][keep] for c in ("by", "limit", "spike", "stuck")]]
            out.append(pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW))
        return pa.concat_tables(out) if out else _ARROW.empty_table()

    return points.groupBy("sensor").applyInArrow(judge, OUT)


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _model(blob: bytes | None, trees: int, leaves: int) -> Forest:
    """A forest from its bytes, or one that has not grown yet."""
    model = _bare(trees, _depth(leaves))
    if blob is None:
        return model
    k = model[0].size
    parts = np.frombuffer(blob, np.int8, k), np.frombuffer(blob, np.float32, k, k), np.frombuffer(blob, np.float32, k, 5 * k)
    return tuple(p.reshape(model[0].shape).copy() for p in parts)


def _of_hot_sensors(points: DataFrame, metrics: dict, times: float, trees: int, leaves: int, chunk_rows: int, few: bool, only_bad: bool) -> DataFrame:
    """The same over chunks. ``points`` as of ``series``; ``few``: their models (75 KB each as a rule) fit any task.

    A forest grows level by level: chunks tell numbers and bounds of their rows per node, which are put together per series.
    """
    pieces = stored(cut_up(points, chunk_rows), "chunks")
    feats = stored(pieces.groupBy(*SERIES, "chunk").applyInPandas(_features, FEATURE_SCHEMA), "features")
    hour = F.floor(F.pmod(F.col("event_time"), F.lit(86_400)) / 3600).cast("int")
    season = nth(feats.withColumn("hour", hour), [*SERIES, "hour"], "v", 0.5, _lower_half)
    by_hour = season.groupBy(*SERIES).agg(F.map_from_entries(F.collect_list(F.struct("hour", "v"))).alias("usual"))  # 24 entries
    known = cut(statistics(feats).join(by_hour, SERIES))
    spread = cut(feats.select(*SERIES, "chunk").distinct())
    width, depth = len(FEATURES), _depth(leaves)

    def beside(of: DataFrame) -> DataFrame:
        """What is known of a series, for each of its chunks."""
        x = spread.join(of, SERIES)
        return x.select(*[F.col(c).alias(f"of_{c}") for c in (*SERIES, "chunk")], *[c for c in of.columns if c not in SERIES])

    def table(m: pd.Series) -> np.ndarray:
        usual = dict(m["usual"])
        return np.array([usual.get(h, 0.0) for h in range(24)])

    def pack(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        first, m = pdf.iloc[0], of.iloc[0]
        pdf = pdf.sort_values("rank", kind="stable")
        x = vectors({c: pdf[c].to_numpy() for c in (*FEATURES[:3], "run")}, pdf["event_time"].to_numpy(), pdf["v"].to_numpy(), table(m), m["scatter"])
        return pd.DataFrame({"sensor": [first["sensor"]], "metric": [first["metric"]], "chunk": [first["chunk"]], "first": [pdf["rank"].iloc[0]], "x": [_packed(x)]})

    by_chunk = lambda df: df.groupBy(*SERIES, "chunk")
    of_chunk = lambda df: df.groupBy("of_sensor", "of_metric", "of_chunk")
    packed = stored(by_chunk(feats).cogroup(of_chunk(beside(known))).applyInPandas(pack, "sensor string, metric string, chunk long, first long, x binary"), "vectors")

    def planted(r: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(r.x, np.float32).reshape(-1, width)
        return x, *plant(x, r.first + np.arange(len(x)), r.n, times)

    def with_models(models: DataFrame) -> DataFrame:
        if few:
            return packed.join(F.broadcast(models), SERIES).select(*SERIES, "first", "x", "n", "model")
        x = beside(models)
        same = [packed[c].eqNullSafe(x[f"of_{c}"]) for c in (*SERIES, "chunk")]
        return packed.join(x, same[0] & same[1] & same[2]).select(*SERIES, "first", "x", "n", "model")

    def tell(level: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for pdf in frames:
                for r in pdf.itertuples(index=False):
                    x, number, faults = planted(r)
                    count, low, high = bounds(grown_over(x, number, faults), _model(r.model, trees, leaves), level)
                    if (key := (r.sensor, r.metric)) in seen:
                        c, a, b = seen[key]
                        count, low, high = count + c, np.minimum(low, a), np.maximum(high, b)
                    seen[key] = count, low, high
            for (sensor, metric), (count, low, high) in seen.items():
                at = np.flatnonzero(count)
                yield pd.DataFrame({"sensor": sensor, "metric": metric, "node": at, "rows": count[at], **{f"low{j}": low[at, j] for j in range(width)}, **{f"high{j}": high[at, j] for j in range(width)}})

        return told

    def grow(level: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        def grown(nodes: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            m, k = of.iloc[0], trees << level
            model, count = _model(m["model"], trees, leaves), np.zeros(k, dtype=np.int64)
            low, high = np.full((k, width), np.inf, dtype=np.float32), np.full((k, width), -np.inf, dtype=np.float32)
            at = nodes["node"].to_numpy()
            count[at] = nodes["rows"]
            low[at], high[at] = nodes[[f"low{j}" for j in range(width)]].to_numpy(), nodes[[f"high{j}" for j in range(width)]].to_numpy()
            extend(model, level, count, low, high, SEED)
            return pd.DataFrame({"sensor": [m["of_sensor"]], "metric": [m["of_metric"]], "n": [m["n"]], "size": [count.sum() // trees], "model": [_packed(*model)]})

        return grown

    sides = [f"{side}{j}" for side in ("low", "high") for j in range(width)]
    models = known.select(*SERIES, "n", F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("model"))
    for level in range(depth + 1):
        told = with_models(models).mapInPandas(tell(level), f"sensor string, metric string, node long, rows long, {', '.join(f'{c} float' for c in sides)}")
        nodes = told.groupBy(*SERIES, "node").agg(F.sum("rows").alias("rows"), *[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in sides])
        of = models.select(F.col("sensor").alias("of_sensor"), F.col("metric").alias("of_metric"), "n", "model")
        models = cut(nodes.groupBy(*SERIES).cogroup(of.groupBy("of_sensor", "of_metric")).applyInPandas(grow(level), "sensor string, metric string, n long, size long, model binary"))

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                x, number, faults = planted(r)
                s = score(_model(r.model, trees, leaves), np.concatenate([x, faults]), r.n + -(-max(r.n, FAULTS) // PLANT_EVERY))
                yield pd.DataFrame({"sensor": r.sensor, "metric": r.metric, "shape": np.r_[np.full(len(x), -1), number % SHAPES], "score": s})

    scores = stored(with_models(models).mapInPandas(scored, "sensor string, metric string, shape int, score double"), "scores")
    own = nth(scores.where("shape < 0"), SERIES, "score", 1 - NOMINATED, lambda n: n - F.ceil(n * F.lit(NOMINATED))).select(*SERIES, "score")
    least = nth(scores.where("shape >= 0"), [*SERIES, "shape"], "score", PLANTED_BELOW, lambda n: F.floor(n * F.lit(PLANTED_BELOW))).select(*SERIES, "score")
    thresholds = own.unionByName(least).groupBy(*SERIES).agg(F.min("score").alias("threshold"))
    of_series = known.join(models.select(*SERIES, "size", "model"), SERIES).join(thresholds, SERIES)
    names = [f.name for f in _ARROW]

    def judge(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if not pdf["core"].any():  # only neighbours of the last chunk, or nothing
            return pd.DataFrame(columns=names)
        m = of.iloc[0]
        pdf = pdf.sort_values("rank", kind="stable")
        v, time = pdf["v"].to_numpy(), pdf["event_time"].to_numpy()
        x = local(v)
        s = score(_model(m["model"], trees, leaves), vectors(x, time, v, table(m), m["scatter"]), int(m["size"]))
        got = verdicts(v, x, s, m["threshold"], m["scatter"], metrics[pdf["metric"].iloc[0]], times)
        out = pdf.assign(score=s, **got)
        keep = pdf["core"].to_numpy(dtype=bool) & (got["limit"] | got["spike"] | got["stuck"] if only_bad else True)
        return out.loc[keep, names]

    return by_chunk(pieces).cogroup(of_chunk(beside(of_series))).applyInPandas(judge, OUT)


def flags(readings: DataFrame, times: float = 7.0, trees: int = 32, leaves: int = 128, chunk_rows: int = 20_000, whole_rows: int = 100_000, few_hot: int = 100, only_bad: bool = False) -> DataFrame:
    """Every scored value: ``sensor, metric, event_time, reading_id, v, score, by, limit, spike, stuck``.

    - ``by``: what nominated the value for the exact check, its score ("forest") or, below the threshold, its distance from its
      neighbours or run length ("rule"); null for the others.
    - ``limit``: outside the physical limits of ``LIMITS``.
    - ``spike``: nominated, and the value departs (see ``departure``) by more than ``times`` the series' scatter; a change that
      lasts departs from one side only.
    - ``stuck``: nominated, and in a run of at least 12 exactly equal values.

    A series' forest grows over all of its readings, with planted faults among them, in trees as deep as ``leaves`` leaves need;
    its threshold is from the scores of all readings and of a fault planted on each. Nulls and NaN are not scored. Repeated readings are successive readings of their series. A constant series has scatter 0: any departure is a
    spike. ``whole_rows``: sensors of more readings are cut into chunks; the forests of up to ``few_hot`` of these are broadcast. ``only_bad`` returns only values with a flag.
    """
    points = usable(readings).select("sensor", "event_time", "reading_id", *[F.col(m).cast("double").alias(m) for m in LIMITS])
    spelled = readings.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n")).withColumn("sensor", sensor_name("sensor_id"))
    hot = cut(spelled.groupBy("sensor").agg(F.sum("n").alias("n")).where((F.col("n") > whole_rows) & F.col("sensor").isNotNull()).select("sensor"))
    n_hot = hot.count()
    if not n_hot:
        return _of_whole_sensors(points, LIMITS, times, trees, leaves, only_bad)
    # one in ``whole_rows`` readings at most is the name of a hot sensor
    hot = F.broadcast(hot) if n_hot <= 100_000 else hot
    cold = _of_whole_sensors(points.join(hot, "sensor", "left_anti"), LIMITS, times, trees, leaves, only_bad)
    of_hot = stored(series(readings).join(hot, "sensor", "left_semi"), "hot")
    return cold.unionByName(_of_hot_sensors(of_hot, LIMITS, times, trees, leaves, chunk_rows, n_hot <= few_hot, only_bad))


def implausible(readings: DataFrame, **settings: float) -> DataFrame:
    """``reading_id`` and reasons of each implausible reading: one row, with ``temperature`` and ``humidity`` put together."""
    bad = flags(readings, only_bad=True, **settings)
    return bad.groupBy("reading_id", F.col("sensor").alias("sensor_id")).agg(F.max("limit").alias("limit"), F.max("spike").alias("spike"), F.max("stuck").alias("stuck"), F.max("score").alias("score"))
