"""Event-time windows corrected by late records up to a cut-off.

State is two keyed tables: the watermark of each (process, file type) and the aggregate of each window. ``advance``
takes a batch of arrivals through them: records behind the watermark by more than the allowed lateness are diverted,
the others are aggregated into their windows, and each touched window leaves as an upsert. A whole history is one batch;
``lakemill.streaming.late`` calls the same function for each micro-batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions.naming import millis_of, prefix_of
from lakemill.operators.listing import data_files
from lakemill.operators.ordered import Scan, scan
from lakemill.operators.readings import epoch_micros

HOUR_MS = 3_600_000
WATERMARK = ["process_name", "file_type"]
WINDOW = ["process_name", "prefix", "window_start"]


def arrivals(processed: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """One event per (process, file) at its earliest ``processed_at``, with its event time from the name and its size.

    Records that never finished (``processed_at`` null), without process or of a name without a time are no events.
    A file not listed, or of unknown size, counts with 0 bytes. A null ``file_type`` is taken from the name.
    """
    rows = processed.where("process_name IS NOT NULL AND processed_at IS NOT NULL").withColumn("event_ms", millis_of(F.col("file_name"))).where("event_ms IS NOT NULL")
    rows = rows.withColumn("arrived_us", epoch_micros("processed_at")).withColumn("file_type", F.coalesce("file_type", prefix_of(F.col("file_name"))))
    first = rows.groupBy("process_name", "file_name").agg(F.min(F.struct("arrived_us", "file_type")).alias("r"), F.first("event_ms").alias("event_ms"))
    events = first.select("process_name", "file_name", "r.*", "event_ms").withColumn("prefix", prefix_of(F.col("file_name")))
    if listing is None:
        return events.withColumn("bytes", F.lit(0).cast("long"))
    sizes = data_files(listing).select(F.col("key").alias("file_name"), F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).alias("bytes"))
    return events.join(sizes, "file_name", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))


@dataclass(frozen=True)
class Advanced:
    accepted: DataFrame
    diverted: DataFrame
    watermarks: DataFrame
    upserts: DataFrame


def advance(events: DataFrame, watermarks: DataFrame | None = None, windows: DataFrame | None = None, lateness_ms: int = 6 * HOUR_MS, width_ms: int = HOUR_MS, slice_us: int = 600 * 10**6) -> Advanced:
    """Takes ``events`` (see ``arrivals``) through the state.

    The watermark an event meets is the greatest event time of its (process, file type) among the state and the
    events that arrived strictly earlier; an event more than ``lateness_ms`` behind it is diverted (with ``behind_ms``),
    and still moves no window. ``watermarks`` has ``max_event_ms`` per key, ``windows`` has ``n_files``, ``bytes`` and
    ``last_arrived_us`` per window; both None at first. The watermark is found by a scan over slices of arrival time,
    so one hot key is spread. An empty batch changes nothing.
    """
    seen = scan(events.withColumn("__slice", F.floor(F.col("arrived_us") / slice_us)), WATERMARK, "__slice", ["arrived_us"], [Scan("__seen", "event_ms", "max", "strict")]).drop("__slice")
    if watermarks is not None:
        old = watermarks.select(*[F.col(c).alias(f"__{c}") for c in WATERMARK], F.col("max_event_ms").alias("__old"))
        seen = seen.join(old, F.col("process_name").eqNullSafe(F.col("__process_name")) & F.col("file_type").eqNullSafe(F.col("__file_type")), "left")
        seen = seen.withColumn("__seen", F.greatest("__seen", "__old")).drop("__old", *[f"__{c}" for c in WATERMARK])
    behind = F.coalesce(F.col("__seen") - F.col("event_ms"), F.lit(0))
    judged = seen.withColumn("behind_ms", behind).drop("__seen")
    accepted, diverted = judged.where(F.col("behind_ms") <= lateness_ms), judged.where(F.col("behind_ms") > lateness_ms)

    marks = events.groupBy(*WATERMARK).agg(F.max("event_ms").alias("max_event_ms"))
    if watermarks is not None:
        marks = marks.unionByName(watermarks.select(*WATERMARK, "max_event_ms")).groupBy(*WATERMARK).agg(F.max("max_event_ms").alias("max_event_ms"))

    start = (F.floor(F.col("event_ms") / width_ms) * width_ms).cast("long")
    fresh = accepted.withColumn("window_start", start).groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.max("arrived_us").alias("last_arrived_us"), F.lit(1).alias("touched"))
    if windows is not None:
        both = fresh.unionByName(windows.select(*WINDOW, "n_files", "bytes", "last_arrived_us").withColumn("touched", F.lit(0)))
        fresh = both.groupBy(*WINDOW).agg(F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes"), F.max("last_arrived_us").alias("last_arrived_us"), F.max("touched").alias("touched")).where("touched = 1")
    return Advanced(accepted, diverted, marks, fresh.drop("touched"))


def merge_windows(windows: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The windows after an upsert: aggregates of the same window are added up."""
    both = fresh if windows is None else windows.unionByName(fresh)
    return both.groupBy(*WINDOW).agg(F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes"), F.max("last_arrived_us").alias("last_arrived_us"))


def revisions(accepted: DataFrame, width_ms: int = HOUR_MS, every_us: int = 3600 * 10**6) -> DataFrame:
    """The upserts as emitted once per ``every_us`` of arrival time: each row replaces the window's last one.

    ``revision`` counts from 1 per window. The history is first aggregated to a row per window and arrival period.
    """
    x = accepted.withColumn("window_start", (F.floor(F.col("event_ms") / width_ms) * width_ms).cast("long")).withColumn("emitted_us", (F.floor(F.col("arrived_us") / every_us) + 1) * every_us)
    step = x.groupBy(*WINDOW, "emitted_us").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    w = Window.partitionBy(*WINDOW).orderBy("emitted_us").rowsBetween(Window.unboundedPreceding, 0)
    return step.select(*WINDOW, F.col("emitted_us").cast("long").alias("emitted_us"), F.count(F.lit(1)).over(w).alias("revision"), F.sum("n").over(w).alias("n_files"), F.sum("b").over(w).alias("bytes"))
