"""Cleaning of sensor readings: one spelling of the sensor, whole epoch seconds, and which readings are usable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def epoch_micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def sensor_name(column: str) -> Column:
    """``sensor-`` and the number in the text with at least four digits; null if there is no number."""
    c = F.col(column)
    # most names are in the right form already, which needs no regular expression to see
    right = (F.length(c) == 11) & c.startswith("sensor-") & (F.translate(F.substring(c, 8, 4), "0123456789", "") == "")
    number = F.regexp_replace(F.regexp_extract(column, r"([0-9]+)", 1), "^0+(?=.)", "")
    return F.when(right, c).when(number != "", F.concat(F.lit("sensor-"), F.lpad(number, 4, "0").substr(F.lit(1), F.greatest(F.lit(0), F.lit(4) - F.length(number))), number))


def event_seconds(column: str) -> Column:
    """Whole epoch seconds of a time in seconds, milliseconds or microseconds, told apart by magnitude."""
    t = F.col(column)
    return F.when(F.abs(t) >= 10**14, F.floor(t / F.lit(10**6))).when(F.abs(t) >= 10**11, F.floor(t / F.lit(10**3))).otherwise(t).cast("long")


def usable(readings: DataFrame, oldest: int = 7 * DAY, ahead: int = 3600) -> DataFrame:
    """Readings whose event time lies at most ``oldest`` seconds before and ``ahead`` after ``received_at``.

    Adds ``sensor`` and ``event_time``. Readings without a number in ``sensor_id``, without ``timestamp`` or
    without ``received_at`` belong to no sensor or no time and are never usable. Extra columns are kept.
    """
    df = readings.withColumn("sensor", sensor_name("sensor_id")).withColumn("event_time", event_seconds("timestamp"))
    got, at = epoch_micros("received_at"), F.col("event_time") * 1_000_000
    return df.where(F.col("sensor").isNotNull() & (at >= got - oldest * 1_000_000) & (at <= got + ahead * 1_000_000))


def is_number(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column)
