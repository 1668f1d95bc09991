"""The object-store listing: one row per object, with the key as the authority on what the object is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.functions.naming import MARKER, compacted_of, is_data_file, millis_of, prefix_of


def newest(listing: DataFrame) -> DataFrame:
    """The row of newest ``last_modified`` of each key, for all names.

    Rows with a null key are no objects. Of rows with equal time the one with the larger known ``size`` counts
    (then the one marked compacted); a null ``last_modified`` is older than any.
    """
    row = F.struct("last_modified", "size", "compacted")
    return listing.where("key IS NOT NULL").groupBy("key").agg(F.max(row).alias("r")).select("key", "r.*")


def data_files(listing: DataFrame) -> DataFrame:
    """``key, prefix, millis, size, compacted, last_modified`` of each data file, from its newest row.

    ``prefix`` and ``millis`` come from the key; ``compacted`` is true if key or row says so.
    """
    key = F.col("key")
    return newest(listing.where(is_data_file(key))).select(
        "key", prefix_of(key).alias("prefix"), millis_of(key).alias("millis"), "size",
        (compacted_of(key) | F.coalesce(F.col("compacted"), F.lit(False))).alias("compacted"), "last_modified",
    )


def marked(listing: DataFrame) -> DataFrame:
    """Keys for which a marker ``<key>.processed`` is listed."""
    return listing.where(F.col("key").endswith(MARKER)).select(F.expr(f"left(key, length(key) - {len(MARKER)})").alias("key")).distinct()
