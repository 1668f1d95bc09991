"""The problems' tables in small: empty, and with nulls in every column and columns that bear names used inside operators."""

from pyspark.sql import functions as F

SCHEMAS = {
    "sensor_reading": "reading_id long, batch_id long, sensor_id string, timestamp long, temperature double, humidity double, location string, received_at timestamp_ntz",
    "file_meta": "key string, prefix string, timestamp timestamp_ntz, size long, compacted boolean, last_modified timestamp_ntz",
    "files_processed": "process_name string, file_name string, file_type string, file_timestamp timestamp_ntz, processed_at timestamp_ntz",
    "subscription": "process_name string, file_type string",
    "snapshot_log": "table_name string, snapshot_id long, parent_snapshot_id long, sequence_number long, committed_at timestamp_ntz, operation string, branch string",
    "poller_state": "process_name string, table_name string, last_snapshot_id long, recorded_at timestamp_ntz, outcome string",
    "raw_record": "record_id long, file_key string, payload string",
    "schema_reconciliation": "file_key string, columns_added array<string>, columns_dropped array<string>, reconciled_at timestamp_ntz",
    "column_alias": "canonical_name string, column_name string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, commit_id string, author string, committed_at timestamp_ntz, parent_count int",
    "mix_target": "source string, weight double, max_repeats int",
}
#: Names that operators use for columns of their own.
CLASHING = ("sensor", "event_time", "chunk", "rank", "v", "p", "tokens", "curve_key", "feed", "millis", "day", "item", "version", "__slice", "x", "n", "kept_id", "shard", "repeat", "block")


def write(spark, path, nulls=False):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame([], schema)
        if nulls:
            df = spark.createDataFrame([(None,) * len(df.columns)] * 2, schema)
            df = df.select("*", *[F.lit(7).alias(c) for c in CLASHING if c not in df.columns])
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)
