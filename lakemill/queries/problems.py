"""Queries of the general data problems (p1 to p4, p6, p7), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions.naming import millis_of, prefix_of
from lakemill.operators import drift, grid, incremental, late, smallfiles, spikes
from lakemill.operators.listing import data_files
from lakemill.queries.registry import Registry
from lakemill.session import cut, shared_path, table
from lakemill.streaming.late import LateEvents

R = Registry()

#: Usable readings, for the SQL side.
READINGS = r"""
clean AS (SELECT *, CASE WHEN abs("timestamp") >= 100000000000000 THEN CAST(floor("timestamp" / 1000000) AS BIGINT)
                         WHEN abs("timestamp") >= 100000000000 THEN CAST(floor("timestamp" / 1000) AS BIGINT) ELSE "timestamp" END AS et,
                 regexp_extract(sensor_id, '([0-9]+)', 1) AS num FROM sensor_reading),
usable AS (SELECT *, 'sensor-' || CASE WHEN length(CAST(CAST(num AS BIGINT) AS VARCHAR)) < 4 THEN lpad(CAST(CAST(num AS BIGINT) AS VARCHAR), 4, '0') ELSE CAST(CAST(num AS BIGINT) AS VARCHAR) END AS sensor
           FROM clean WHERE num <> '' AND et * 1000000 BETWEEN epoch_us(received_at) - 604800000000 AND epoch_us(received_at) + 3600000000)"""

NUMBERS = f"WITH {READINGS}, num AS (SELECT sensor, et, temperature FROM usable WHERE temperature IS NOT NULL AND NOT isnan(temperature))"

GRID = "g AS (SELECT sensor, unnest(range(lo, hi + 1)) AS p FROM (SELECT sensor, min(et // 900) AS lo, max(et // 900) AS hi FROM num GROUP BY sensor))"

FILES = r"""
parsed AS (SELECT *, regexp_extract(key, '^(?:.*/)?([a-z0-9_]+)\.([0-9]{1,18})(\.c)?\.parquet$', 1) AS pre,
                  CAST(nullif(regexp_extract(key, '^(?:.*/)?([a-z0-9_]+)\.([0-9]{1,18})(\.c)?\.parquet$', 2), '') AS BIGINT) AS millis,
                  key LIKE '%.c.parquet' AS c FROM file_meta),
data AS (SELECT key, pre AS prefix, millis, size, c OR coalesce(compacted, false) AS compacted, last_modified FROM parsed WHERE pre <> ''
         QUALIFY row_number() OVER (PARTITION BY key ORDER BY last_modified DESC NULLS LAST, size DESC NULLS LAST) = 1)"""

SMALL = f"""WITH {FILES},
small AS (SELECT *, millis // 86400000 AS day FROM data WHERE NOT compacted AND size >= 12 AND size < 1048576
          AND key || '.processed' NOT IN (SELECT key FROM file_meta WHERE key IS NOT NULL)),
cand AS (SELECT * FROM small QUALIFY count(*) OVER (PARTITION BY prefix, day) >= 5)"""


@R.add(sql=f"""{NUMBERS}, {GRID} SELECT sensor AS sensor_id, p * 900 AS period_start FROM g
WHERE NOT EXISTS (SELECT 1 FROM num n WHERE n.sensor = g.sensor AND n.et // 900 = g.p)""")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    # a gap is filled where the regression has support enough and marked where it hasn't: one or the other, never neither
    return _grid(spark, sf).where("n_readings = 0 AND (value IS NOT NULL) = (effective_support >= 2.0)").select("sensor_id", "period_start")


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid.regular_grid(table(spark, sf, "sensor_reading"))


@R.add(sql=f"""{NUMBERS}, {GRID}, one AS (SELECT sensor, et, avg(temperature) AS y FROM num GROUP BY ALL),
near AS (SELECT g.sensor, g.p, y, (et - g.p * 900 - 450) / 2250.0 AS u FROM g JOIN one ON one.sensor = g.sensor AND et // 900 BETWEEN g.p - 2 AND g.p + 2),
w AS (SELECT *, 1 - u * u AS w FROM near),
s AS (SELECT sensor, p, count(*) AS n, sum(CASE WHEN abs(u) <= 0.2 AND floor((u * 2250 + 450) / 900) = 0 THEN 1 ELSE 0 END) AS own, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * w) AS ww, sum(w * y) AS t0, sum(w * u * y) AS t1 FROM w GROUP BY ALL),
f AS (SELECT g.sensor, g.p, coalesce(n, 0) AS n, coalesce(own, 0) AS own, CASE WHEN s0 > 1e-9 THEN s0 * s0 / ww ELSE 0 END AS support,
      CASE WHEN s0 > 1e-9 THEN CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END END AS v
      FROM g LEFT JOIN s ON s.sensor = g.sensor AND s.p = g.p),
st AS (SELECT *, CASE WHEN own > 0 THEN 'observed' WHEN support >= 2.0 THEN 'filled' ELSE 'missing' END AS status FROM f)
SELECT sensor AS sensor_id, p * 900 AS period_start, CAST(own AS BIGINT) AS n_readings, CAST(n AS BIGINT) AS n_near, status,
       CASE WHEN status <> 'missing' THEN CAST(floor(v * 1000 + 0.5) AS BIGINT) END AS value_thousandths FROM st""")
def p1_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = _grid(spark, sf)
    return g.select("sensor_id", "period_start", "n_readings", "n_near", "status", F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("value_thousandths"))


EVENTS = f"""{FILES}, ev AS (SELECT process_name, file_name, regexp_extract(file_name, '^(?:.*/)?([a-z0-9_]+)\\.([0-9]{{1,18}})(\\.c)?\\.parquet$', 1) AS prefix,
      CAST(nullif(regexp_extract(file_name, '^(?:.*/)?([a-z0-9_]+)\\.([0-9]{{1,18}})(\\.c)?\\.parquet$', 2), '') AS BIGINT) AS ms, min(processed_at) AS done_at, arg_min(file_type, processed_at) AS file_type
      FROM files_processed WHERE processed_at IS NOT NULL AND process_name IS NOT NULL GROUP BY ALL),
judged AS (SELECT *, max(ms) OVER (PARTITION BY process_name, file_type ORDER BY epoch_us(done_at) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ms AS behind FROM ev WHERE ms IS NOT NULL)"""


def _advance(spark: SparkSession, sf: str) -> late.Advanced:
    return late.advance(late.arrivals(table(spark, sf, "files_processed"), table(spark, sf, "file_meta")))


@R.add(sql=f"WITH {EVENTS} SELECT process_name, file_name FROM judged WHERE behind > 21600000")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _advance(spark, sf).diverted.select("process_name", "file_name")


@R.add(sql=f"""WITH {EVENTS} SELECT process_name, prefix, ms // 3600000 * 3600000 AS window_start, count(*) AS n_files, CAST(sum(greatest(coalesce(size, 0), 0)) AS BIGINT) AS bytes
FROM (SELECT j.*, d.size FROM judged j LEFT JOIN data d ON d.key = j.file_name WHERE coalesce(behind, 0) <= 21600000) GROUP BY ALL""")
def p2_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _advance(spark, sf).upserts.select("process_name", "prefix", "window_start", "n_files", "bytes")


WINDOWS_SQL = R.sql["p2_windows"]


@R.add(sql=WINDOWS_SQL)
def p2_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The windows after raw records came in four batches in order of arrival, each to a stream that starts where the last stopped."""
    raw, inbox = table(spark, sf, "files_processed"), shared_path(spark, "p2-inbox")
    state = LateEvents(spark, shared_path(spark, "p2-state"), listing=cut(table(spark, sf, "file_meta")))
    at = F.unix_micros(F.col("processed_at").cast("timestamp"))
    low, high = raw.agg(F.min(at), F.max(at)).first()
    step = ((high or 0) - (low or 0)) // 4 + 1
    turn, progress = F.coalesce(F.floor((at - (low or 0)) / step), F.lit(0)), shared_path(spark, "p2-progress")
    for i in range(4):
        raw.where(turn == i).write.mode("append").parquet(inbox)
        state.start(spark.readStream.schema(raw.schema).parquet(inbox), progress).awaitTermination()
    return state.windows().select("process_name", "prefix", "window_start", "n_files", "bytes")


@R.add(sql=f"""WITH {EVENTS}, step AS (SELECT process_name, prefix, ms // 3600000 * 3600000 AS window_start, (epoch_us(done_at) // 3600000000 + 1) * 3600000000 AS emitted_us, count(*) AS n, sum(greatest(coalesce(size, 0), 0)) AS b
FROM (SELECT j.*, d.size FROM judged j LEFT JOIN data d ON d.key = j.file_name WHERE coalesce(behind, 0) <= 21600000) GROUP BY ALL)
SELECT process_name, prefix, window_start, emitted_us, count(*) OVER w AS revision, CAST(sum(n) OVER w AS BIGINT) AS n_files, CAST(sum(b) OVER w AS BIGINT) AS bytes
FROM step WINDOW w AS (PARTITION BY process_name, prefix, window_start ORDER BY emitted_us)""")
def p2_revisions(spark: SparkSession, sf: str) -> DataFrame:
    return late.revisions(_advance(spark, sf).accepted)


@R.add(sql=f"""WITH {EVENTS} SELECT process_name, prefix, count(*) AS n_late, max(behind) AS most_behind_ms FROM judged WHERE behind > 21600000 GROUP BY ALL""")
def p2_late_report(spark: SparkSession, sf: str) -> DataFrame:
    return _advance(spark, sf).diverted.groupBy("process_name", "prefix").agg(F.count(F.lit(1)).alias("n_late"), F.max("behind_ms").alias("most_behind_ms"))


_GROUPS = " UNION ALL ".join(f"""SELECT sensor, metric, n, {n} AS length, greatest(least_ - greatest(before, after), least(before, after) - most) AS d FROM (SELECT *,
 median(v) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before, median(v) OVER (w ROWS BETWEEN {n} FOLLOWING AND {n + 4} FOLLOWING) AS after,
 min(v) OVER (w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS least_, max(v) OVER (w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS most,
 count(*) OVER (w ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS held FROM s WINDOW w AS (PARTITION BY sensor, metric ORDER BY n)) WHERE held = {n} AND before IS NOT NULL AND after IS NOT NULL""" for n in (1, 2, 3))

#: Spikes by medians of windows, the scatter by a discrete quantile, stuck runs as islands.
SPIKES = f"""WITH {READINGS}, pts AS (SELECT sensor, 'temperature' AS metric, et, reading_id, temperature AS v FROM usable WHERE temperature IS NOT NULL AND NOT isnan(temperature)
 UNION ALL SELECT sensor, 'humidity', et, reading_id, humidity FROM usable WHERE humidity IS NOT NULL AND NOT isnan(humidity)),
s AS (SELECT *, row_number() OVER (PARTITION BY sensor, metric ORDER BY et, reading_id, v) AS n FROM pts),
lev AS (SELECT *, abs(coalesce(v - median(v) OVER (PARTITION BY sensor, metric ORDER BY n ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW), 0)) AS off FROM s),
sc AS (SELECT sensor, metric, coalesce(nullif(quantile_disc(off, 0.5), 0), quantile_disc(off, 0.5) FILTER (off > 0), 0) * {spikes.FROM_MEDIAN!r} AS scatter FROM lev GROUP BY ALL),
groups AS ({_GROUPS}),
far AS (SELECT sensor, metric, n + k AS n, max(d) AS d FROM groups, (SELECT unnest([0, 1, 2]) AS k) WHERE k < length GROUP BY ALL),
runs AS (SELECT sensor, metric, n, count(*) OVER (PARTITION BY sensor, metric, v, i) AS run FROM (SELECT *, n - row_number() OVER (PARTITION BY sensor, metric, v ORDER BY n) AS i FROM s)),
bad AS (SELECT s.reading_id FROM s JOIN sc USING (sensor, metric) JOIN runs USING (sensor, metric, n) LEFT JOIN far USING (sensor, metric, n)
 WHERE run >= 12 OR d > greatest(7 * scatter, 1e-9) OR (metric = 'temperature' AND (v < -60 OR v > 85)) OR (metric = 'humidity' AND (v < 0 OR v > 100)))"""


@R.add(sql=f"{SPIKES} SELECT DISTINCT reading_id FROM bad")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.implausible(table(spark, sf, "sensor_reading")).select("reading_id")


@R.add()
def p3_scores(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.flags(table(spark, sf, "sensor_reading"))


SNAPSHOTS = """
heads AS (SELECT table_name, arg_max(snapshot_id, sequence_number) AS id FROM snapshot_log WHERE branch = 'main' GROUP BY ALL),
line AS (SELECT s.table_name, s.snapshot_id, s.parent_snapshot_id, s.sequence_number, s.operation FROM snapshot_log s JOIN heads h ON h.table_name = s.table_name AND h.id = s.snapshot_id
         UNION SELECT s.table_name, s.snapshot_id, s.parent_snapshot_id, s.sequence_number, s.operation FROM line l JOIN snapshot_log s ON s.table_name = l.table_name AND s.snapshot_id = l.parent_snapshot_id),
acked AS (SELECT process_name, table_name, arg_max(last_snapshot_id, recorded_at) FILTER (outcome = 'acked') AS id FROM poller_state GROUP BY ALL),
unread AS (SELECT a.process_name, l.table_name, l.snapshot_id, l.sequence_number FROM acked a LEFT JOIN (SELECT DISTINCT table_name, snapshot_id, sequence_number FROM snapshot_log) s ON s.table_name = a.table_name AND s.snapshot_id = a.id
           JOIN line l ON l.table_name = a.table_name WHERE l.operation IS DISTINCT FROM 'replace' AND (s.sequence_number IS NULL OR l.sequence_number > s.sequence_number))"""

FILE_WORK = f"""{FILES}, file_work AS (SELECT DISTINCT s.process_name, d.key AS item FROM data d JOIN subscription s ON s.file_type = d.prefix
WHERE NOT d.compacted AND d.size IS DISTINCT FROM 0 AND NOT EXISTS (SELECT 1 FROM files_processed f WHERE f.process_name = s.process_name AND f.file_name = d.key AND f.processed_at >= d.last_modified))"""


def _file_source(spark: SparkSession, sf: str) -> DataFrame:
    """(process, file, version) of every file that a process reads."""
    files = data_files(table(spark, sf, "file_meta")).where("NOT compacted AND (size IS NULL OR size <> 0)")
    subs = table(spark, sf, "subscription").where("process_name IS NOT NULL").select("process_name", F.col("file_type").alias("prefix")).distinct()
    return files.join(subs, "prefix").select("process_name", F.col("key").alias("item"), F.col("last_modified").alias("version"), "size")


def _finished(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files_processed").where("processed_at IS NOT NULL").select("process_name", F.col("file_name").alias("item"), F.col("processed_at").alias("version"))


@R.add(sql=f"WITH RECURSIVE {FILE_WORK}, {SNAPSHOTS} SELECT process_name, item FROM file_work UNION ALL SELECT process_name, CAST(snapshot_id AS VARCHAR) AS item FROM unread")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Two targets that hold, as key and version of each row, what was finished so far, and a run of each."""
    files = incremental.Target(spark, shared_path(spark, "p4-files"), ["process_name", "item"], "version")
    files.replace(_finished(spark, sf))
    log, states = table(spark, sf, "snapshot_log"), table(spark, sf, "poller_state")
    scope = ["process_name", "table_name"]
    snapshots = incremental.Target(spark, shared_path(spark, "p4-snapshots"), [*scope, "snapshot_id"], "sequence_number", scope)
    snapshots.replace(incremental.acked(log, states))
    new = snapshots.run(incremental.snapshot_work(log, states)).select("process_name", F.col("snapshot_id").cast("string").alias("item"))
    return files.run(_file_source(spark, sf)).select("process_name", "item").unionByName(new)


@R.add(sql=f"""WITH {FILE_WORK}, later AS (SELECT *, CASE WHEN epoch_us(last_modified) // 3600000000 % 2 = 0 THEN 1 ELSE 2 END AS run FROM file_work JOIN data d ON d.key = item)
SELECT process_name, run, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS bytes FROM later GROUP BY ALL""")
def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs onto one target: of half the source, of the whole with a failure before publishing, and of the whole again."""
    target = incremental.Target(spark, shared_path(spark, "p4-runs"), ["process_name", "item"], "version")
    source, done = _file_source(spark, sf), _finished(spark, sf)
    even = F.pmod(F.floor(F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', version)")), F.lit(2)) == 0
    first = target.run(source.where(even), done=done).withColumn("run", F.lit(1))

    def fails(df: DataFrame) -> DataFrame:
        raise RuntimeError("a run that fails before it publishes")

    try:
        target.run(source, fails, done)
    except RuntimeError:
        pass
    second = target.run(source, done=done).withColumn("run", F.lit(2))
    return first.unionByName(second).groupBy("process_name", "run").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("bytes"))


@R.add(sql=f"{SMALL} SELECT key AS file_key FROM cand")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    planned = smallfiles.plan(smallfiles.candidates(table(spark, sf, "file_meta")))
    return planned.select(F.col("key").alias("file_key"))


@R.add(sql=f"""{SMALL}, run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY prefix, day ORDER BY millis, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 134217728 AS output_no FROM cand)
SELECT prefix, day, CAST(output_no AS BIGINT) AS output_no, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, min(millis) AS first_millis, max(millis) AS last_millis FROM run GROUP BY ALL""")
def p6_outputs(spark: SparkSession, sf: str) -> DataFrame:
    planned = smallfiles.plan(smallfiles.candidates(table(spark, sf, "file_meta")))
    return smallfiles.outputs(planned).drop("output_key")


@R.add(sql=r"""WITH lines AS (SELECT file_key, regexp_extract(file_key, '^([a-z0-9_]+)\.([0-9]+)\.parquet$', 1) AS feed, CAST(regexp_extract(file_key, '^([a-z0-9_]+)\.([0-9]+)\.parquet$', 2) AS BIGINT) AS ms, record_id, payload FROM raw_record WHERE payload IS NOT NULL),
f AS (SELECT file_key, feed, ms // 2592000000 AS day, ms, sum(octet_length(encode(payload)) + 1) AS all_bytes, sum(octet_length(encode(payload)) + 1) - CASE WHEN arg_max(payload, record_id) <> '' THEN 1 ELSE 0 END AS size FROM lines GROUP BY ALL),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY feed, day ORDER BY ms, file_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1048576 AS output_no FROM f)
SELECT feed, CAST(day AS BIGINT) AS day, CAST(output_no AS BIGINT) AS output_no, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes_in, CAST(sum(all_bytes) AS BIGINT) AS bytes_out, true AS whole FROM o GROUP BY ALL""")
def p6_concat(spark: SparkSession, sf: str) -> DataFrame:
    """The raw lines of every feed written as files, and these joined byte by byte to outputs of about 1 MiB per month."""
    root = shared_path(spark, "p6-lines")
    files = cut(smallfiles.write_lines(table(spark, sf, "raw_record"), f"{root}/in"))
    key = F.col("key")
    listed = files.select("key", "size", prefix_of(key).alias("prefix"), millis_of(key).alias("millis")).withColumn("day", F.floor(F.col("millis") / (30 * smallfiles.DAY_MS)).cast("long"))
    planned = cut(smallfiles.plan(listed, target=1 << 20, ending=".c.jsonl"))
    report = smallfiles.concatenate(spark, planned, f"{root}/in", f"{root}/out")
    outputs = planned.groupBy("prefix", "day", "output_no", "output_key").agg(F.count(F.lit(1)).alias("n_files"))
    x = outputs.join(report.drop("n_files"), "output_key")
    return x.select(F.col("prefix").alias("feed"), "day", "output_no", "n_files", "bytes_in", "bytes_out", (F.col("error").isNull() & F.col("sha256").isNotNull()).alias("whole"))


FIELDS = r"""
good AS (SELECT file_key, payload, regexp_extract(file_key, '^([a-z0-9_]+)\.([0-9]+)\.parquet$', 1) AS feed, CAST(regexp_extract(file_key, '^([a-z0-9_]+)\.([0-9]+)\.parquet$', 2) AS BIGINT) AS ms,
         json_valid(payload) AND payload LIKE '{%' AS ok FROM raw_record),
files AS (SELECT feed, file_key, row_number() OVER (PARTITION BY feed ORDER BY min(ms), file_key) AS no FROM good GROUP BY feed, file_key),
keys AS (SELECT file_key, payload, unnest(json_keys(payload)) AS field FROM good WHERE ok),
typed AS (SELECT file_key, field, CASE json_type(payload, '$."' || field || '"') WHEN 'BOOLEAN' THEN 'boolean' WHEN 'BIGINT' THEN 'long' WHEN 'UBIGINT' THEN 'long' WHEN 'DOUBLE' THEN 'double' WHEN 'NULL' THEN NULL ELSE 'string' END AS t FROM keys),
feet AS (SELECT feed, f.file_key, no, field, CASE WHEN count(DISTINCT t) = 0 THEN NULL WHEN count(DISTINCT t) = 1 THEN min(t) WHEN count(DISTINCT t) = 2 AND min(t) = 'double' AND max(t) = 'long' THEN 'double' ELSE 'string' END AS t
         FROM typed JOIN files f ON f.file_key = typed.file_key GROUP BY ALL),
pairs AS (SELECT n.feed, n.file_key, p.file_key AS prev FROM files n JOIN files p ON p.feed = n.feed AND p.no = n.no - 1),
came AS (SELECT p.file_key, n.field FROM pairs p JOIN feet n ON n.file_key = p.file_key ANTI JOIN feet o ON o.file_key = p.prev AND o.field = n.field),
gone AS (SELECT p.file_key, o.field FROM pairs p JOIN feet o ON o.file_key = p.prev ANTI JOIN feet n ON n.file_key = p.file_key AND n.field = o.field),
re AS (SELECT p.file_key, n.field FROM pairs p JOIN feet n ON n.file_key = p.file_key JOIN feet o ON o.file_key = p.prev AND o.field = n.field WHERE o.t <> n.t),
rn AS (SELECT c.file_key, c.field AS new, g.field AS old FROM came c JOIN column_alias a ON a.column_name = c.field JOIN gone g ON g.file_key = c.file_key JOIN column_alias b ON b.column_name = g.field AND b.canonical_name = a.canonical_name),
found AS (SELECT file_key, new AS column_name, 'renamed' AS change FROM rn
 UNION ALL SELECT file_key, field, 'added' FROM came WHERE (file_key, field) NOT IN (SELECT (file_key, new) FROM rn)
 UNION ALL SELECT file_key, field, 'dropped' FROM gone WHERE (file_key, field) NOT IN (SELECT (file_key, old) FROM rn)
 UNION ALL SELECT file_key, field, 'retyped' FROM re)"""


def _feet(spark: SparkSession, sf: str) -> DataFrame:
    return drift.footers(table(spark, sf, "raw_record"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    files = cut(drift.files_in_order(table(spark, sf, "raw_record")))
    spans = cut(drift.lifespans(_feet(spark, sf), files))
    return drift.changes(spans, files, table(spark, sf, "column_alias")).select("file_key", "column_name", "change")


@R.add(sql=f"WITH {FIELDS} SELECT file_key, column_name, change FROM found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)


@R.add(sql=f"""WITH {FIELDS}, isl AS (SELECT feed, field, coalesce(t, 'unknown') AS type, no, no - row_number() OVER (PARTITION BY feed, field, coalesce(t, 'unknown') ORDER BY no) AS i FROM feet)
SELECT feed, field, type, min(no) - 1 AS first_file, max(no) - 1 AS last_file, count(*) AS n_files FROM isl GROUP BY feed, field, type, i""")
def p7_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    return drift.lifespans(_feet(spark, sf), drift.files_in_order(table(spark, sf, "raw_record")))


@R.add(sql=f"""WITH {FIELDS}, cells AS (SELECT record_id, a.canonical_name, max(json_type(payload, '$."' || a.column_name || '"') <> 'NULL') AS has FROM good JOIN raw_record USING (file_key, payload) CROSS JOIN (SELECT DISTINCT canonical_name, column_name FROM column_alias WHERE column_name IS NOT NULL AND canonical_name IS NOT NULL) a WHERE ok GROUP BY ALL)
SELECT canonical_name, count(DISTINCT CASE WHEN has THEN record_id END) AS n_values FROM cells GROUP BY 1""")
def p7_filled(spark: SparkSession, sf: str) -> DataFrame:
    """How many records have a value in each column of the one table: no alias and no form of a value is lost."""
    x = p7_table(spark, sf)
    names = [c for c in x.columns if c not in ("record_id", "file_key", "whole", "other")]
    if not names:
        return spark.createDataFrame([], "canonical_name string, n_values long")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("canonical_name"), F.col(f"`{n}`").isNotNull().alias("has")) for n in names]))
    return x.where("whole").select(each.alias("x")).groupBy("x.canonical_name").agg(F.count(F.when(F.col("x.has"), 1)).alias("n_values"))


@R.add()
def p7_table(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "raw_record")
    return drift.consistent(raw, drift.casts(_feet(spark, sf), table(spark, sf, "column_alias")))


@R.add(sql=f"""WITH {FIELDS}, logged AS (SELECT file_key, unnest(columns_added) AS column_name, 'added' AS change FROM schema_reconciliation UNION SELECT file_key, unnest(columns_dropped), 'dropped' FROM schema_reconciliation),
seen AS (SELECT DISTINCT file_key, column_name, change FROM found)
SELECT change, count(*) AS n, CAST(sum(CASE WHEN l.file_key IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS not_logged FROM seen s LEFT JOIN logged l USING (file_key, column_name, change) GROUP BY change""")
def p7_unlogged(spark: SparkSession, sf: str) -> DataFrame:
    """What the present program's log lacks, by kind of change."""
    found = _changes(spark, sf).distinct()
    log = table(spark, sf, "schema_reconciliation")
    one = lambda c, kind: log.select("file_key", F.explode(c).alias("column_name"), F.lit(kind).alias("change"))
    logged = one("columns_added", "added").unionByName(one("columns_dropped", "dropped")).distinct().withColumn("in_log", F.lit(1))
    return found.join(logged, ["file_key", "column_name", "change"], "left").groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("in_log").isNull(), 1).otherwise(0)).cast("long").alias("not_logged"))

