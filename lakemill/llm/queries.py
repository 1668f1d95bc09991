"""Queries of the problems on documents in tokens and of batch de-duplication, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import mix, pack, split, suffix
from lakemill.queries.problems import READINGS
from lakemill.queries.registry import Registry
from lakemill.session import cut, shared_path, table

R = Registry()

#: The decision in SQL: one row per sensor and second, with the steps along runs of seconds that wait for a neighbour.
DECIDED = f"""WITH {READINGS}, sec AS (SELECT sensor, et, min(reading_id) AS id FROM usable GROUP BY ALL),
nb AS (SELECT a.*, CASE WHEN b.id < a.id THEN b.id END AS before, CASE WHEN c.id < a.id THEN c.id END AS after FROM sec a LEFT JOIN sec b ON b.sensor = a.sensor AND b.et = a.et - 1 LEFT JOIN sec c ON c.sensor = a.sensor AND c.et = a.et + 1),
l AS (SELECT sensor, et, row_number() OVER (PARTITION BY sensor, et - rn ORDER BY et) AS k FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY et) AS rn FROM nb WHERE before IS NOT NULL)),
r AS (SELECT sensor, et, row_number() OVER (PARTITION BY sensor, et + rn ORDER BY et DESC) AS k FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY et DESC) AS rn FROM nb WHERE after IS NOT NULL)),
st AS (SELECT nb.sensor, nb.et, id, least(CASE WHEN l.k % 2 = 1 THEN before END, CASE WHEN r.k % 2 = 1 THEN after END) AS kept FROM nb LEFT JOIN l ON l.sensor = nb.sensor AND l.et = nb.et LEFT JOIN r ON r.sensor = nb.sensor AND r.et = nb.et),
judged AS (SELECT u.reading_id, u.sensor, u.et, u.batch_id, CASE WHEN u.reading_id = st.id THEN kept ELSE coalesce(kept, st.id) END AS kept_id FROM usable u JOIN st ON st.sensor = u.sensor AND st.et = u.et)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.judge(table(spark, sf, "sensor_reading"))


@R.add(sql=f"{DECIDED} SELECT kept_id, reading_id AS duplicate_id FROM judged WHERE kept_id IS NOT NULL")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).where("kept_id IS NOT NULL").select("kept_id", F.col("reading_id").alias("duplicate_id"))


def _by_days(spark: SparkSession, sf: str) -> tuple[suffix.History, list[DataFrame]]:
    """The batches through a stored index, one take a day of arrival, each reading and growing what the takes before it left."""
    x = table(spark, sf, "sensor_reading").withColumn("batch_id", F.coalesce("batch_id", F.lit(0)))
    came = x.where("reading_id IS NOT NULL").groupBy("batch_id").agg(F.min(F.to_date("received_at")).alias("day")).where("day IS NOT NULL").collect()  # as many as batches
    history = suffix.History(spark, shared_path(spark, "p5-history"))
    return history, [history.take(x.where(F.col("batch_id").isin([r["batch_id"] for r in came if r["day"] == day]))) for day in sorted({r["day"] for r in came})]


@R.add(sql=f"{DECIDED} SELECT kept_id, reading_id AS duplicate_id FROM judged WHERE kept_id IS NOT NULL")
def p5_history(spark: SparkSession, sf: str) -> DataFrame:
    out = spark.createDataFrame([], "kept_id long, duplicate_id long")
    for judged in _by_days(spark, sf)[1]:
        out = out.unionByName(judged.where("kept_id IS NOT NULL").select("kept_id", F.col("reading_id").alias("duplicate_id")))
    return out


@R.add(sql=f"{DECIDED} SELECT CAST(floor(et / 86400) AS BIGINT) AS day, count(*) AS records FROM judged WHERE kept_id IS NULL GROUP BY 1")
def p5_index(spark: SparkSession, sf: str) -> DataFrame:
    """How many accepted readings the index holds of each day: what a take that touches the day reads."""
    return _by_days(spark, sf)[0].report().select("day", "records")


@R.add(sql=f"{DECIDED} SELECT batch_id, count(*) AS n, CAST(count(kept_id) AS BIGINT) AS n_rejected FROM judged GROUP BY batch_id")
def p5_batches(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count("kept_id").alias("n_rejected"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack.pack(table(spark, sf, "documents"))


@R.add()
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).where("n_pieces > 1 AND piece_no = 0").select("doc_id")


@R.add()
def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


@R.add()
def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack.containers(_packed(spark, sf))


@R.add(sql="SELECT count(*) AS n_documents, count(*) AS n_placed, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_far FROM documents")
def p8_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every document placed once, no container over its capacity, nothing split that fits, neighbours of the curve only."""
    return pack.broken(_packed(spark, sf), table(spark, sf, "documents"))


@R.add()
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    # no source is dealt more than its quota; short ones are dealt all they have, as often as they may
    return p9_shares(spark, sf).where("short AND used_tokens <= quota_tokens").select("source")


@R.add()
def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix.shares(*mix.mix(table(spark, sf, "documents"), table(spark, sf, "mix_target")))


@R.add()
def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mix.mix(table(spark, sf, "documents"), table(spark, sf, "mix_target"))[0]


@R.add(sql="""WITH d AS (SELECT source, doc_id FROM documents WHERE source IN (SELECT source FROM mix_target WHERE weight > 0 AND max_repeats > 0))
SELECT source, true AS within_repeats, true AS within_quota, true AS each_once, true AS positions_whole FROM d GROUP BY source""")
def p9_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source used: no document more often than allowed, no more tokens than its quota, no use twice, shards without gaps."""
    mixture, plan = mix.mix(table(spark, sf, "documents"), table(spark, sf, "mix_target"))
    mixture = cut(mixture)
    shards = mixture.groupBy("shard").agg((F.count(F.lit(1)) == F.max("position") + 1).alias("whole"), F.countDistinct("position").alias("n"), F.count(F.lit(1)).alias("rows"))
    whole = shards.agg(F.count(F.when(~F.col("whole") | (F.col("n") != F.col("rows")), 1)).alias("n_bad"))
    rule = spark.createDataFrame([(q.source, q.max_repeats, q.quota) for q in plan], "source string, max_repeats long, quota long")
    uses = mixture.groupBy("source", "doc_id", "repeat").agg(F.count(F.lit(1)).alias("times"), F.sum("tokens").alias("tokens"))
    per = uses.groupBy("source").agg(F.max("repeat").alias("most"), F.max("times").alias("times"), F.sum("tokens").alias("tokens")).join(rule, "source").crossJoin(whole)  # one row
    return per.select("source", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.col("tokens") <= F.col("quota")).alias("within_quota"), (F.col("times") == 1).alias("each_once"), (F.col("n_bad") == 0).alias("positions_whole"))


@R.add()
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.pieces(table(spark, sf, "documents"), with_text=False).where("piece_no = 0").select("doc_id")


@R.add()
def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.pieces(table(spark, sf, "documents"))


@R.add(sql="SELECT CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_overlap, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_ends, CAST(0 AS BIGINT) AS n_foreign")
def p10_rules(spark: SparkSession, sf: str) -> DataFrame:
    """How often a rule of splitting is broken.

    ``n_over``: pieces over the limit; ``n_overlap``: an overlap that isn't 64 tokens (up to 67 where 64 would cut a character);
    ``n_gaps``: pieces that don't go on where the one before ended; ``n_ends``: documents whose pieces don't begin and end with
    the text; ``n_foreign``: pieces whose text isn't in the document.
    """
    p = cut(split.pieces(table(spark, sf, "documents")))
    before = p.select("doc_id", (F.col("piece_no") + 1).alias("piece_no"), F.col("end_token").alias("end_before"))
    text = table(spark, sf, "documents").select("doc_id", F.col("text").alias("whole"))
    x = p.join(before, ["doc_id", "piece_no"], "left").join(text, "doc_id")
    n = lambda c: F.count(F.when(c, 1))
    first, last = F.col("piece_no") == 0, F.col("piece_no") == F.col("n_pieces") - 1
    ends = (first & ~F.col("whole").startswith(F.col("text"))) | (last & ~F.col("whole").endswith(F.col("text")))
    return x.agg(
        n(F.col("tokens") > 2048).alias("n_over"), n(~first & ~F.col("overlap").between(64, 67)).alias("n_overlap"), n(~first & (F.col("first_token") + F.col("overlap") != F.col("end_before"))).alias("n_gaps"),
        n(ends).alias("n_ends"), n(~F.col("whole").contains(F.col("text"))).alias("n_foreign"),
    )
