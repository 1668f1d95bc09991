"""Schemas that drift between the files of a feed: one catalogue of field lifespans, a log of changes, one table.

A file's footer is its set of (field, type); files and fields are rows. A lifespan is a maximal run of files of a feed in which
a field has one type; what changes at a file is the lifespans that start there and those that ended at the file before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.functions.naming import millis_of, prefix_of
from lakemill.operators.ordered import Scan, scan

DAY_MS = 86_400_000


def parse(payload: Column) -> Column:
    """The payload as a variant if it is one whole JSON object, else null.

    A sentinel behind it in an array shows text that goes on after the object. An object that names a field twice
    counts as broken.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), payload, F.lit(',"#end"]')))
    ok = (F.try_variant_get(whole, "$[1]", "string") == "#end") & F.try_variant_get(whole, "$[2]", "string").isNull()
    body = F.try_variant_get(whole, "$[0]", "variant")
    return F.when(ok & F.schema_of_variant(body).startswith("OBJECT"), body)


def form_of(schema: Column) -> Column:
    """boolean, long, double, string or null (for JSON null) by the JSON form. Lists and objects count as string.

    A decimal of scale 0 within 18 digits was written with a point; whole numbers beyond long are double.
    """
    return (
        F.when(schema == "VOID", F.lit(None))
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "long")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "double")
        .otherwise("string")
    )


#: Bits of the forms a field's values have, and what they are together: long and double are double, any other mix is string.
_BITS = {"boolean": 1, "long": 2, "double": 4, "string": 8}


def _together(bits: Column) -> Column:
    return F.when(bits == 0, F.lit(None)).when(bits == 1, "boolean").when(bits == 2, "long").when(bits.isin(4, 6), "double").otherwise("string")


def footers(raw: DataFrame) -> DataFrame:
    """``feed, file_key, millis, field, type`` for each field of each file, from its whole payloads.

    ``type`` is null if all values are null; long and double together are double, any other mix is string. A file whose
    payloads are all broken or empty has no row here (but see ``files_in_order``). Rows without a data file's name are ignored.
    """
    x = raw.select("file_key", prefix_of(F.col("file_key")).alias("feed"), millis_of(F.col("file_key")).alias("millis"), parse(F.col("payload")).alias("v")).where("feed IS NOT NULL")
    each = x.lateralJoin(x.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("field"), F.schema_of_variant("value").alias("s")))
    form = form_of(F.col("s"))
    bit = F.coalesce(*[F.when(form == k, b) for k, b in _BITS.items()], F.lit(0))
    got = each.groupBy("feed", "file_key", "millis", "field").agg(F.bit_or(bit).alias("bits"))
    return got.select("feed", "file_key", "millis", "field", _together(F.col("bits")).alias("type"))


def files_in_order(raw: DataFrame) -> DataFrame:
    """Each file of ``raw`` (by name alone) with its number in the feed (from 0), by ``millis``, then name."""
    named = raw.select("file_key").distinct().select(prefix_of(F.col("file_key")).alias("feed"), "file_key", millis_of(F.col("file_key")).alias("millis")).where("feed IS NOT NULL")
    files = named.withColumn("one", F.lit(1).cast("long")).withColumn("day", F.floor(F.col("millis") / DAY_MS))
    x = scan(files, ["feed"], "day", ["millis", "file_key"], [Scan("file_no", "one", "sum", "before")])
    return x.select("feed", "file_key", "millis", "file_no")


def lifespans(feet: DataFrame, files: DataFrame) -> DataFrame:
    """``feed, field, type, first_file, last_file, n_files``: runs of successive files in which a field has one type.

    The lag is an equi-join on (feed, field, type, file number), so no feed is gathered, and the islands are made of the starts
    and endings only: a field that is always there costs two rows. A type of nulls only is ``unknown``.
    """
    at = feet.select("feed", "file_key", "field", F.coalesce("type", F.lit("unknown")).alias("type")).join(files.select("file_key", "file_no"), "file_key").select("feed", "field", "type", "file_no")
    here = lambda by, mine, prev, next_: F.struct((F.col("file_no") + by).alias("no"), F.lit(mine).alias("own"), F.lit(prev).alias("prev"), F.lit(next_).alias("next"))
    near = at.select("feed", "field", "type", F.explode(F.array(here(0, 1, 0, 0), here(1, 0, 1, 0), here(-1, 0, 0, 1))).alias("x"))
    flags = near.groupBy("feed", "field", "type", F.col("x.no").alias("no")).agg(F.max("x.own").alias("own"), F.max("x.prev").alias("prev"), F.max("x.next").alias("next")).where("own = 1 AND (prev = 0 OR next = 0)")
    w = Window.partitionBy("feed", "field", "type").orderBy("no")
    ends = flags.withColumn("end", F.when(F.col("next") == 0, F.col("no")).otherwise(F.lead("no").over(w))).where("prev = 0")
    return ends.select("feed", "field", "type", F.col("no").alias("first_file"), F.col("end").alias("last_file"), (F.col("end") - F.col("no") + 1).alias("n_files"))


def edges(spans: DataFrame, files: DataFrame) -> DataFrame:
    """The log of starts and endings of lifespans at each file but a feed's first: ``feed, file_key, field, old_type, new_type, was, is``.

    ``was``/``is`` say whether the file before and this one have the field. A span that starts where another of its field ends
    changes the type, which counts where both types are known.
    """
    starts = spans.where("first_file > 0").select("feed", "field", F.col("first_file").alias("file_no"), F.lit(None).cast("string").alias("old_type"), F.col("type").alias("new_type"))
    endings = spans.select("feed", "field", (F.col("last_file") + 1).alias("file_no"), F.col("type").alias("old_type"), F.lit(None).cast("string").alias("new_type"))
    both = starts.unionByName(endings).groupBy("feed", "field", "file_no").agg(F.max("old_type").alias("old_type"), F.max("new_type").alias("new_type"))
    # an ending at a feed's last file has no file after it
    both = both.join(files.select("feed", "file_no", "file_key"), ["feed", "file_no"]).withColumn("was", F.col("old_type").isNotNull().cast("int")).withColumn("is", F.col("new_type").isNotNull().cast("int"))
    return both.where("was <> is OR (old_type <> 'unknown' AND new_type <> 'unknown')").select("feed", "file_key", "field", F.nullif("old_type", F.lit("unknown")).alias("old_type"), F.nullif("new_type", F.lit("unknown")).alias("new_type"), "was", "is")


def changes(spans: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """``feed, file_key, column_name, change`` (added, dropped, renamed, retyped), ``old_name, old_type, new_type``, from ``lifespans``.

    A field that comes while one of the same canonical name leaves is ``renamed`` (both in order of name if several
    do) and neither is added or dropped. A type of nulls only is unknown and never makes ``retyped``. ``aliases``:
    ``canonical_name, column_name``, case-sensitive; a name listed twice takes its least canonical name.
    """
    known = aliases.where("column_name IS NOT NULL").groupBy("column_name").agg(F.min("canonical_name").alias("canonical"))
    e = edges(spans, files).join(known.withColumnRenamed("column_name", "field"), "field", "left").withColumn("canonical", F.coalesce("canonical", "field"))
    retyped = e.where("was = 1 AND is = 1").select("feed", "file_key", F.col("field").alias("column_name"), F.lit("retyped").alias("change"), F.lit(None).cast("string").alias("old_name"), "old_type", "new_type")
    moved = e.where("was <> is")
    by = Window.partitionBy("file_key", "canonical", "is").orderBy("field")  # at most the aliases of one field
    moved = moved.withColumn("n", F.row_number().over(by))
    pair = moved.groupBy("feed", "file_key", "canonical", "n").agg(
        F.max(F.when(F.col("is") == 1, F.col("field"))).alias("came"), F.max(F.when(F.col("was") == 1, F.col("field"))).alias("left"), F.max("old_type").alias("old_type"), F.max("new_type").alias("new_type"))
    change = F.when(F.col("came").isNotNull() & F.col("left").isNotNull(), "renamed").when(F.col("came").isNotNull(), "added").otherwise("dropped")
    paired = pair.select("feed", "file_key", F.coalesce("came", "left").alias("column_name"), change.alias("change"), F.when(change == "renamed", F.col("left")).alias("old_name"), "old_type", "new_type")
    return paired.unionByName(retyped)


#: As many columns as a table may get by an alias table.
MOST_NAMES = 10_000


def casts(feet: DataFrame, aliases: DataFrame) -> dict[str, tuple[str, list[str]]]:
    """canonical name -> (type, its column names), for the fields of ``aliases``.

    The rule becomes a column each, so more than ``MOST_NAMES`` names are an error.
    """
    known = aliases.where("column_name IS NOT NULL AND canonical_name IS NOT NULL").distinct()
    listed = known.limit(MOST_NAMES + 1).collect()
    if len(listed) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names in the alias table")
    forms = feet.join(known, feet["field"] == known["column_name"]).where("type IS NOT NULL").groupBy("canonical_name").agg(F.array_sort(F.collect_set("type")).alias("t"))
    seen = {r["canonical_name"]: r["t"] for r in forms.collect()}
    names: dict[str, list[str]] = {}
    for r in sorted(listed, key=lambda r: (r["canonical_name"], r["column_name"] != r["canonical_name"], r["column_name"])):
        names.setdefault(r["canonical_name"], []).append(r["column_name"])
    kind = lambda t: "string" if not t else t[0] if len(t) == 1 else "double" if t == ["double", "long"] else "string"
    return {c: ({"long": "bigint"}.get(k := kind(seen.get(c)), k), cols) for c, cols in names.items()}


def consistent(raw: DataFrame, rule: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """One row per record: its known fields under canonical names and types, ``other`` with the rest as JSON, ``whole``.

    A record whose payload is broken stays with nulls and ``whole`` false. Of several aliases in one record the
    canonical name comes first, then by name. Values that don't fit the type become null.
    """
    x = raw.select("record_id", "file_key", parse(F.col("payload")).alias("v"))
    known = {n for _, names in rule.values() for n in names}
    cols = []
    for canonical, (kind, names) in rule.items():
        values = [F.try_variant_get(F.col("v"), "$['" + n.replace("'", "\\'") + "']", kind) for n in names]
        cols.append((F.coalesce(*values) if len(values) > 1 else values[0]).alias(canonical))
    text = F.from_json(F.to_json(F.col("v")), "map<string,string>")
    rest = F.map_filter(text, lambda k, _: ~k.isin(*sorted(known))) if known else text
    return x.select("record_id", "file_key", F.col("v").isNotNull().alias("whole"), *cols, F.when(F.size(rest) > 0, F.to_json(rest)).alias("other"))
