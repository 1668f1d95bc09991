"""De-duplicating new batches against all history by immutable suffix arrays, merged logarithmically.

Records are texts laid end to end; a segment is such a text and its suffix array. The substrings of a new batch are looked
up by binary search in the segments before it: long matches cover parts of a record, and a record covered enough by one
accepted record repeats it. Segments are never changed; two of a level merge into one of the next, so a batch meets about
log2 of the number of batches.

A reading is the text ``a<sensor>:<second // 2>;b<sensor>:<(second + 1) // 2>;``. Two readings of a sensor share the first
word, the second or both just if they lie at most one second apart, so the coverage of a record by another is nothing, about
half or whole, and half is enough. Suffixes begin at words, as substrings do (a sparse suffix array); ``coverage`` takes any
texts and begins at every byte. An exact check decides in order of ``reading_id`` which of the covered are rejected.

The index (``History``) is a folder. A day of event time is some buckets of sensors' hours; a take reads and adds to the days
its own readings fall into, whatever the length of the history, and the parts of a day merge by level.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.operators.ordered import Scan, scan
from lakemill.operators.readings import DAY, usable
from lakemill.session import shared_path, stored

HOUR = 3600
#: A record covered to this share by one other repeats it; one word of two may be a little shorter than the other.
COVERED = 0.4


def _views(text: bytes, depth: int) -> np.ndarray:
    """The ``depth`` bytes from each byte of a text on, zeros after its end."""
    raw = np.frombuffer(text + b"\0" * depth, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(raw, (len(text), depth), (1, 1))


def _keys(text: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    return np.ascontiguousarray(_views(text, depth)[at]).view(f"S{depth}").ravel() if len(at) else np.zeros(0, dtype=f"S{depth}")


@dataclass(frozen=True)
class Segment:
    """Records' text end to end, where each begins, whose it is and its time, and the suffixes in order by their first ``depth`` bytes."""

    text: bytes
    starts: np.ndarray
    owners: np.ndarray
    times: np.ndarray
    order: np.ndarray
    keys: np.ndarray
    level: int = 0

    @classmethod
    def build(cls, texts: list[bytes], owners: np.ndarray, depth: int, times: np.ndarray | None = None, points: np.ndarray | None = None) -> Segment:
        """Suffixes begin at ``points`` of the whole text (every byte by default); of equal ones (to ``depth``) the earlier comes first."""
        text = b"".join(texts)
        starts = np.r_[0, np.cumsum([len(t) for t in texts])[:-1]].astype(np.int64) if texts else np.zeros(0, dtype=np.int64)
        return cls.of(text, starts, np.asarray(owners), np.zeros(len(starts), dtype=np.int64) if times is None else times, np.arange(len(text)) if points is None else points, depth)

    @classmethod
    def of(cls, text: bytes, starts: np.ndarray, owners: np.ndarray, times: np.ndarray, points: np.ndarray, depth: int) -> Segment:
        k = _keys(text, points, depth)
        by = np.argsort(k, kind="stable")
        return cls(text, starts, owners, times, points[by], k[by])

    @property
    def depth(self) -> int:
        return self.keys.dtype.itemsize

    def merge(self, other: Segment) -> Segment:
        """One segment of both, one level up; both orders are runs already, so this is a merge, not a sort."""
        a, b = self, other
        depth = max(a.depth, b.depth)  # keys of the shallower are read again from its text, deep enough
        order, keys = np.r_[a.order, b.order + len(a.text)], np.r_[a.to(depth), b.to(depth)]
        by = np.argsort(keys, kind="stable")
        return Segment(a.text + b.text, np.r_[a.starts, b.starts + len(a.text)], np.r_[a.owners, b.owners], np.r_[a.times, b.times], order[by], keys[by], max(a.level, b.level) + 1)

    def to(self, depth: int) -> np.ndarray:
        return self.keys if depth == self.depth else _keys(self.text, self.order, depth)

    def find(self, needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each needle (of a longer one: with its first ``depth`` bytes)."""
        if not len(self.keys):
            zero = np.zeros(len(needles), dtype=np.int64)
            return zero, zero
        depth = self.depth
        cut = needles.astype(f"S{depth}")
        size = np.char.str_len(cut)
        padded = np.full((len(needles), depth), 0xFF, dtype=np.uint8)
        inside = np.arange(depth) < size[:, None]
        padded[inside] = cut.view(np.uint8).reshape(len(needles), depth)[inside]
        return np.searchsorted(self.keys, cut, "left"), np.searchsorted(self.keys, padded.view(f"S{depth}").ravel(), "right")

    def occurrences(self, needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(needle, place) of all suffixes that begin with a needle; what goes beyond the depth is compared in the text."""
        low, high = self.find(needles)
        n = high - low
        which = np.repeat(np.arange(len(needles)), n)
        at = self.order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(self.order) else np.zeros(0, dtype=np.int64)
        far = np.flatnonzero(np.char.str_len(needles)[which] > self.depth)
        if len(far):
            whole = np.ones(len(which), dtype=bool)
            whole[far] = [self.text.startswith(bytes(needles[which[i]]), at[i]) for i in far.tolist()]
            which, at = which[whole], at[whole]
        return which, at

    def covering(self, words: np.ndarray, row: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, record, share): how much of each row the words it shares with one record of this segment cover.

        ``words`` belong to ``row``, of whose ``total`` bytes they are parts that don't overlap.
        """
        which, at = self.occurrences(words)
        record = np.searchsorted(self.starts, at, "right") - 1
        pair, back = np.unique(row[which] * max(1, len(self.starts)) + record, return_inverse=True)
        covered = np.bincount(back, weights=np.char.str_len(words)[which], minlength=len(pair))
        r = pair // max(1, len(self.starts))
        return r, pair % max(1, len(self.starts)), covered / total[r]


def coverage(texts: list[bytes], segments: list[Segment], match: int) -> np.ndarray:
    """The share of each text that substrings of ``match`` bytes found in any segment cover; 0 for shorter texts."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if len(text) < match:
            continue
        w = _keys(text, np.arange(len(text) - match + 1), match)
        hit = np.zeros(len(w), dtype=bool)
        for s in segments:
            which, _ = s.occurrences(w)
            hit[which] = True
        step = np.zeros(len(text) + 1, dtype=np.int64)
        at = np.flatnonzero(hit)
        np.add.at(step, at, 1)
        np.add.at(step, at + match, -1)
        out[i] = np.count_nonzero(np.cumsum(step[:-1])) / len(text)
    return out


class Levels:
    """Segments, at most one per level, as in a log-structured merge."""

    def __init__(self, segments: list[Segment] | None = None) -> None:
        self.segments = segments or []

    def add(self, segment: Segment) -> None:
        self.segments.append(segment)
        while len(self.segments) > 1 and self.segments[-1].level >= self.segments[-2].level:
            new = self.segments.pop()
            self.segments[-1] = self.segments[-1].merge(new)


# -- readings as records


@dataclass(frozen=True)
class Records:
    """The two words of each reading."""

    a: np.ndarray
    b: np.ndarray
    second: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, sensor: pd.Series, second: np.ndarray, ids: np.ndarray) -> Records:
        number = np.char.add(sensor.str.slice(7).to_numpy().astype("S"), b":") if len(second) else np.zeros(0, dtype="S1")
        word = lambda mark, n: np.char.add(np.char.add(np.char.add(mark, number), n.astype("S")), b";")
        return cls(word(b"a", second // 2), word(b"b", (second + 1) // 2), second, ids)

    def take(self, at: np.ndarray) -> Records:
        return Records(self.a[at], self.b[at], self.second[at], self.ids[at])

    def segment(self) -> Segment:
        """The suffix array of these records' text, whose suffixes begin at words."""
        whole = np.char.add(self.a, self.b)
        raw = whole.view(np.uint8)
        text = raw[raw != 0].tobytes()
        starts = np.r_[0, np.cumsum(np.char.str_len(whole))[:-1]].astype(np.int64) if len(whole) else np.zeros(0, dtype=np.int64)
        depth = max(self.a.dtype.itemsize, self.b.dtype.itemsize, 1)
        return Segment.of(text, starts, self.ids, self.second, np.r_[starts, starts + np.char.str_len(self.a)], depth)

    def covered_by(self, segment: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, second) of the other readings that cover a row enough."""
        n = len(self.ids)
        width = max(self.a.dtype.itemsize, self.b.dtype.itemsize)
        words, row = np.r_[self.a.astype(f"S{width}"), self.b.astype(f"S{width}")], np.r_[np.arange(n), np.arange(n)]
        r, record, share = segment.covering(words, row, np.char.str_len(self.a) + np.char.str_len(self.b))
        enough = share >= COVERED
        r, owner, second = r[enough], segment.owners[record[enough]], segment.times[record[enough]]
        other = owner != self.ids[r]
        return r[other], owner[other], second[other]


MATCHES = "sensor string, event_time long, reading_id long, other_time long, other_id long, old boolean"


def _matches(pdf: pd.DataFrame, old: list[Segment]) -> pd.DataFrame:
    """Takes the batches of one bucket in order through ``old`` segments and those of the batches before each."""
    names = [c.split()[0] for c in MATCHES.split(", ")]
    if not len(pdf):
        return pd.DataFrame(columns=names)
    pdf = pdf.sort_values(["batch_id", "reading_id"], kind="stable")
    all_ = Records.of(pdf["sensor"], pdf["event_time"].to_numpy(), pdf["reading_id"].to_numpy())
    core, batch, sensor = pdf["core"].to_numpy(dtype=bool), pdf["batch_id"].to_numpy(), pdf["sensor"].to_numpy()
    cuts = np.r_[0, np.flatnonzero(batch[1:] != batch[:-1]) + 1, len(batch)]
    levels, out = Levels(), []

    def note(mine: Records, first: int, segment: Segment, is_old: bool) -> np.ndarray:
        r, owner, second = mine.covered_by(segment)
        near = np.abs(second - mine.second[r]) <= 1  # the exact check of what is covered
        r, owner, second = r[near], owner[near], second[near]
        if len(r):
            out.append(pd.DataFrame({"sensor": sensor[first + r], "event_time": mine.second[r], "reading_id": mine.ids[r], "other_time": second, "other_id": owner, "old": is_old}))
        return r[(second == mine.second[r]) & (owner < mine.ids[r])]

    for s in old:
        note(all_, 0, s, True)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mine = all_.take(np.arange(a, b))
        adds = core[a:b].copy()
        for s in levels.segments:
            adds[note(mine, a, s, False)] = False  # a later reading at a second that is there decides nothing for others
        own = mine.take(np.flatnonzero(adds)).segment()
        note(mine, a, own, False)
        levels.add(own)
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)


def decide(found: DataFrame) -> DataFrame:
    """``sensor, event_time, first_id, kept_id`` of each second at which the matches leave something to decide.

    Exact, without going through readings one by one. Of the readings at one second only that of least id (``first_id``) can
    be accepted. It waits for the second before if that has a smaller least id, and likewise for the second after. Along a
    run of seconds that each wait for the one before, acceptance alternates from the run's origin; a second is accepted if it
    is an even number of steps from the origin on both sides. ``kept_id`` is the least accepted reading that rejects
    ``first_id``, or null if that is accepted.
    """
    delta = F.col("other_time") - F.col("event_time")
    per = found.groupBy("sensor", "event_time", "reading_id").agg(*[F.min(F.when(delta == d, F.col("other_id"))).alias(n) for d, n in ((-1, "before"), (0, "same"), (1, "after"))])
    per = stored(per, "matches")
    first = per.where("same IS NULL")

    def steps(side: str, sign: int) -> DataFrame:
        x = first.where(f"{side} IS NOT NULL").select("sensor", (F.col("event_time") * sign).alias("t")).withColumn("slice", F.floor(F.col("t") / 3600))
        x = scan(x, ["sensor"], "slice", ["t"], [Scan("last", "t", "max", "before")])
        x = x.withColumn("origin", F.when(F.col("last").isNull() | (F.col("last") != F.col("t") - 1), F.col("t")))
        x = scan(x, ["sensor"], "slice", ["t"], [Scan("from", "origin", "max", "upto")])
        return x.select("sensor", (F.col("t") * sign).alias("event_time"), (F.col("t") - F.col("from") + 1).alias(f"{side}_steps"))

    x = first.join(steps("before", 1), ["sensor", "event_time"], "left").join(steps("after", -1), ["sensor", "event_time"], "left").na.fill(0, ["before_steps", "after_steps"])
    odd = lambda c: F.col(f"{c}_steps") % 2 == 1
    kept = F.least(F.when(odd("before"), F.col("before")), F.when(odd("after"), F.col("after")))
    return x.select("sensor", "event_time", F.col("reading_id").alias("first_id"), kept.alias("kept_id"))


SEGMENT = "day long, bucket long, depth int, text binary, starts binary, owners binary, times binary, suffixes binary"


class History:
    """The index of accepted readings in a folder, grown by takes of one or more batches.

    ``parts/P/day=D`` holds rows of (bucket, segment) that are never changed; ``manifest/N.json`` names the parts of each day that
    make up version N and is created atomically, so a take that fails leaves the index as it was. The buckets of a day are
    fixed when it is first seen: about ``shard_rows`` records each if the day gets ``headroom`` times what came first. A row
    holds at most ``segment_rows`` records.
    """

    def __init__(self, spark: SparkSession, path: str, shard_rows: int = 50_000, headroom: int = 2, segment_rows: int = 1_000_000) -> None:
        from lakemill.sources.storage import Storage

        self.spark, self.path, self.shard_rows, self.headroom, self.segment_rows, self.storage = spark, path, shard_rows, headroom, segment_rows, Storage(spark)

    def version(self) -> tuple[int, dict]:
        names = [int(n[:-5]) for n in self.storage.names(f"{self.path}/manifest") if n.endswith(".json")]
        n = max(names, default=0)
        return n, json.loads(self.storage.read(f"{self.path}/manifest/{n}.json")) if n else {"days": {}, "buckets": {}}

    def segments(self, days: list[int] | None = None) -> DataFrame | None:
        """The stored segments, of some days only; None if there are none. No other folder is read."""
        m = self.version()[1]["days"]
        paths = [p for d, parts in m.items() if days is None or int(d) in days for _, p in parts]
        return self.spark.read.schema(SEGMENT).parquet(*[f"{self.path}/parts/{p}" for p in paths]) if paths else None

    def report(self) -> DataFrame:
        """``day, segments, records, bytes`` of the index: what a take of that day's readings reads."""
        s = self.segments()
        s = self.spark.createDataFrame([], SEGMENT) if s is None else s
        size = sum((F.length(c) for c in ("text", "starts", "owners", "times", "suffixes")), F.lit(0))
        return s.groupBy("day").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("owners") / 8).cast("long").alias("records"), F.sum(size).cast("long").alias("bytes"))

    @staticmethod
    def _cells(x: DataFrame, n_buckets: DataFrame, edges: bool) -> DataFrame:
        """Rows with the bucket of their hour, and with ``edges`` (``core`` false) of the hour that their neighbouring second lies in."""
        hour, at = F.floor(F.col("event_time") / HOUR), F.pmod(F.col("event_time"), F.lit(HOUR))
        cell = lambda h, core: F.struct(h.alias("hour"), F.lit(core).alias("core"))
        into = F.array(cell(hour, True))
        if edges:
            into = F.array_compact(F.concat(into, F.array(F.when(at == 0, cell(hour - 1, False)), F.when(at == HOUR - 1, cell(hour + 1, False)))))
        x = x.select("*", F.explode(into).alias("x")).select(*x.columns, F.col("x.hour").alias("hour"), F.col("x.core").alias("core")).withColumn("day", F.floor(F.col("hour") / 24))
        return x.join(n_buckets, "day").withColumn("bucket", F.pmod(F.xxhash64("sensor", "hour"), "buckets")).drop("buckets", "hour")

    def take(self, readings: DataFrame) -> DataFrame:
        """Checks one or more batches against the index and each other, and adds what is accepted as the next version.

        Returns ``reading_id, sensor, event_time, batch_id, kept_id`` of every usable reading; ``kept_id`` is null if it is accepted.
        Readings are taken in order of ``reading_id``: one is rejected if an accepted reading of its sensor lies at most 1 second
        away. If accepted ones lie on both sides, ``kept_id`` is the smaller. Takes must come in order of ``reading_id``. A null batch
        is batch 0; a null ``reading_id`` can't be ordered and such rows are left out; rows that repeat an id are one reading. No
        readings, no rows and no new version.
        """
        x = usable(readings).where("reading_id IS NOT NULL").select("sensor", "event_time", "reading_id", F.coalesce("batch_id", F.lit(0)).cast("long").alias("batch_id"))
        # a batch is first de-duplicated in itself
        batches = stored(x.groupBy("sensor", "event_time", "batch_id").agg(F.min("reading_id").alias("reading_id"), F.count(F.lit(1)).alias("n")), "batches")
        n, m = self.version()
        at = F.pmod(F.col("event_time"), F.lit(DAY))
        days = F.explode(F.array_compact(F.array(F.floor(F.col("event_time") / DAY), F.when(at == 0, F.floor(F.col("event_time") / DAY) - 1), F.when(at == DAY - 1, F.floor(F.col("event_time") / DAY) + 1))))
        touched = {int(r["day"]): r["n"] for r in batches.select(days.alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as days
        if not touched:
            return x.select("reading_id", "sensor", "event_time", "batch_id", F.lit(None).cast("long").alias("kept_id"))
        grown = {str(d): 2 ** max(0, math.ceil(math.log2(k * self.headroom / self.shard_rows))) for d, k in touched.items()} | m["buckets"]
        n_buckets = F.broadcast(self.spark.createDataFrame([(d, grown[str(d)]) for d in touched], "day long, buckets long"))
        cells = self._cells(batches.drop("n"), n_buckets, True)
        old = self.segments(list(touched))
        if old is None:
            found = cells.groupBy("day", "bucket").applyInPandas(lambda pdf: _matches(pdf, []), MATCHES)
        else:
            found = cells.groupBy("day", "bucket").cogroup(old.groupBy("day", "bucket")).applyInPandas(lambda new, have: _matches(new, [_load(r) for r in have.itertuples()] if len(new) else []), MATCHES)
        found = stored(found, "matches")
        seconds = batches.groupBy("sensor", "event_time").agg(F.min("reading_id").alias("first_id"), F.sum("n").alias("n"))
        if old is not None:
            before = found.where("old").groupBy("sensor", "event_time").agg(F.min("other_id").alias("old_id"))
            inside = found.where("NOT old").join(before, ["sensor", "event_time"], "left_anti")
            inside = inside.join(before.select("sensor", F.col("event_time").alias("other_time")), ["sensor", "other_time"], "left_anti")
        else:
            before, inside = None, found
        # the reading of the larger id is the one that may repeat the other
        swap = F.col("other_id") > F.col("reading_id")
        inside = inside.select(
            "sensor", F.when(swap, F.col("other_time")).otherwise(F.col("event_time")).alias("event_time"), F.greatest("reading_id", "other_id").alias("reading_id"),
            F.when(swap, F.col("event_time")).otherwise(F.col("other_time")).alias("other_time"), F.least("reading_id", "other_id").alias("other_id"),
        )
        status = seconds.join(decide(inside).select("sensor", "event_time", "kept_id"), ["sensor", "event_time"], "left")
        if before is not None:
            status = status.join(before, ["sensor", "event_time"], "left").withColumn("kept_id", F.coalesce("old_id", "kept_id")).drop("old_id")
        status = stored(status, "status")
        self._add(status.where("kept_id IS NULL").select("sensor", "event_time", F.col("first_id").alias("reading_id")), n, m, grown, n_buckets)
        kept = F.when(F.col("reading_id") == F.col("first_id"), F.col("kept_id")).otherwise(F.coalesce("kept_id", "first_id"))
        # a second of one reading that is accepted has nothing to tell
        return x.join(status.where("n > 1 OR kept_id IS NOT NULL"), ["sensor", "event_time"], "left").select("reading_id", "sensor", "event_time", "batch_id", kept.alias("kept_id"))

    def _add(self, accepted: DataFrame, n: int, m: dict, buckets: dict, n_buckets: DataFrame) -> None:
        """A new part of accepted readings, with the last parts of each day that are of its level merged into it."""
        new = stored(self._cells(accepted, n_buckets, False), "accepted")
        into = [str(r["day"]) for r in new.select("day").distinct().collect()]
        days, absorbed, level = dict(m["days"]), [], {}
        for d in into:
            kept, k = list(days.get(d, [])), 0
            while kept and kept[-1][0] <= k:
                absorbed.append(kept.pop()[1])
                k += 1
            days[d], level[d] = kept, k
        part, most = f"{n + 1}-{self.storage.unique()}", self.segment_rows

        def build(pdf: pd.DataFrame, have: list[Segment]) -> pd.DataFrame:
            pdf = pdf.sort_values(["reading_id"], kind="stable")
            mine = Records.of(pdf["sensor"], pdf["event_time"].to_numpy(), pdf["reading_id"].to_numpy())
            out = [mine.take(np.arange(a, min(a + most, len(pdf)))).segment() for a in range(0, len(pdf), most)]
            for s in have:
                i = next((i for i, o in enumerate(out) if len(o.starts) + len(s.starts) <= most), None)
                out = [*out, s] if i is None else [*out[:i], s.merge(out[i]), *out[i + 1 :]]
            return pd.DataFrame([_store(s) for s in out], columns=[c.split()[0] for c in SEGMENT.split(", ")][2:])

        def keyed(key: tuple, pdf: pd.DataFrame, have: pd.DataFrame | None = None) -> pd.DataFrame:
            rows = build(pdf, [] if have is None else [_load(r) for r in have.itertuples()])
            rows.insert(0, "bucket", key[1])
            rows.insert(0, "day", key[0])
            return rows

        if absorbed:
            old = self.spark.read.schema(SEGMENT).parquet(*[f"{self.path}/parts/{p}" for p in absorbed])
            rows = new.groupBy("day", "bucket").cogroup(old.groupBy("day", "bucket")).applyInPandas(lambda key, a, b: keyed(key, a, b), SEGMENT)
        else:
            rows = new.groupBy("day", "bucket").applyInPandas(lambda key, a: keyed(key, a), SEGMENT)
        if into:
            rows.withColumn("of_day", F.col("day")).write.partitionBy("of_day").parquet(f"{self.path}/parts/{part}")
        days |= {d: [*days[d], [level[d], f"{part}/of_day={d}"]] for d in into}
        if not self.storage.create(f"{self.path}/manifest/{n + 1}.json", json.dumps({"days": days, "buckets": buckets})):
            raise RuntimeError("another batch was accepted first")


def _store(s: Segment) -> dict:
    as_bytes = lambda x: x.astype(np.int64).tobytes()
    return {"depth": s.depth, "text": s.text, "starts": as_bytes(s.starts), "owners": as_bytes(s.owners), "times": as_bytes(s.times), "suffixes": as_bytes(s.order)}


def _load(row: object) -> Segment:
    text, (starts, owners, times, order) = bytes(row.text), (np.frombuffer(x, np.int64) for x in (row.starts, row.owners, row.times, row.suffixes))
    return Segment(text, starts, owners, times, order, _keys(text, order, int(row.depth)))


def judge(readings: DataFrame, shard_rows: int = 50_000) -> DataFrame:
    """All batches in one take through an index of their own (see ``History.take``)."""
    spark = readings.sparkSession
    return History(spark, shared_path(spark, "history"), shard_rows).take(readings)
