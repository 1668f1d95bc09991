"""The general problems' operators against plain versions of their definitions, and on awkward input."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakemill.operators import drift, grid, incremental, late, smallfiles, spikes
from lakemill.operators.ordered import Scan, chunks, scan
from lakemill.operators.readings import event_seconds, sensor_name, usable
from lakemill.session import shared_path
from lakemill.streaming.late import LateEvents
from tests.conftest import rows

T0 = 1_704_067_200
READING = "reading_id long, batch_id long, sensor_id string, timestamp long, temperature double, humidity double, location string, received_at timestamp_ntz"


def reading(i, sensor, t, temp, hum=None, got=None, **extra):
    at = datetime(1970, 1, 1) + timedelta(seconds=(t if got is None else got))
    return (i, extra.get("batch", 1), sensor, t, temp, hum, None, at)


# -- scans along an order


def test_scan_is_like_one_sorted_pass(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.randrange(40), i, rng.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t long, i long, v long").withColumn("s", F.floor(F.col("t") / 7))
    got = scan(df, ["k"], "s", ["t", "i"], [Scan("m", "v", "max", "before"), Scan("u", "v", "max", "upto"), Scan("n", "v", "sum", "before")])
    got = scan(got, ["k"], "s", ["t"], [Scan("strict", "v", "max", "strict")])
    seen = {r["i"]: r for r in got.collect()}
    assert len(seen) == 300
    top = lambda xs: max((x for x in xs if x is not None), default=None)
    for k, t, i, v in data:
        before = [w for kk, tt, j, w in data if kk == k and (tt, j) < (t, i)]
        r = seen[i]
        assert (r["m"], r["u"]) == (top(before), top([*before, v]))
        assert r["n"] == sum(x for x in before if x is not None)
        assert r["strict"] == top([w for kk, tt, _, w in data if kk == k and tt < t])


def test_chunks_bring_exactly_their_neighbours(spark):
    df = spark.createDataFrame([("a", t // 3, t) for t in range(57)] + [("b", 1, 0)], "k string, t long, i long").withColumn("s", F.floor(F.col("t") / 4))
    got = chunks(df, ["k"], "s", ["t", "i"], 10, 4)
    by = defaultdict(list)
    for r in got.where("k = 'a'").collect():
        by[r["chunk"]].append((r["i"], r["core"]))
    assert sorted(i for c in by.values() for i, core in c if core) == list(range(57))
    for c, have in by.items():
        assert sorted(i for i, _ in have) == [i for i in range(c * 10 - 4, c * 10 + 14) if 0 <= i < 57]
    with pytest.raises(ValueError):
        chunks(df, ["k"], "s", ["t"], 3, 4)


# -- readings


def test_sensor_names_and_times(spark):
    df = spark.createDataFrame([("sensor-7", 1704067220), (" SENSOR_0007 ", 1704067220123), ("Sensor 12345", 1704067220123456), ("none", -5), (None, None), ("sensor-0000", 0)], "s string, t long")
    got = [tuple(r) for r in df.select(sensor_name("s"), event_seconds("t")).collect()]
    assert got == [("sensor-0007", 1704067220), ("sensor-0007", 1704067220), ("sensor-12345", 1704067220), (None, -5), (None, None), ("sensor-0000", 0)]


def test_usable_bounds_are_inclusive(spark):
    week = 7 * 86_400
    data = [reading(1, "s1", T0, 1.0, got=T0 + week), reading(2, "s1", T0, 1.0, got=T0 + week + 1), reading(3, "s1", T0, 1.0, got=T0 - 3600), reading(4, "s1", T0, 1.0, got=T0 - 3601), reading(5, "x", T0, 1.0)]
    assert rows(usable(spark.createDataFrame(data, READING)), "reading_id") == [(1,), (3,)]


def brute_grid(points, period=900, reach=2):
    out = {}
    half = (reach + 0.5) * period
    for s in {p[0] for p in points}:
        mine = defaultdict(list)
        for ss, t, y in points:
            if ss == s:
                mine[t].append(y)
        ts = {t: sum(y) / len(y) for t, y in mine.items()}
        for p in range(min(ts) // period, max(ts) // period + 1):
            g = p * period + period / 2
            u = np.array([(t - g) / half for t in ts if abs(t // period - p) <= reach])
            y = np.array([v for t, v in ts.items() if abs(t // period - p) <= reach])
            w = 1 - u * u
            own = sum(t // period == p for t in ts)
            support = w.sum() ** 2 / (w * w).sum() if w.sum() > 1e-9 else 0.0
            value = None
            if own or support >= 2:
                a = np.stack([np.ones_like(u), u], axis=1) * np.sqrt(w)[:, None]
                value = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][0] if len(set(u)) > 1 else y.mean()
            out[s, p * period] = (value, own, support)
    return out


def test_grid_matches_direct_regression(spark):
    rng = random.Random(5)
    points = [(f"sensor-000{s}", T0 + rng.randrange(0, 30) * 700 + rng.randrange(60), rng.gauss(20, 3)) for s in (1, 2) for _ in range(40)]
    data = [reading(i, s, t, y) for i, (s, t, y) in enumerate(points)]
    data += [reading(900, "sensor-0001", T0 + 50_000, None), reading(901, "sensor-0001", T0 + 50_000, float("nan")), reading(902, "sensor-0003", T0, 5.0), reading(903, "sensor-0003", T0, 7.0)]
    got = {(r["sensor_id"], r["period_start"]): r for r in grid.regular_grid(spark.createDataFrame(data, READING).withColumn("p", F.lit("clash"))).collect()}
    want = brute_grid([*points, ("sensor-0003", T0, 5.0), ("sensor-0003", T0, 7.0)])
    assert got.keys() == want.keys()
    for k, (value, own, support) in want.items():
        r = got[k]
        assert r["n_readings"] == own and abs(r["effective_support"] - support) < 1e-6
        assert (r["value"] is None) == (value is None) and (value is None or abs(r["value"] - value) < 1e-6)
        assert r["status"] == ("observed" if own else "missing" if value is None else "filled")
    assert got["sensor-0003", T0]["value"] == 6.0


def test_grid_of_nothing(spark):
    assert grid.regular_grid(spark.createDataFrame([], READING)).count() == 0


# -- late events


def brute_late(events, lateness=6 * 3_600_000):
    bad = []
    for e in events:
        seen = [x[4] for x in events if x[0] == e[0] and x[3] == e[3] and x[2] < e[2]]
        if seen and max(seen) - e[4] > lateness:
            bad.append((e[0], e[1]))
    return sorted(bad)


EVENT = "process_name string, file_name string, arrived_us long, file_type string, event_ms long, prefix string, bytes long"


def some_events(n=200, seed=1):
    rng = random.Random(seed)
    return [("p" if rng.random() < 0.7 else "q", f"f{i}", rng.randrange(50) * 3_600_000_000, rng.choice("xy"), rng.randrange(60) * 3_600_000 + rng.randrange(10**6), "x", i) for i in range(n)]


def test_late_matches_definition(spark):
    events = some_events()
    a = late.advance(spark.createDataFrame(events, EVENT))
    assert rows(a.diverted, "process_name", "file_name") == brute_late(events)
    assert a.accepted.count() + a.diverted.count() == len(events)
    sums = a.upserts.agg(F.sum("n_files"), F.sum("bytes")).first()
    bad = set(brute_late(events))
    assert tuple(sums) == (len(events) - len(bad), sum(e[6] for e in events if (e[0], e[1]) not in bad))
    last = late.revisions(a.accepted).groupBy("process_name", "prefix", "window_start").agg(F.max_by("n_files", "revision").alias("n"))
    assert rows(last) == rows(a.upserts.select("process_name", "prefix", "window_start", "n_files"))


def test_batches_through_state_equal_one_batch(spark):
    events = some_events(150, 2)
    df = spark.createDataFrame(events, EVENT)
    state = LateEvents(spark, shared_path(spark, "late"))
    for i in range(3):
        part = df.where(F.floor(F.col("arrived_us") / (17 * 3_600_000_000)) == i)
        state.take(part, i)
        state.take(part, i)  # a batch that is repeated does nothing
    state.take(df.limit(0), 3)
    whole = late.advance(df)
    assert rows(state.windows(), "process_name", "prefix", "window_start", "n_files", "bytes") == rows(whole.upserts, "process_name", "prefix", "window_start", "n_files", "bytes")
    assert rows(state.late(), "process_name", "file_name") == brute_late(events)


def test_a_record_that_comes_again_counts_once(spark):
    """Batches of raw records in which records of earlier batches come again, and more of them than parts are kept apart."""
    rng, d = random.Random(5), datetime(2024, 1, 1)
    data = [("p", f"a.{1_704_067_200_000 + 60_000 * i}.parquet", "a", d, d + timedelta(minutes=i + rng.randrange(5))) for i in range(200)]
    data += [(p, f, t, x, done + timedelta(minutes=rng.randrange(1, 100))) for p, f, t, x, done in data[::2]]
    raw = spark.createDataFrame(data, "process_name string, file_name string, file_type string, file_timestamp timestamp_ntz, processed_at timestamp_ntz")
    state = LateEvents(spark, shared_path(spark, "late"))
    for i in range(10):
        state.take_raw(raw.where(f"processed_at >= timestamp_ntz '2024-01-01' + interval {30 * i} minutes AND processed_at < timestamp_ntz '2024-01-01' + interval {30 * i + 30} minutes"), i)
    whole = late.advance(late.arrivals(raw))
    assert rows(state.windows(), "window_start", "n_files") == rows(whole.upserts, "window_start", "n_files")
    assert state.windows().agg(F.sum("n_files")).first()[0] == 200
    n, now = state._state()
    assert n == 9 and len(state._versions()) == 3 and max(map(len, [now["late"], *now["seen"].values()])) <= 8
    state.storage.create(f"{state.path}/versions/10.json", "{}")
    real, state._state = state._state, lambda: (n, now)
    with pytest.raises(incremental.Conflict):
        state.take_raw(raw.limit(1), 10)
    state._state = real


def test_arrivals_take_first_finish_and_skip_unfinished(spark):
    d = datetime(2024, 1, 1)
    data = [("p", "a.1000.parquet", "a", None, None), ("p", "a.2000.parquet", "a", d, d + timedelta(hours=2)), ("p", "a.2000.parquet", None, d, d), ("p", "notes.txt", "a", d, d), (None, "a.3000.parquet", "a", d, d), ("p", "x/a.4000.c.parquet", None, None, d)]
    got = late.arrivals(spark.createDataFrame(data, "process_name string, file_name string, file_type string, file_timestamp timestamp_ntz, processed_at timestamp_ntz"))
    assert rows(got, "file_name", "event_ms", "file_type", "arrived_us") == [("a.2000.parquet", 2000, "a", 1704067200000000), ("x/a.4000.c.parquet", 4000, "a", 1704067200000000)]


# -- implausible readings


def brute_spikes(v, sigma, times=7.0):
    out = set()
    for n in (1, 2, 3):
        for a in range(1, len(v) - n):
            before, after = np.median(v[max(0, a - 5) : a]), np.median(v[a + n : a + n + 5])
            g = v[a : a + n]
            if min(g) - max(before, after) > times * sigma or min(before, after) - max(g) > times * sigma:
                out |= set(range(a, a + n))
    return out


def test_flags_match_definition(spark):
    rng = np.random.default_rng(4)
    v = 20 + np.sin(np.arange(600) / 40) + rng.normal(0, 0.2, 600)
    v[100] += 15  # one
    v[200:203] -= 9  # three
    v[300:304] += 9  # four: no spike
    v[400:] += 8  # lasts
    v[500:512] = 28.25  # stuck
    v[530:541] = 28.5  # eleven: not stuck
    v[50] = 90.0
    data = [reading(i, "sensor-1", T0 + 60 * i, float(x), None if i % 2 else 50.0 + (i % 14)) for i, x in enumerate(v)]
    data += [reading(1000, "sensor-1", T0 + 505 * 60 + 1, None), reading(1001, "sensor-1", T0 + 506 * 60 + 1, float("nan"), 101.0), reading(1002, "sensor-2", T0, 20.0), reading(1003, "sensor-1", T0, 99.0, got=T0 + 10**7)]
    df = spark.createDataFrame(data, READING)
    for whole, chunk in ((100_000, 20_000), (0, 20_000), (0, 37)):  # the cut into chunks changes nothing
        got = spikes.flags(df, chunk_rows=chunk, whole_rows=whole).toPandas()
        t = got[got.metric == "temperature"]
        sigma = spikes.statistics(spikes.features(spikes.series(df))).where("metric = 'temperature' AND sensor = 'sensor-0001'").first()["scatter"]
        assert 0.15 < sigma < 0.3
        assert set(t[t.spike].reading_id) == brute_spikes(v, sigma) >= {50, 100, 200, 201, 202}
        assert set(t[t.stuck].reading_id) == set(range(500, 512))
        assert set(got[got.limit].reading_id) == {50, 1001}
        assert not {1000, 1003} & set(got[got.metric == "temperature"].reading_id)
        assert got.score.between(0, 1).all()
        assert got[got.spike | got.stuck].by.notna().all() and (t.by == "forest").mean() < 0.15
        bad = spikes.flags(df, chunk_rows=chunk, whole_rows=whole, only_bad=True)
        assert rows(bad, "reading_id", "metric", "limit", "spike", "stuck") == rows(spikes.flags(df, chunk_rows=chunk, whole_rows=whole).where("limit OR spike OR stuck"), "reading_id", "metric", "limit", "spike", "stuck")
    assert spikes.implausible(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.08, 0.2])
def test_no_spike_is_lost_beside_extreme_values(spark, share):
    rng = np.random.default_rng(5)
    n = 3000
    v = 20 + rng.normal(0, 0.2, n)
    v[np.arange(7, n, 23)] += 0.2 * rng.uniform(8, 15, len(np.arange(7, n, 23))) * rng.choice([-1, 1], len(np.arange(7, n, 23)))
    bad = rng.random(n) < share
    v[bad] = rng.choice([-9999.0, 5000.0, 850.0], bad.sum())
    df = spark.createDataFrame([reading(i, "sensor-1", T0 + 60 * i, float(x)) for i, x in enumerate(v)], READING)
    got = spikes.flags(df).where("metric = 'temperature'").toPandas()
    caught = got[got.reading_id.isin(set(got[got.spike].reading_id))]
    assert (caught.by == "forest").mean() >= 0.9  # the forest's own recall; the rule has the rest
    sigma = spikes.statistics(spikes.features(spikes.series(df))).where("metric = 'temperature'").first()["scatter"]
    want = brute_spikes(v, sigma)
    assert len(want - set(np.flatnonzero(bad))) > 40 and set(got[got.spike].reading_id) == want
    assert not got[got.reading_id.isin(want)].score.isna().any()


def test_what_the_forest_misses_goes_to_the_exact_check(spark):
    """With a threshold that no score reaches, the rule alone nominates, and no spike or stuck run is lost."""
    rng = np.random.default_rng(6)
    v = 20 + rng.normal(0, 0.2, 400)
    v[100] += 4
    v[200:203] -= 4
    v[300:312] = 20.5
    df = spark.createDataFrame([reading(i, "sensor-1", T0 + 60 * i, float(x)) for i, x in enumerate(v)], READING)
    x = spikes.local(v)
    scatter = spikes.scatter_of(x["level"])
    got = spikes.verdicts(v, x, np.zeros(400), 2.0, scatter, (-60.0, 85.0), 7.0)
    assert set(np.flatnonzero(got["spike"])) == brute_spikes(v, scatter) >= {100, 200, 201, 202} and set(np.flatnonzero(got["stuck"])) == set(range(300, 312))
    assert {x for x in got["by"] if x} == {"rule"}
    n = [spikes.flags(df, times=t).where("by = 'forest'").count() for t in (7.0, 14.0)]
    assert 0 < n[0] < 60


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 2.0, 9.0, -7.0]), max_size=40))
def test_reach_is_never_less_than_departure(v):
    v = np.array(v)
    assert (np.maximum(spikes.reach(v), 0) >= spikes.departure(v)).all()


def test_forest_isolates_what_is_far():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (500, 3)), [[12, 12, 12]]]
    model = spikes.forest(x, 32, 128, 1)
    s = spikes.score(model, x, 128)
    assert s.argmax() == 500 and s[500] > 0.55 and np.median(s) < 0.5
    same = spikes.forest(np.ones((10, 2)), 4, 128, 1)
    assert np.isfinite(spikes.score(same, np.ones((3, 2)), 10)).all()


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_forest_and_threshold_are_of_all_readings(n):
    rng = np.random.default_rng(8)
    v, t = 20 + rng.normal(0, 0.2, n), T0 + 60 * np.arange(n)
    v[n // 2] += 9
    raw = spikes.local(v)
    x = spikes.vectors(raw, t, v, spikes.usual_of(t, v), spikes.scatter_of(raw["level"]))
    model, own, threshold = spikes.train(x, 7.0, 8, 128)
    number, faults = spikes.plant(x, np.arange(n), n, 7.0)
    assert set(number % n) == set(range(n)) and set(number % spikes.SHAPES) == set(range(spikes.SHAPES))  # each reading has a fault
    grown = spikes.grown_over(x, number, faults)
    for feature, line, path in zip(*model, strict=True):
        here = {0: (np.arange(len(grown)), 0, False)}
        for node in range(len(path)):
            rows, level, below = here.pop(node)
            g = grown[rows]
            assert below or path[node] == np.float32(level + spikes._c(len(rows)))  # so many of all readings are there
            cut = feature[node] >= 0
            assert not cut or g[:, feature[node]].min() <= line[node] <= g[:, feature[node]].max()
            right = g[:, feature[node]] > line[node] if cut else np.zeros(len(rows), dtype=bool)
            if 2 * node + 2 < len(path):
                here[2 * node + 1], here[2 * node + 2] = (rows[~right], level + 1, not cut), (rows[right], level + 1, not cut)
    assert np.array_equal(own, spikes.score(model, x, len(grown)))
    assert (own >= threshold).sum() >= 0.02 * n
    planted = spikes.score(model, faults, len(grown))
    assert all((planted[number % spikes.SHAPES == k] < threshold).mean() <= 0.1 for k in range(spikes.SHAPES))


def test_scores_of_a_series_in_chunks_are_those_of_the_whole(spark):
    rng = np.random.default_rng(9)
    v = 20 + np.sin(np.arange(1500) / 40) + rng.normal(0, 0.2, 1500)
    v[700] += 9
    data = [reading(i, "sensor-1", T0 + 60 * i, float(x), None if i % 9 else 50.0 + i % 14) for i, x in enumerate(v)] + [reading(9000, "sensor-2", T0, 20.0)]
    data += [reading(9001 + i, "sensor-3", T0 + i, float(rng.choice([20.0, 21.0, float("inf"), -0.0, 1e308]))) for i in range(195)]  # a chunk of neighbours only follows
    df = spark.createDataFrame(data, READING)
    want = rows(spikes.flags(df))
    assert len(want) == 1500 + 167 + 1 + 195
    assert rows(spikes.flags(df, chunk_rows=200, whole_rows=0)) == want
    assert rows(spikes.flags(df, chunk_rows=200, whole_rows=0, few_hot=0)) == want


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.98])
def test_nth_is_exact_for_many_values(spark, share):
    rng = np.random.default_rng(10)
    values = {"a": rng.normal(0, 1, 60_000), "b": np.round(rng.normal(0, 1, 20_000), 1), "c": np.array([3.0, 1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs] + [("c", None), ("d", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["v"]) for r in spikes.nth(df, ["k"], "v", share, lambda n: F.floor(n * F.lit(share))).collect()}
    assert got == {k: (len(xs), np.sort(xs)[int(len(xs) * share)]) for k, xs in values.items()}


def test_runs_and_departures_of_short_series():
    assert spikes.run_lengths(np.array([1.0, 1, 2, 2, 2])).tolist() == [2, 2, 3, 3, 3]
    assert spikes.departure(np.array([])).tolist() == [] and spikes.departure(np.array([5.0])).tolist() == [0.0]
    assert spikes.departure(np.array([1.0, 9, 1])).tolist() == [0, 8, 0]


# -- new or changed records


def test_pending_versions_nulls_and_repeats(spark):
    src = spark.createDataFrame([("a", 2, "x"), ("a", 2, "x"), ("b", 1, "y"), (None, 1, "n"), ("c", None, "z"), ("d", 5, "w")], "k string, v long, p string")
    done = spark.createDataFrame([("a", 1, "old"), ("b", 1, "q"), (None, 1, "q"), ("c", None, "q"), ("d", None, "q")], "k string, v long, other string")
    assert rows(incremental.pending(src, done, ["k"], "v")) == [("a", 2, "x"), ("d", 5, "w")]
    assert incremental.pending(src.limit(0), done, ["k"], "v").count() == 0
    assert incremental.pending(src, done.limit(0), ["k"], "v").count() == 5


def test_runs_neither_skip_nor_repeat(spark):
    t = incremental.Target(spark, shared_path(spark, "target"), ["k"], "v")
    src = lambda *r: spark.createDataFrame(list(r), "k string, v long, p string")
    assert rows(t.run(src(("a", 1, "x"), ("b", 1, "y")))) == [("a", 1, "x"), ("b", 1, "y")]

    def dies(df):
        df.write.parquet(shared_path(spark, "partial"))
        raise OSError("lost")

    with pytest.raises(OSError):
        t.run(src(("a", 2, "x2"), ("c", 1, "z")), dies)
    assert t.current()[0] == 1
    assert rows(t.run(src(("a", 2, "x2"), ("b", 1, "y"), ("c", 1, "z")))) == [("a", 2, "x2"), ("c", 1, "z")]
    assert t.run(src(("a", 2, "x2"), ("c", 1, "z"))).count() == 0
    assert t.read().count() == 4 and t.read(1).count() == 2
    other = incremental.Target(spark, t.path, ["k"], "v")

    def first(df):
        other.run(src(("e", 1, "e")))
        return df

    with pytest.raises(incremental.Conflict):
        t.run(src(("f", 1, "f")), first)
    assert t.read().where("k = 'f'").count() == 0


SNAP = "table_name string, snapshot_id long, parent_snapshot_id long, sequence_number long, committed_at timestamp_ntz, operation string, branch string"


def test_main_line_and_unread(spark):
    s = lambda t, i, p, n, op="append", b="main": (t, i, p, n, datetime(2024, 1, 1), op, b)
    log = [s("t", 10 + i, 9 + i if i else 5, i + 1) for i in range(9)]  # parent 5 has expired
    log += [s("t", 30, 12, 11), s("t", 31, 30, 12, "replace"), s("t", 40, 31, 13, b="audit"), s("t", 32, 40, 14)]  # main set back to 12, an audit snapshot taken over
    log += [log[0], s("u", 10, 10, 1), s("w", 1, None, 1, b="audit")]
    df = spark.createDataFrame(log, SNAP)
    assert rows(incremental.main_line(df), "table_name", "snapshot_id") == [("t", 10), ("t", 11), ("t", 12), ("t", 30), ("t", 31), ("t", 32), ("t", 40), ("u", 10)]
    d = datetime(2024, 1, 1)
    state = [("p", "t", 12, d, "acked"), ("p", "t", 18, d - timedelta(days=1), "acked"), ("p", "t", 32, d + timedelta(days=1), "sent"), ("q", "t", 999, d, "acked"), ("r", "t", 11, d, None)]
    st = spark.createDataFrame(state, "process_name string, table_name string, last_snapshot_id long, recorded_at timestamp_ntz, outcome string")
    got = rows(incremental.unread_snapshots(df, st), "process_name", "snapshot_id")
    assert [x for x in got if x[0] == "p"] == [("p", 30), ("p", 32), ("p", 40)]
    assert [x[1] for x in got if x[0] == "q"] == [x[1] for x in got if x[0] == "r"] == [10, 11, 12, 30, 32, 40]
    assert incremental.main_line(df.limit(0)).count() == 0
    line = spark.createDataFrame([("v", i, i - 1 if i else None, i, None, "append", "main") for i in range(90)], df.schema)
    assert incremental.main_line(line).count() == 90


# -- small files

META = "key string, prefix string, timestamp timestamp_ntz, size long, compacted boolean, last_modified timestamp_ntz"


def test_candidates_and_plan(spark):
    d = datetime(2024, 1, 1)
    m = lambda key, size=100, c=False, at=d: (key, "wrong", None, size, c, at)
    data = [m(f"a.{1000 + i}.parquet") for i in range(6)] + [m("a.1001.parquet", 2 << 20, at=d - timedelta(1)), m("a.1002.parquet", None, at=d - timedelta(1))]
    data += [m("a.2000.c.parquet"), m("a.2001.parquet", c=True), m("a.2002.parquet"), m("a.2002.parquet.processed", 0), m("a.2003.parquet", 11), m("a.2004.parquet", 1 << 20), m("a.2005.parquet", None), m("notes.txt"), m(None)]
    data += [m(f"dir/b.{i}.parquet") for i in range(4)] + [m("a.1003.parquet", 50, at=d - timedelta(2))]
    df = spark.createDataFrame(data, META)
    c = smallfiles.candidates(df)
    assert rows(c, "key") == [(f"a.{1000 + i}.parquet",) for i in range(6)]
    p = smallfiles.plan(c, target=250).collect()
    assert len(p) == 6 and {r["output_no"]: r["output_files"] for r in p} == {0: 3, 1: 2, 2: 1}
    assert len({r["output_key"] for r in p}) == 3
    assert smallfiles.candidates(df.limit(0)).count() == 0


def test_joining_lines():
    join = lambda parts, header=False: b"".join(smallfiles.join_lines(parts, header))
    assert join([b"a\nb", b"", b"\xef\xbb\xbfc\n", b"d\r\n"]) == b"a\nb\nc\nd\r\n"
    assert join([b"h\n1\n", b"h\r\n2", b"h", b"h\n"], True) == b"h\n1\n2\n"
    with pytest.raises(smallfiles.BadFile):
        join([b"h\n1\n", b"g\n2\n"], True)
    assert join([]) == b""


@pytest.mark.parametrize("header", [False, True])
def test_sources_say_what_lines_must_be_joined(header):
    rng = random.Random(8)
    for _ in range(3000):
        top = rng.choice([b"h", b"", b"h\r"]) if header else b""
        parts = []
        for _ in range(rng.randrange(5)):
            body = b"".join(rng.choice([b"a", b"\n", b"\r", b"\r\n", b"\xef\xbb\xbf"]) for _ in range(rng.randrange(5)))
            parts.append(rng.choice([b"", b"\xef\xbb\xbf"]) + (rng.choice([b"", top, top + b"\n" + body]) if header else body))
        got = b""
        for data in parts:
            got += b"".join(smallfiles.kept(data, not got, "lines", header))
        try:
            assert got == b"".join(smallfiles.join_lines(parts, header))
        except smallfiles.BadFile:  # headers differ
            assert header


@pytest.mark.parametrize("form", ["lines", "zstd"])
def test_fault_in_a_join_is_found(spark, tmp_path, monkeypatch, form):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"a.{i}").write_bytes(zstandard.compress(b"x\n") if form == "zstd" else b"x\ny")
    plan = spark.createDataFrame([("all", i, f"a.{i}", None) for i in range(2)], "output_key string, millis long, key string, size long")
    run = lambda: smallfiles.concatenate(spark, plan, str(tmp_path / "in"), str(tmp_path / "out"), form).first()
    assert run()["error"] is None
    good, at = (tmp_path / "out" / "all").read_bytes(), (tmp_path / "out" / "all").stat()
    assert run()["error"] is None and (tmp_path / "out" / "all").stat().st_ino == at.st_ino  # left alone
    name, join = ("join_frames", smallfiles.join_frames) if form == "zstd" else ("join_lines", smallfiles.join_lines)
    monkeypatch.setattr(smallfiles, name, lambda parts, *how: list(join(parts, *how))[:-1])
    r = run()
    assert "the sources give" in r["error"] and r["bytes_out"] == 0 and r["sha256"] is None
    assert (tmp_path / "out" / "all").read_bytes() == good and len(list((tmp_path / "out").iterdir())) == 1


def test_joining_frames():
    c = zstandard.ZstdCompressor(write_checksum=True)
    parts = [c.compress(b"a" * 100_000), b"", zstandard.ZstdCompressor(write_content_size=False).compress(b"b\n"), b"\x50\x2a\x4d\x18\x03\x00\x00\x00xyz" + c.compress(b"")]
    whole = b"".join(smallfiles.join_frames(parts))
    assert zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read() == b"a" * 100_000 + b"b\n"
    for bad in (parts[0][:-1], parts[0] + b"x", b"text", parts[0][:3]):
        with pytest.raises(smallfiles.BadFile):
            list(smallfiles.join_frames([bad]))


@pytest.mark.parametrize("form", ["lines", "zstd"])
def test_concatenation_round_trip(spark, tmp_path, form):
    src, out, data = tmp_path / "in", tmp_path / "out", []
    (src / "sub").mkdir(parents=True)
    want = defaultdict(list)
    for i in range(10):
        lines = [f"{i}-{j}" for j in range(i * 3)]
        body = "\n".join(lines).encode() + (b"\n" if i % 2 and lines else b"")
        raw = zstandard.compress("".join(x + "\n" for x in lines).encode()) if form == "zstd" else body
        name = f"sub/a.{i}.x"
        (src / name).write_bytes(raw)
        data.append((f"o{i % 2}/all", i, name, len(raw) if i != 4 else None))
        want[f"o{i % 2}/all"] += lines
    data.append(("o2/all", 1, "sub/a.1.x", 999_999))
    plan = spark.createDataFrame(data, "output_key string, millis long, key string, size long")
    for _ in range(2):  # a repeated task does no harm
        report = {r["output_key"]: r for r in smallfiles.concatenate(spark, plan, str(src), str(out), form).collect()}
        for k, lines in want.items():
            raw = (out / k).read_bytes()
            assert report[k]["error"] is None and report[k]["bytes_out"] == len(raw) and report[k]["n_files"] == 5
            text = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() if form == "zstd" else raw
            assert text.decode().splitlines() == lines
        assert "listed with" in report["o2/all"]["error"] and not (out / "o2/all").exists()
    assert not [p for p in out.rglob(".*")]


def test_lines_are_written_as_they_are(spark, tmp_path):
    data = [(2, "a", "y"), (1, "a", "x"), (3, "b", ""), (4, "c", "é"), (5, "c", ""), (6, "d", None), (7, None, "z")]
    got = rows(smallfiles.write_lines(spark.createDataFrame(data, "record_id long, file_key string, payload string"), str(tmp_path / "w")))
    assert got == [("a", 3, 2), ("b", 1, 1), ("c", 4, 2)]
    assert [(tmp_path / "w" / k).read_bytes() for k in "abc"] == [b"x\ny", b"\n", "é\n\n".encode()]


# -- drifting schemas


def test_changes_between_files(spark):
    f = lambda n: f"feed.{n}.parquet"
    data = [
        (1, f(1000), '{"a": 1, "b": "x", "t": 1, "n": null}'), (2, f(1000), '{"a": 2.5}'), (3, f(1000), '{"zz": 1}}'), (4, f(1000), '#{"zz": 1}'), (5, f(1000), ""), (6, f(1000), None), (7, f(1000), '[{"zz": 1}]'), (8, f(1000), '{"zz": 1} x'), (9, f(1000), '{"zz": 1'),
        (10, f(2000), '{"a": 93.0, "bee": true, "t": "s", "n": 5}'),
        (11, f(10000), '{"a": null, "bee": 1, "t": 3}'), (12, f(10000), '{"t": "x"}'),
        (13, "other.5.parquet", '{"q": 1}'), (14, "not a name", '{"q": 1}'), (15, f(20000), "broken"), (16, f(30000), '{"a": 1}'),
    ]
    raw = spark.createDataFrame(data, "record_id long, file_key string, payload string")
    alias = spark.createDataFrame([("b", "b"), ("b", "bee"), ("B", "BEE")], "canonical_name string, column_name string")
    feet, files = drift.footers(raw), drift.files_in_order(raw)
    got = rows(drift.changes(drift.lifespans(feet, files), files, alias), "file_key", "column_name", "change")
    assert got == sorted([
        (f(2000), "bee", "renamed"), (f(2000), "t", "retyped"), (f(10000), "bee", "retyped"), (f(10000), "n", "dropped"),
        (f(20000), "a", "dropped"), (f(20000), "bee", "dropped"), (f(20000), "t", "dropped"), (f(30000), "a", "added"),
    ], key=repr)
    types = {(r["file_key"], r["field"]): r["type"] for r in feet.collect()}
    assert types[f(1000), "a"] == "double" and types[f(2000), "a"] == "double" and types[f(1000), "n"] is None and types[f(10000), "t"] == "string"
    lives = rows(drift.lifespans(feet, files).where("feed = 'feed' AND field = 'a'"), "type", "first_file", "last_file")
    assert lives == [("double", 0, 1), ("long", 4, 4), ("unknown", 2, 2)]
    rule = drift.casts(feet, alias)
    assert rule["b"] == ("string", ["b", "bee"])
    whole = {r["record_id"]: r for r in drift.consistent(raw, rule).collect()}
    assert len(whole) == 16 and whole[1]["b"] == "x" and whole[10]["b"] == "true" and not whole[3]["whole"] and whole[6]["b"] is None
    assert whole[16]["other"] == '{"a":"1"}'
    none = drift.files_in_order(raw.limit(0))
    assert drift.changes(drift.lifespans(drift.footers(raw.limit(0)), none), none, alias).count() == 0


def test_types_by_json_form(spark):
    cases = {"1": "long", "-7": "long", "1.0": "double", "1e3": "double", "12345678901234567890": "double", "true": "boolean", '"1"': "string", "null": None, "[1]": "string", '{"x": 1}': "string"}
    data = [(i, f"a.{i}.parquet", f'{{"f": {v}}}') for i, v in enumerate(cases)]
    got = {r["millis"]: r["type"] for r in drift.footers(spark.createDataFrame(data, "record_id long, file_key string, payload string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
