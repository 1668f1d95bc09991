"""Sizes in tokens, packing, mixing, splitting and batch de-duplication against plain versions and on awkward input."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakemill.llm import mix, pack, split, suffix
from lakemill.llm.tokens import hashes_of, tokens
from lakemill.session import shared_path
from tests.conftest import rows

DOC = "doc_id long, source string, text string, tokens string"


def docs(spark, data):
    return spark.createDataFrame([(i, s, t, "an extra column") for i, s, t in data], DOC)


# -- sizes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abS'strelvdm 12.,\n\t\r-_é\xa0\x85\x1cñ漢😀"), max_size=30), max_size=5))
def test_counts_equal_the_library(texts):
    t = tokens()
    assert t.count([*texts, None]).tolist() == [*map(t.count_one, texts), 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_counts_of_any_text(texts):
    t = tokens()
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    assert t.count(texts).tolist() == [t.count_one(x) for x in texts]


def test_counts_across_spans():
    t, one = tokens(), "def f(x):\n    return x + 1  # don't\n" * 40_000
    assert t.count([one, "a", one]).tolist() == [t.count_one(one), 1, t.count_one(one)]


def test_a_piece_has_one_hash_in_any_text():
    """Characters beyond the table of classes don't change what the other pieces are known by."""
    t, plain = tokens(), "def compute(value):\n    return value + 12345678901  # it's done"
    got = []
    for text in (plain, plain + " 漢字 😀", "ñandú " + plain):
        words: list = []
        t.count([text], words)
        got.append({int(h) for _, hs in words for h in hs})
    assert len(got[0]) > 10 and len(got[0] - got[1]) <= 1 and len(got[0] - got[2]) <= 1  # what touches the seam may differ


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abS'strelvdm 12.,\n\t-_é\xa0ñ"), max_size=60))
def test_hashes_one_at_a_time_are_those_of_arrays(text):
    t, words = tokens(), []
    t.count([text], words)
    alone = hashes_of([x.encode() for x in t.pattern.findall(text)]).tolist() if text else []
    assert sorted(int(h) for _, hs in words for h in hs) == sorted(alone)


# -- packing


def test_hilbert_neighbours_touch():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = pack.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    along = cells[np.argsort(key)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=200), st.integers(1, 40), st.integers(1, 10))
def test_fill_never_overfills(sizes, block, most):
    where, n = pack.fill(sizes, 100, block, most)
    load, places = Counter(), defaultdict(list)
    for i, (s, c) in enumerate(zip(sizes, where, strict=True)):
        load[c] += s
        places[c].append(i)
    assert all(max(p) - min(p) < most + block for p in places.values())
    assert all(v <= 100 for v in load.values()) and set(where) == set(range(n))


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "tok"]) for _ in range(n))


def test_pack_keeps_everything(spark):
    rng = random.Random(1)
    data = [(i, None, words(rng.randrange(1, 90), i)) for i in range(300)] + [(1000, None, None), (1001, None, ""), (1002, None, words(250)), (1003, None, words(5)), (1003, None, words(5)), (None, None, "x")]
    data += [(2000 + i, None, "the same text again") for i in range(100)]
    got = pack.pack(docs(spark, data), capacity=100, range_rows=60).toPandas()
    t, want = tokens(), Counter()
    for i, _, x in data:
        want[-1 if i is None else i] += t.count_one(x) if x else 0
    assert got.fillna(-1).groupby("doc_id").tokens.sum().to_dict() == dict(want)
    load = got.groupby("container_id").tokens.sum()
    assert load.max() <= 100 and len(load) <= 1.1 * -(-load.sum() // 100) + 7  # seven ranges
    many = got[got.n_pieces > 1]
    assert set(many.doc_id) == {i for i, n in want.items() if n > 100}
    for _, g in many.groupby("doc_id"):
        assert g.sort_values("piece_no").start_token.tolist() == [100 * k for k in range(len(g))]
    assert len(got) - len(many) == len(data) - len(set(many.doc_id))
    assert pack.pack(docs(spark, data[:0])).count() == 0
    assert rows(pack.broken(pack.pack(docs(spark, data), capacity=100, range_rows=60), docs(spark, data), 100)) == [(len(data), len(data), 0, 0, 0, 0)]


def test_a_container_holds_neighbours_of_the_curve(spark):
    """Three kinds of texts, dealt in turn: items of a container lie close along the curve, and most of them are of one kind."""
    kinds = [["alpha", "beta", "gamma"], ["SELECT", "FROM", "WHERE"], ["漢字", "かな", "カナ"]]
    rng = random.Random(3)
    data = [(i, str(i % 3), " ".join(rng.choice(kinds[i % 3]) for _ in range(30))) for i in range(900)]
    got = pack.pack(docs(spark, data), capacity=600).toPandas()
    got["kind"] = got.doc_id % 3
    g = got.groupby("container_id")
    assert (g.place.max() - g.place.min()).max() < 128 and g.kind.agg(lambda k: k.value_counts(normalize=True).max()).mean() > 0.8


# -- mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(1, 20))
def test_splitting_tree_is_exact(blocks, shards):
    got = mix.splitting_tree(np.array(blocks), shards)
    assert got.shape == (shards, len(blocks)) and (got >= 0).all()
    assert got.sum(axis=0).tolist() == blocks
    for stop in (2, 5):  # a subtree grown on its own is the same
        below = [n for a, b, have in mix.split_nodes(np.array(blocks), 0, shards, 7, stop) for *_, n in mix.split_nodes(have, a, b, 7)]
        assert np.array(below).tolist() == got.tolist()
    per = got.sum(axis=1)
    assert per.max() - per.min() <= shards.bit_length() + 1


def test_mixture(spark):
    data = [(i, "big", words(20, i)) for i in range(300)] + [(1000 + i, "small", words(10, i)) for i in range(10)] + [(2000 + i, "mid", words(30, i)) for i in range(40)]
    data += [(3000, "unlisted", words(500)), (3001, None, words(10)), (3002, "big", None), (3003, "mid", ""), (3004, "big", words(400))]
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.5, 3), ("mid", 0.15, 2), ("absent", 0.05, 4), (None, 0.0, 1)], "source string, weight double, max_repeats int")
    d = docs(spark, data)
    out, plan = mix.mix(d, targets, block_tokens=200, shard_tokens=500)
    out = out.toPandas()
    t = tokens()
    size = {i: t.count_one(x) if x else 0 for i, _, x in data}
    have = {s: sum(size[i] for i, ss, _ in data if ss == s) for s in ("big", "small", "mid")}
    total = sum(have.values())
    by = {q.source: q for q in plan}
    assert by["small"].short and by["absent"].short and not by["big"].short and not by["mid"].short
    used = out.groupby("source").tokens.sum()
    assert used["small"] == 3 * have["small"]
    for s, w in (("big", 0.3), ("mid", 0.15)):
        assert 0 <= w * total - used[s] < 60
    times = out.groupby(["source", "doc_id"]).size()
    assert all(n <= {"big": 1, "small": 3, "mid": 2}[s] for (s, _), n in times.items())
    assert set(out.source) == {"big", "small", "mid"} and not out.duplicated(["source", "doc_id", "repeat"]).any()
    for _, g in out.groupby("shard"):
        assert sorted(g.position) == list(range(len(g)))
    again = mix.mix(d, targets, block_tokens=200, shard_tokens=500)[0].toPandas()
    order = ["shard", "position"]
    assert out.sort_values(order).values.tolist() == again.sort_values(order).values.tolist()
    report = {r["source"]: r for r in mix.shares(*mix.mix(d, targets, block_tokens=200, shard_tokens=500)).collect()}
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9 and report["absent"]["used_tokens"] == 0 and report["absent"]["short"]
    empty, plan = mix.mix(docs(spark, []), targets)
    assert empty.count() == 0 and not any(q.short for q in plan)
    assert mix.shares(empty, plan).count() == 4


# -- splitting


def diff_text(n, seed=0):
    rng = random.Random(seed)
    out = ["commit abc", "", "Message of the commit", ""]
    for i in range(n):
        out += [f"diff --git a/f{i} b/f{i}", "@@ -1,2 +1,3 @@"] + [("+" if rng.random() < 0.5 else " ") + words(rng.randrange(1, 12), rng.random()) for _ in range(rng.randrange(5, 60))]
    return "\n".join(out)


@pytest.mark.parametrize("text", [diff_text(30), words(4000), "x" * 9000, "é" * 3000, "漢字" * 2000, "😀" * 1500, "\n" * 5000, "a\r\nb\r" * 2000, diff_text(3) + "\n" + "QmFzZTY0" * 2000], ids=str)
def test_pieces_cover_the_text(text):
    t = tokens()
    ids = t.encode(text)
    got = split.split_text(text, t, 256, 16)
    data = text.encode()
    assert got[0][0] == 0 and got[-1][1] == len(ids) and got[0][2] == 0 and got[-1][3] == len(data)
    for a, b, x, y, _ in got:
        assert 0 < b - a <= 256
        piece = data[x:y].decode()  # never within a character
        assert t.encoding.decode(ids[a:b].tolist()) == piece
    for (_, end, *_), (start, *_) in zip(got, got[1:], strict=False):
        assert 16 <= end - start < 20
    assert len(got) <= -(-len(ids) // (256 - 20)) * 2 + 1


def test_natural_breaks_are_preferred():
    t, text = tokens(), diff_text(30)
    kinds = Counter(split.KINDS[p] for *_, p in split.split_text(text, t, 512, 16)[1:])
    assert set(kinds) <= {"file", "hunk", "paragraph", "line"} and kinds["file"] + kinds["hunk"] > kinds["line"]


def brute_cuts(n, pos, pen, overlap, limit, even):
    best = {0: (0.0, [])}
    for j, (p, c) in enumerate([*zip(pos, pen, strict=True), (n, 0.0)]):
        opts = []
        for q, (cost, path) in best.items():
            begin = max(0, q - overlap)
            if q < p and p - begin <= limit:
                opts.append((cost + split.IMBALANCE * ((p - q - even) / limit) ** 2 + c + split.PIECE, [*path, j]))
        if opts:
            best[p] = min(opts)
    return best[n]


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randrange(60, 300)
        pos = np.array(sorted(rng.sample(range(1, n), n // 3)))
        pen = np.array([rng.choice([0.0, 1.0, 4.0, 16.0]) for _ in pos])
        back = np.maximum(pos - 5, 0)
        got = split.cuts(n, pos, pen, back, 40)
        o = float(np.median(pos - back))
        even = n / max(1, int(np.ceil((n - o) / (40 - o))))
        cost, path = brute_cuts(n, pos.tolist(), pen.tolist(), 5, 40, even)
        ends = [0, *(int(pos[g]) for g in got), n]
        mine = sum(split.IMBALANCE * ((b - a - even) / 40) ** 2 + split.PIECE for a, b in zip(ends, ends[1:], strict=False)) + sum(pen[g] for g in got)
        assert abs(mine - cost) < 1e-9, (got, path)


def test_only_long_texts_are_cut(spark):
    data = [(1, "s", None), (2, "s", ""), (3, "s", words(2000)), (4, "s", words(2048)), (5, "s", diff_text(80)), (5, "s", diff_text(80)), (6, "s", words(2060))]
    t = tokens()
    got = split.pieces(docs(spark, data)).toPandas()
    assert set(got.doc_id) == {i for i, _, x in data if x and t.count_one(x) > 2048}
    assert got.tokens.max() <= 2048 and (got[got.piece_no > 0].overlap == 64).all()
    five = got[got.doc_id == 5].sort_values(["piece_no"])
    assert len(five) == 2 * five.n_pieces.iloc[0]
    assert split.pieces(docs(spark, data[:2]), with_text=False).count() == 0
    with pytest.raises(ValueError):
        split.pieces(docs(spark, data), 100, 60)


# -- de-duplication of batches

READING = "reading_id long, batch_id long, sensor_id string, timestamp long, temperature double, received_at timestamp_ntz, shard string"
T0 = 1_704_067_200


def greedy(points):
    """(kept, rejected) going through readings by id."""
    taken, out = defaultdict(dict), []
    for i, s, t in sorted(points):
        near = [taken[s][x] for x in (t - 1, t, t + 1) if x in taken[s]]
        if near:
            out.append((min(near), i))
        else:
            taken[s][t] = i
    return sorted(out, key=repr)


def frame(spark, points, batch=lambda i: i // 40):
    data = [(i, batch(i), f"sensor-{s}", t, 1.0, datetime(1970, 1, 1) + timedelta(seconds=t), "clash") for i, s, t in points]
    return spark.createDataFrame(data, READING)


def judged(df):
    return rows(df.where("kept_id IS NOT NULL"), "kept_id", "reading_id")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_judging_is_like_going_through(spark, seed):
    rng = random.Random(seed)
    span = [40, 400, 4000][seed - 1]
    points = [(i, rng.choice([1, 2, 12345]), T0 - 20 + rng.randrange(span)) for i in range(400)]
    rng.shuffle(points)
    assert judged(suffix.judge(frame(spark, points), shard_rows=100)) == greedy(points)


def test_one_reading_a_second_and_copies(spark):
    line = [(i, 1, T0 + i) for i in range(300)]
    back = [(1000 + i, 2, T0 + 7300 - i) for i in range(300)]
    copies = [(2000 + i, 3, T0) for i in range(300)] + [(2500, 3, T0 + 1), (2501, 3, T0 + 2), (1999, 3, T0 + 3)]
    points = line + back + copies
    assert judged(suffix.judge(frame(spark, points, lambda i: i % 7), shard_rows=90)) == greedy(points)


def test_judging_nothing_and_nulls(spark):
    df = frame(spark, [(1, 1, T0), (2, 1, T0)])
    assert suffix.judge(df.limit(0)).count() == 0
    more = spark.createDataFrame([(None, 1, "sensor-1", T0, None, datetime(2024, 1, 1), "x"), (3, None, "sensor-1", T0 + 1, None, datetime(2024, 1, 1), "x"), (4, 1, None, T0, None, datetime(2024, 1, 1), "x"), (5, 1, "sensor-1", T0, None, None, "x")], READING)
    assert judged(suffix.judge(df.unionByName(more))) == [(1, 2), (1, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab;", max_size=6), max_size=8), st.lists(st.text("ab;", max_size=6), max_size=8), st.text("ab;", min_size=1, max_size=5))
def test_segments_find_substrings(one, two, needle):
    a, b = [x.encode() for x in one], [x.encode() for x in two]
    s = suffix.Segment.build(a, np.arange(len(a)), 8).merge(suffix.Segment.build(b, np.arange(len(b)) + 100, 8))
    text, n = b"".join(a + b), needle.encode()
    lo, hi = s.find(np.array([n]))
    # a needle may run over the end of a record, but a segment's own text is what is searched
    within = sorted(i for i in range(len(text)) if text[i : i + 8].startswith(n) and not (i < len(b"".join(a)) < i + len(n)))
    assert sorted(set(s.order[lo[0] : hi[0]].tolist())) == within
    assert [s.keys[i] <= s.keys[i + 1] for i in range(len(s.keys) - 1)] == [True] * max(0, len(s.keys) - 1)


def test_coverage_counts_bytes_of_long_matches():
    s = suffix.Segment.build([b"the quick brown fox", b"jumps"], np.array([1, 2]), 16)
    got = suffix.coverage([b"the quick red fox", b"nothing", b"", b"the quick brown fox"], [s], 6)
    assert got.tolist() == [10 / 17, 0.0, 0.0, 1.0]


def test_history_grows_by_takes(spark):
    rng = random.Random(9)
    points = [(i, rng.choice([1, 2]), T0 + 86_000 + rng.randrange(800)) for i in range(240)]  # over midnight
    h = suffix.History(spark, shared_path(spark, "history"), shard_rows=30, segment_rows=50)
    got = []
    for b in range(5):
        part = [p for p in points if p[0] // 48 == b]
        got += judged(h.take(frame(spark, part, lambda i: i // 20)))
    assert sorted(got, key=repr) == greedy(points)
    n, m = h.version()
    assert n == 5 and set(m["days"]) == {str((T0 + 86_000) // 86_400), str((T0 + 86_800) // 86_400)}
    assert all([level for level, _ in parts] == sorted({level for level, _ in parts}, reverse=True) for parts in m["days"].values())
    kept = len(points) - len(got)
    assert h.report().agg(F.sum("records")).first()[0] == kept and h.segments().where("length(owners) > 8 * 50").count() == 0
    assert h.take(frame(spark, points).limit(0)).count() == 0 and h.version()[0] == 5


def test_a_take_reads_only_the_days_it_touches(spark):
    h = suffix.History(spark, shared_path(spark, "history"))
    for day in range(4):
        h.take(frame(spark, [(day * 100 + i, 1, T0 + day * 86_400 + 10 * i + 5) for i in range(50)]))
    day = T0 // 86_400 + 1
    files = h.segments([day]).inputFiles()
    assert files and all(f"of_day={day}/" in f for f in files) and h.segments([day]).count() == 1
    late = frame(spark, [(900, 1, T0 + 86_400 + 6), (901, 1, T0 + 86_400 + 8)])
    assert judged(h.take(late)) == [(100, 900)]


def test_long_numbers_are_told_apart(spark):
    """A sensor number of thirty digits: readings 500 seconds apart are no duplicates, whatever the depth of stored keys."""
    number = "1" * 30
    h = suffix.History(spark, shared_path(spark, "history"))
    one = lambda i, n, t: frame(spark, [(i, n, t)])
    assert judged(h.take(one(1, 7, T0))) == [] == judged(h.take(one(2, number, T0)))
    assert judged(h.take(one(3, number, T0 + 500))) == [] and judged(h.take(one(4, number, T0 + 501))) == [(3, 4)]
    assert judged(h.take(one(5, number + "2", T0 + 501))) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["sensor-0001", "sensor-12345"]), st.integers(-5, 5)), min_size=1, max_size=12, unique=True), st.integers(-1000, 10**10))
def test_coverage_of_words_is_nearness(points, base):
    sensors, seconds = [s for s, _ in points], np.array([base + t for _, t in points])
    r = suffix.Records.of(pd.Series(sensors), seconds, np.arange(len(points)))
    row, owner, _ = r.covered_by(r.segment())
    near = {(i, j) for i in range(len(points)) for j in range(len(points)) if i != j and sensors[i] == sensors[j] and abs(seconds[i] - seconds[j]) <= 1}
    assert set(zip(row.tolist(), owner.tolist(), strict=True)) == near


def test_merging_keeps_few_levels():
    lv = suffix.Levels()
    for i in range(37):
        lv.add(suffix.Segment.build([f"{i:04d};".encode()], np.array([i]), 3 + i % 5))
    assert len(lv.segments) == bin(37).count("1")
    found = lambda needle: sorted(int(s.owners[np.searchsorted(s.starts, a, "right") - 1]) for s in lv.segments for a in s.occurrences(np.array([needle]))[1])
    assert [found(n) for n in (b"0005;", b"0036;", b"0099;", b"003")] == [[5], [36], [], [3, 30, 31, 32, 33, 34, 35, 36]]
