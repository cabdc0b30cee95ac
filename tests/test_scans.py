"""Scans, pairing and folds against plain sequential programs."""

import random

import pytest
from pyspark.sql import functions as F

from iotrail.operators import heat as H
from iotrail.operators import scan as scans
from iotrail.operators.asof import asof_join, range_join
from iotrail.operators.counters import halved_runs, rolling_share
from iotrail.operators.fold import assign_lanes
from iotrail.operators.pages import rolling_changes
from iotrail.operators.pairing import latest_pairs, lifecycles, sequence_then_address
from iotrail.operators.scan import (
    Clamped,
    Following,
    LastSeen,
    Previous,
    RunningMax,
    RunningSum,
    Scan,
    split_on_gap,
)

BOTH = pytest.mark.parametrize("chunked", [False, True])


def hot_rows(n=400, seed=1):
    """(key, ts, v) with one key holding most rows and another no value at all."""
    rng = random.Random(seed)
    rows = []
    for ts in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice(["k0", "k1", "k2", None])
        v = None if key == "k1" or rng.random() < 0.3 else rng.randrange(-5, 6)
        rows.append((key, ts, v))
    return rows


@BOTH
@pytest.mark.parametrize("keys", [["key"], []])
def test_measures_match_a_fold(spark, chunked, keys):
    rows = hot_rows()
    if not keys and not chunked:
        chunked = None
    df = spark.createDataFrame(rows, "key string, ts long, v long")
    step = F.coalesce(F.col("v"), F.lit(0))
    scan = Scan(df, keys, ["ts"], chunked)
    scan.add(
        RunningSum("s", step),
        RunningSum("s_before", step, exclusive=True),
        RunningMax("m", F.col("v")),
        LastSeen("seen", F.col("v")),
        LastSeen("seen_before", F.col("v"), exclusive=True),
        Previous("prev", F.col("v")),
        Following("nxt", F.col("ts")),
        Clamped("c", step),
        Clamped("f", step, F.when(F.col("ts") % 7 == 0, 2).otherwise(0)),
    )
    scan.add(RunningSum("s2", F.col("c")))
    got = {r["ts"]: r.asDict() for r in scan.df.collect()}
    assert len(got) == len(rows)

    groups = {}
    for r in rows:
        groups.setdefault(r[0] if keys else None, []).append(r)
    for group in groups.values():
        s = c = f = s2 = 0
        m = seen = prev = None
        for i, (_, ts, v) in enumerate(group):
            before, seen_before = s, seen
            d = v or 0
            s += d
            c = max(c + d, 0)
            f = max(f + d, 2 if ts % 7 == 0 else 0)
            s2 += c
            m = v if m is None else (m if v is None else max(m, v))
            seen = v if v is not None else seen
            nxt = group[i + 1][1] if i + 1 < len(group) else None
            row = got[ts]
            want = dict(
                s=s, s_before=before, m=m, seen=seen, seen_before=seen_before, prev=prev, nxt=nxt, c=c, f=f, s2=s2
            )
            assert {k: row[k] for k in want} == want, (ts, row)
            prev = v


def test_a_hot_key_is_measured(spark, monkeypatch):
    df = spark.createDataFrame(hot_rows(), "key string, ts long, v long")
    assert not Scan(df, ["key"], ["ts"]).chunked
    monkeypatch.setattr(scans, "ROWS_PER_TASK", 50)
    assert Scan(df, ["key"], ["ts"]).chunked


def test_chunks_spread_a_single_key(spark):
    df = spark.range(1000).select(F.lit(1).alias("key"), F.col("id").alias("ts"))
    sizes = Scan(df, ["key"], ["ts"], chunked=True)._df.groupBy(scans.CHUNK).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 500


@BOTH
def test_gap_split(spark, chunked):
    rng = random.Random(3)
    spans = []
    for i in range(200):
        b = rng.randrange(2000)
        spans.append((i % 2, b, b + rng.randrange(12), i))
    df = spark.createDataFrame(spans, "key int, b long, e long, i long")
    got = {r["i"]: r["island"] for r in split_on_gap(df, ["key"], ["b", "e", "i"], "b", "e", chunked=chunked).collect()}
    for key in (0, 1):
        reach, island = None, 0
        for _, b, e, i in sorted(s for s in spans if s[0] == key):
            if reach is None or b > reach:
                island += 1
            assert got[i] == island
            reach = e if reach is None else max(reach, e)


@BOTH
def test_asof_both_ways(spark, chunked):
    rng = random.Random(5)
    left = [(rng.randrange(3), rng.randrange(100), i) for i in range(80)]
    right = [(rng.randrange(3), rng.randrange(100), i) for i in range(40)]
    a = spark.createDataFrame(left, "k int, ts long, i long")
    b = spark.createDataFrame(right, "k int, at long, v long")
    back = asof_join(a, b, ["k"], "ts", "at", {"v": "v"}, tie=["v"], chunked=chunked)
    later = asof_join(a, b, ["k"], "ts", "at", {"at": "at"}, forward=True, chunked=chunked)
    backward = {r["i"]: r["v"] for r in back.collect()}
    forward = {r["i"]: r["at"] for r in later.collect()}
    for k, ts, i in left:
        before = [(at, v) for k2, at, v in right if k2 == k and at <= ts]
        after = [at for k2, at, _ in right if k2 == k and at >= ts]
        assert backward[i] == (max(before)[1] if before else None)
        assert forward[i] == (min(after) if after else None)


def test_range_join_matches_nested_loops(spark):
    rng = random.Random(6)
    ranges = [(rng.randrange(2), lo := rng.randrange(500), lo + rng.randrange(60), i) for i in range(50)]
    points = [(rng.randrange(2), rng.randrange(600), i) for i in range(200)]
    p = spark.createDataFrame(points, "k int, x long, p long")
    r = spark.createDataFrame(ranges, "k int, lo long, hi long, r long")
    got = {(x["p"], x["r"]) for x in range_join(p, r, ["k"], "x", "lo", "hi", 16).collect()}
    want = {(pi, ri) for k, x, pi in points for k2, lo, hi, ri in ranges if k == k2 and lo <= x < hi}
    assert got == want


def block_events(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sector = 8 if rng.random() < 0.5 else 8 * rng.randrange(1, 6)
        out.append((259, 0, 0, i, rng.randrange(n) * 1000, rng.choice("QDCQDCM"), rng.choice(["R", "W", "WS"]), sector, 8))
    return out


BLK = "major int, minor int, cpu int, seq long, ts_ns long, action string, rwbs string, sector long, nblocks long"


@BOTH
def test_lifecycles_match_queues(spark, chunked):
    events = block_events(600, 11)
    got = lifecycles(spark.createDataFrame(events, BLK), chunked=chunked).collect()
    queues, want = {}, []
    for e in sorted(events, key=lambda e: (e[4], e[2], e[3])):
        _, _, _, _, ts, action, rwbs, sector, n = e
        open_ = queues.setdefault((sector, n), [])
        if action == "Q":
            open_.append({"q": ts, "d": None, "r": "R" in rwbs})
        elif action == "D":
            if open_:
                open_[0]["d"] = ts
            else:
                open_.append({"q": None, "d": ts, "r": "R" in rwbs})
        elif action == "C" and open_:
            x = open_.pop(0)
            want.append((sector, x["r"], x["q"], x["d"], ts))
    key = lambda t: tuple(-1 if v is None else int(v) for v in t)
    have = [(r["sector"], r["is_read"], r["queue_ns"], r["issue_ns"], r["complete_ns"]) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)


@BOTH
def test_number_then_address_matches_two_maps(spark, chunked):
    events = block_events(500, 12)
    df = spark.createDataFrame(events, BLK).withColumn("num", F.col("seq") % 40)
    got = {r["seq"]: (r["matched"], r["lat_ms"]) for r in sequence_then_address(df, seq="num", chunked=chunked).collect()}
    by_num, by_addr = {}, {}
    for e in sorted(events, key=lambda e: (e[4], e[2], e[3])):
        _, _, _, seq, ts, action, _, sector, _ = e
        if action == "Q":
            by_num[seq % 40] = (ts, sector)
            by_addr[sector] = ts
        elif action == "C":
            hit = by_num.pop(seq % 40, None)
            if hit:
                by_addr.pop(hit[1], None)
                want = ("seq", (ts - hit[0]) / 1e6)
            elif (start := by_addr.pop(sector, None)) is not None:
                want = ("address", (ts - start) / 1e6)
            else:
                want = ("none", None)
            assert got[seq] == want


@BOTH
def test_completions_go_to_the_latest_command(spark, chunked):
    rng = random.Random(13)
    cmds = [(rng.randrange(3), rng.randrange(300), i) for i in range(150)]
    done = [(rng.randrange(3), rng.randrange(300)) for _ in range(120)]
    a = spark.createDataFrame(cmds, "u int, ts long, i long")
    b = spark.createDataFrame(done, "u int, ts long")
    got = {r["i"]: r["dur_ns"] for r in latest_pairs(a, b, "u", "ts", ["i"], chunked).collect()}
    for u in range(3):
        mine, stack, want = sorted((ts, i) for k, ts, i in cmds if k == u), [], {}
        for c in sorted(ts for k, ts in done if k == u):
            while mine and mine[0][0] <= c:
                stack.append(mine.pop(0))
            if stack:
                ts, i = stack.pop()
                want[i] = c - ts
        for k, _, i in cmds:
            if k == u:
                assert got[i] == want.get(i)


def test_lanes_match_first_fit(spark):
    rng = random.Random(14)
    spans = []
    for i in range(300):
        b = rng.randrange(900)
        spans.append((i % 2, b, b + rng.randrange(1, 25), i))
    df = spark.createDataFrame(spans, "k int, b long, e long, i long")
    got = {r["i"]: r["lane"] for r in assign_lanes(df, ["k"], "b", "e", ["i"]).collect()}
    for k in (0, 1):
        lanes = []
        for _, b, e, i in sorted(s for s in spans if s[0] == k):
            lane = next((n for n, free in enumerate(lanes) if free < b), len(lanes))
            if lane == len(lanes):
                lanes.append(e)
            lanes[lane] = e
            assert got[i] == lane


def fold_heat(samples, decay, per_level, now):
    h = last = 0
    for s in samples:
        h, last = min(max(h - decay * (s - last), 0) + 1, 9 * per_level), s
    return h, min(max(h - decay * (now - last), 0) // per_level, 9)


def fold_frequency(samples, window, now, rate):
    def fade(v, idle):
        if idle == 0 or rate == 0:
            return v
        if idle * rate >= window:
            return 0
        for _ in range(idle):
            step = v // window * rate + v % window * rate // window
            if step >= v:
                return 0
            v -= step
        return v

    v = last = 0
    for s in samples:
        v, last = min(fade(v, s - last) + 10000 // window, 10000), s
    left = fade(v, now - last)
    return v, 0 if left == 0 else min(left * 8 // 10000 + 1, 9)


@pytest.mark.parametrize("part", [7, 4096])
@pytest.mark.parametrize("rate", [0, 1, 2])
def test_heat_and_frequency_match_folds(spark, monkeypatch, part, rate):
    monkeypatch.setattr(H, "PART", part)
    rng = random.Random(15)
    touches = {b: sorted(rng.randrange(120) for _ in range(rng.choice([1, 5, 90]))) for b in range(12)}
    df = spark.createDataFrame([(b, s) for b, ss in touches.items() for s in ss], "block long, sample long")
    heat = {r["block"]: (r["points"], r["digit"]) for r in H.heat(df, rate, 5, 125).collect()}
    freq = {r["block"]: (r["points"], r["digit"]) for r in H.frequency(df, 20, 125, rate).collect()}
    for b, samples in touches.items():
        assert heat[b] == fold_heat(samples, rate, 5, 125)
        assert freq[b] == fold_frequency(samples, 20, 125, rate)


def test_published_decay_table(spark):
    """Consecutive writes 1/10/20/40/100/180 without decay."""
    writes = [1, 10, 20, 40, 100, 180]
    df = spark.createDataFrame([(i, s) for i, n in enumerate(writes) for s in range(1, n + 1)], "block long, sample long")
    heat = H.heat(df, 0, 20, 180).orderBy("block").collect()
    freq = H.frequency(df, 20, 180, 0).orderBy("block").collect()
    assert [r["digit"] for r in heat] == [0, 0, 1, 2, 5, 9]
    assert [r["digit"] for r in freq] == [1, 5, 9, 9, 9, 9]


@pytest.mark.parametrize("most", [2, 3, 5, 8, 50])
def test_halved_runs(most):
    """The runs are what a list holds that drops every other point and doubles its stride when full."""
    for count in (0, 1, most - 1, most, most + 1, 3 * most, 1000):
        held, stride = [], 1
        for k in range(1, count + 1):
            if k % stride == 0:
                held.append(k)
                if len(held) >= most:
                    held, stride = held[::2], stride * 2
        got_stride, runs = halved_runs(count, most)
        assert got_stride == stride
        assert [first + i * step for first, step, n in runs for i in range(n)] == held


@pytest.mark.parametrize("chunked", [True, False])
def test_rolling_share(spark, chunked, monkeypatch):
    if chunked:
        monkeypatch.setattr(scans, "ROWS_PER_TASK", 0)
    rng = random.Random(11)
    rows = [(d, k, None if rng.random() < 0.1 else rng.randint(-50, 50)) for d, n in (("a", 1), ("b", 19), ("c", 40), ("d", 163), (None, 61)) for k in range(n)]
    frame = spark.createDataFrame(rows, "device string, ts long, v long")
    got = {(r["device"], r["ts"]): r for r in rolling_share(frame, "device", ["ts"], "v", 20).collect()}
    assert len(got) == len(rows)
    for device in ("a", "b", "c", "d", None):
        values = [v for d, _, v in rows if d == device]
        w = max(1, len(values) // 20)
        for k in range(len(values)):
            seen = [v for v in values[max(0, k - w + 1) : k + 1] if v is not None]
            r = got[device, k]
            assert (r["window"], r["roll_max"], r["roll_min"]) == (w, max(seen, default=None), min(seen, default=None))
            assert r["roll_mean"] == (pytest.approx(sum(seen) / len(seen)) if seen else None)
    assert rolling_share(frame.limit(0), "device", ["ts"], "v").count() == 0


def test_rolling_changes(spark):
    """A page is compared with its own last sample; unlike lengths are filled with zeros; nulls and equal pages change nothing."""
    rows = [(1, 0, 0, b"abc"), (1, 0, 2, b"aXc"), (1, 0, 5, b"abc"), (1, 1, 1, b"q"), (2, 0, 0, b"xy"), (2, 0, 1, b"xyz"), (2, 0, 3, b"xyz"), (3, 0, 0, None), (3, 0, 1, b"n")]
    frame = spark.createDataFrame(rows, "pid long, page_idx int, sample int, content binary")
    got = sorted(tuple(r) for r in rolling_changes(frame, ["pid", "page_idx"], ["sample"]).collect())
    assert got == [(1, 0, 2, 1, ord("b"), ord("X")), (1, 0, 5, 1, ord("X"), ord("b")), (2, 0, 1, 2, 0, ord("z"))]
    assert rolling_changes(frame.limit(0), ["pid", "page_idx"], ["sample"]).count() == 0
