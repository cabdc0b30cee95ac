"""The sweep over open windows against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from iotrail.operators import objects as O
from iotrail.operators.sweep import Staircase, best_open


def by_force(points, windows):
    out = []
    for p in points:
        held = [w for w in windows if w[0] == p[0] and w[1] <= p[1] < w[2]]
        best = min(held, key=lambda w: (w[4] != p[2] or p[2] is None, w[3], w[5]), default=None)
        out.append((*p, best[5] if best else None))
    return sorted(out, key=str)


def swept(spark, points, windows, **how):
    p = spark.createDataFrame(points, "k long, at long, kind string, id long")
    w = spark.createDataFrame(windows, "k long, t0 long, t1 long, r long, way string, id long").repartition(3)
    w = w.withColumnRenamed("id", "best")
    got = best_open(p, w, "k", "at", "kind", "t0", "t1", ["r"], "way", "best", **how)
    assert got.columns == ["k", "at", "kind", "id", "best"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("chunked", [False, True])
def test_best_open(spark, chunked):
    rng = random.Random(3)
    ways = ["read", "write", None]
    points = [(rng.choice([1, 1, 1, 2, 3, 9]), rng.randrange(-50, 250), rng.choice(ways), i % 300) for i in range(400)]
    windows = [(rng.choice([1, 1, 1, 2, 3]), b := rng.randrange(-40, 200), b + rng.choice([0, 1, 5, 30, 400]), rng.randrange(40), rng.choice(ways), i) for i in range(150)]
    points += points[:20]
    assert swept(spark, points, windows, chunked=chunked) == by_force(points, windows)


@pytest.mark.parametrize("chunked", [False, True])
def test_one_key_with_all_rows(spark, chunked):
    """Ten thousand windows of one key, all over each other, and as many points: one row per point."""
    points = [(7, 3 * i, "read" if i % 2 else "write", i) for i in range(10_000)]
    windows = [(7, 2 * i, 2 * i + 15_000, i * 7919 % 10_007, "read" if i % 3 else "write", i) for i in range(10_000)]
    got = swept(spark, points, windows, chunked=chunked)
    assert len(got) == len(points)
    rng = random.Random(1)
    some = rng.sample(points, 60)
    want = by_force(some, windows)
    assert {r[3]: r[4] for r in want} == {r[3]: r[4] for r in got if r[3] in {p[3] for p in some}}


def test_nothing_to_sweep(spark):
    points = [(1, 5, "read", 1)]
    for chunked in (False, True):
        assert swept(spark, points, [], chunked=chunked) == [(1, 5, "read", 1, None)]
        assert swept(spark, [], [(1, 0, 9, 1, "read", 1)], chunked=chunked) == []


def test_a_staircase_keeps_what_can_win():
    stair = Staircase()
    for k, (end, rank) in enumerate([(10, 5), (20, 6), (8, 7), (15, 3), (30, 9)]):
        stair.enter(0, end, (rank,), k)
    assert (stair.ends, stair.values) == ([15, 20, 30], [3, 1, 4])
    stair.enter(16, 17, (1,), 9)
    assert stair.values == [9, 1, 4]


@pytest.mark.parametrize("chunked", [False, True])
def test_repeated_commands_stay(spark, chunked):
    obj = spark.createDataFrame([(1, "store", 4096, 0, 100, 200), (2, "load", 4096, 0, 100, 300), (3, "store", 8192, 65536, 0, 50)], "trace_id long, op string, bytes long, slot_offset long, ts_start_ns long, ts_ns long")
    cmd = [(1, 1, 512, "write", 150), (1, 1, 512, "write", 150), (2, 1, 512, "read", 150), (2, 1, 512, "write", 250), (0, 15, 1024, "read", 150), (3, 17, 512, "read", 900), (0, 500, 512, "read", 1)]
    cmd += [(0, 15, 65536, "read", 150)]
    rows = spark.createDataFrame(cmd, "tid long, slba long, bytes long, op_name string, ts_ns long")
    got = O.by_extent(obj, rows, ["ts_start_ns", "trace_id"], 512, slack_ns=0, chunked=chunked)
    assert got.count() == len(cmd)
    by = {(r["tid"], r["slba"], r["op_name"], r["ts_ns"], r["bytes"]): (r["match"], r["obj_id"]) for r in got.collect()}
    assert by[1, 1, "write", 150, 512] == ("unique", 1) and by[2, 1, "read", 150, 512] == ("unique", 2) and by[2, 1, "write", 250, 512] == ("unique", 2)
    assert by[0, 15, "read", 150, 1024] == ("gap_spill", None) and by[0, 15, "read", 150, 65536] == ("cross_object", None)
    assert by[0, 500, "read", 1, 512] == ("unmatched", None)
    assert got.filter(F.col("match") == "unique").count() == 4
