"""Streams over several files give what the batch forms give."""

import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from iotrail import schemas
from iotrail.operators import heat as H
from iotrail.operators.pairing import consuming_pairs
from iotrail.operators.syscalls import fork_tree
from iotrail.session import scratch
from iotrail.streaming import jobs

S = 1_000_000_000
SCHEMA = "k long, ts_ns long, is_start boolean, block long, sample long"


def write_parts(spark, folder, rows, parts=3):
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size : (i + 1) * size]
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")


def events():
    out = []
    for i in range(300):
        out.append((i % 7, i * S, (i * i) % 3 != 0, i % 11, i % 40))
    return out


def source(spark, folder):
    rows = jobs.tail(spark, f"{folder}/*", SCHEMA, "parquet", files_per_batch=1)
    return rows.withColumn("time", jobs.event_time(F.col("ts_ns")))


def test_pairs_equal_batch(spark, tmp_path):
    write_parts(spark, str(tmp_path), events())
    emitted = jobs.run_available(jobs.paired(source(spark, str(tmp_path)), ["k"], "time", "1 second", 10**15))
    got = {(r["k"], r["start_ns"], r["end_ns"]) for r in emitted.filter("outcome = 'paired'").collect()}
    batch = spark.createDataFrame(events(), SCHEMA)
    pairs = consuming_pairs(batch, ["k"], ["ts_ns"], F.col("is_start"), ["ts_ns"])
    want = {(r["k"], r["start_ts_ns"], r["ts_ns"]) for r in pairs.collect()}
    assert got == want and want
    assert emitted.select("batch").distinct().count() == 3


def test_unanswered_starts_expire(spark, tmp_path):
    starts = [(1, 10, True), (2, 11, True), (2, 13, False), (3, 100, True), (4, 200, True)]
    rows = [(k, t * S, is_start, 0, 0) for k, t, is_start in starts]
    write_parts(spark, str(tmp_path), rows, 5)
    emitted = jobs.run_available(jobs.paired(source(spark, str(tmp_path)), ["k"], "time", "1 second", 30 * S))
    got = {(r["k"], r["outcome"]) for r in emitted.collect()}
    assert got == {(1, "expired"), (2, "paired"), (3, "expired")}


def test_a_closed_stream_is_complete(spark, tmp_path):
    rows = [(i % 3, i * 7 * S, i % 2 == 0, 0, 0) for i in range(1, 31)]
    write_parts(spark, str(tmp_path), rows)
    stream = source(spark, str(tmp_path)).withColumn("size", F.lit(1))
    closed, close = jobs.closable(stream, "time")
    windows = jobs.run_available(jobs.tumbling_status(closed, "time", "20 seconds", "1 second"), name="all", close=close)
    assert windows.agg(F.sum("n")).first()[0] == 30
    closed, close = jobs.closable(stream, "time")
    pairs = jobs.run_available(jobs.paired(closed, ["k"], "time", "1 second", 100 * S), name="open", close=close)
    got = sorted((r["k"], r["outcome"], r["start_ns"]) for r in pairs.collect())
    want = []
    for k in range(3):
        mine = [(t, s) for key, t, s, _, _ in rows if key == k]
        for (t, s), later in zip(mine, [*mine[1:], None]):
            if s and (later is None or not later[1]):
                want.append((k, "open" if later is None else "paired", t))
    assert got == sorted(want) and any(o == "open" for _, o, _ in want)


def write_shuffled(spark, folder, rows, parts=4, seed=5):
    """Files whose rows are in no order of time, neither within a file nor between them."""
    rows = random.Random(seed).sample(rows, len(rows))
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA).coalesce(1).write.parquet(f"{folder}/p{i}")


def test_late_rows_are_paired_in_order(spark, tmp_path):
    """Files in any order give what the batch pairing gives; a start is no later than its end, and none is lost."""
    rows = [(k, (t + 1) * S, is_start, 0, 0) for k, t, is_start in [(1, 99, True), (1, 89, False), (2, 79, True), (2, 99, True), (2, 89, False), (1, 150, False)]]
    rows += [(3 + i % 5, (i + 1) * S, (i * i) % 3 != 0, 0, 0) for i in range(160)]
    write_shuffled(spark, str(tmp_path), rows)
    closed, close = jobs.closable(source(spark, str(tmp_path)), "time")
    emitted = jobs.run_available(jobs.paired(closed, ["k"], "time", "1000 seconds", 10**15), close=close)
    got = sorted((r["k"], r["start_ns"], r["end_ns"]) for r in emitted.filter("outcome = 'paired'").collect())
    batch = spark.createDataFrame(rows, SCHEMA)
    pairs = consuming_pairs(batch, ["k"], ["ts_ns"], F.col("is_start"), ["ts_ns"])
    assert got == sorted((r["k"], r["start_ts_ns"], r["ts_ns"]) for r in pairs.collect())
    assert {(1, 100 * S, 151 * S), (2, 80 * S, 90 * S)} <= set(got)
    assert {(r["k"], r["start_ns"]) for r in emitted.filter("outcome = 'open'").collect()} >= {(2, 100 * S)}


def bounded_by_force(rows, cap, timeout):
    """One group, event by event."""
    begun, out = {}, []
    for k, ts, is_start in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        while begun and min(begun.values()) + timeout < ts:
            first = min(begun, key=begun.get)
            out.append((first, "expired", begun.pop(first), None))
        before = begun.pop(k, None)
        if is_start:
            begun[k] = ts
            if len(begun) > cap:
                first = min(begun, key=begun.get)
                out.append((first, "evicted", begun.pop(first), None))
        elif before is not None:
            out.append((k, "paired", before, ts))
    return sorted([*out, *((k, "open", ts, None) for k, ts in begun.items())], key=str)


def test_a_full_table_evicts_the_oldest(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(12), (i + 1) * S, rng.random() < 0.7, 0, 0) for i in range(200)]
    write_shuffled(spark, str(tmp_path), rows)
    closed, close = jobs.closable(source(spark, str(tmp_path)).withColumn("device", F.lit(0)), "time")
    pairs = jobs.bounded_pairs(closed, "device", "k", "time", "1000 seconds", 15 * S, cap=4)
    emitted = jobs.run_available(pairs, name="bounded", close=close, conf=jobs.ROCKSDB)
    got = sorted(((r["k"], r["outcome"], r["start_ns"], r["end_ns"]) for r in emitted.collect()), key=str)
    assert got == bounded_by_force([r[:3] for r in rows], 4, 15 * S)
    assert {o for _, o, _, _ in got} >= {"evicted", "expired", "paired"}


class Kept:
    """A list of state values in memory."""

    def __init__(self):
        self.values = []

    def get(self):
        return iter(self.values)

    def put(self, values):
        self.values = list(values)

    def appendValue(self, value):
        self.values.append(value)

    def clear(self):
        self.values = []


class Handle:
    def __init__(self):
        self.lists, self.timers = {}, []

    def getListState(self, name, schema):
        return self.lists.setdefault(name, Kept())

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("kind", [LongType(), StringType()])
def test_waiting_events_are_no_python_objects(kind, monkeypatch):
    """A large micro-batch waits in pieces of columns, and comes out in pieces."""
    monkeypatch.setattr(jobs, "EVENTS_AT_ONCE", 100)
    rng = random.Random(5)
    rows = [(rng.randrange(12), (i + 1) * S, rng.random() < 0.7) for i in range(950)]
    rows = [(str(k) if isinstance(kind, StringType) else k, ts, is_start) for k, ts, is_start in rows]
    mixed = pd.DataFrame(rng.sample(rows, len(rows)), columns=["k", "ts_ns", "is_start"])
    pairs, handle = jobs.BoundedPairs("device", "k", ("bigint", kind.simpleString()), 15 * S, 4, kind), Handle()
    pairs.init(handle)
    times = lambda mark: SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    assert not list(pairs.handleInputRows((0,), iter([mixed[:500], mixed[500:]]), times(0)))
    assert len(handle.lists["waiting"].values) <= 12 and handle.timers == [1001]
    found = [f for mark in (400_500, 8 * 10**15) for f in pairs.handleExpiredTimer((0,), times(mark), None)]
    assert len(found) > 5 and not handle.lists["waiting"].values and not handle.timers
    got = [(r.k, r.outcome, r.start_ns, None if pd.isna(r.end_ns) else r.end_ns) for f in found for r in f.itertuples()]
    assert sorted(got, key=str) == bounded_by_force(rows, 4, 15 * S)


def test_timers_expire_starts_without_further_rows(spark, tmp_path):
    rows = [(1, 10 * S, True, 0, 0), (2, 11 * S, True, 0, 0), (2, 13 * S, False, 0, 0), (3, 100 * S, True, 0, 0), (4, 200 * S, True, 0, 0)]
    write_parts(spark, str(tmp_path), rows, 5)
    stream = source(spark, str(tmp_path)).withColumn("device", F.col("k"))
    emitted = jobs.run_available(jobs.bounded_pairs(stream, "device", "k", "time", "1 second", 30 * S), name="timers", conf=jobs.ROCKSDB)
    assert {(r["k"], r["outcome"]) for r in emitted.collect()} == {(1, "expired"), (2, "paired"), (3, "expired")}


def test_heat_and_frequency_equal_batch(spark, tmp_path):
    """Also if the files come in any order."""
    rows = [(0, i * S, True, i % 5, i // 3) for i in range(240)]
    write_shuffled(spark, str(tmp_path), rows)
    batch = spark.createDataFrame(rows, SCHEMA)
    forms = [(lambda d: jobs.block_heat(d, 1, 45, lateness=100), H.heat(batch, 1, 5, 80)), (lambda d: jobs.block_frequency(d, 20, lateness=100), H.frequency(batch, 20, 80))]
    for stream, want in forms:
        touches, close = jobs.closable(jobs.with_sample_time(source(spark, str(tmp_path))), jobs.SAMPLE_TIME)
        got = jobs.latest(jobs.run_available(stream(touches), "update", close=close), ["block"]).collect()
        assert {r["block"]: r["points"] for r in got} == {r["block"]: r["points"] for r in want.collect()}
        assert {r["last_sample"] for r in got} == {79, 78} or {r["last_sample"] for r in got} == {79}


def test_losses_are_counted(spark, tmp_path):
    body = [json.dumps({"event_type": "nvme_cmd"}), json.dumps({"event_type": "drops", "dropped": 4}), '{"event_ty']
    (tmp_path / "a.jsonl").write_text("\n".join(body))
    stream = jobs.counted_losses(jobs.tail(spark, str(tmp_path), schemas.DEVICE))
    query = stream.writeStream.format("noop").option("checkpointLocation", scratch(spark, "loss"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p["observedMetrics"]["losses"] for p in map(dict, query.recentProgress) if p["observedMetrics"]]
    assert (seen[0]["rows"], seen[0]["corrupt"], seen[0]["dropped"]) == (3, 1, 4)


def test_fork_edges_arrive_in_parts(spark, tmp_path):
    schema = "parent_pid long, child_pid long, ts_ns long"
    # A record comes twice, and pid 3 is used again by a stranger, whose child is none of ours.
    parts = [[(1, 2, 10), (2, 3, 20), (2, 3, 20)], [(3, 4, 30), (9, 10, 31), (10, 3, 40)], [(4, 5, 50), (3, 6, 60)]]
    for i, edges in enumerate(parts):
        spark.createDataFrame(edges, schema).coalesce(1).write.parquet(f"{tmp_path}/e{i}")
    stream = jobs.tail(spark, f"{tmp_path}/*", schema, "parquet", files_per_batch=1)
    got = sorted((r["pid"], r["birth_ns"], r["depth"]) for r in jobs.tracked_processes(stream, [1]).collect())
    assert got == [(1, -1, 0), (2, 10, 1), (3, 20, 2), (4, 30, 3), (5, 50, 4)]


def test_a_forest_grows_by_its_batches(spark, tmp_path):
    """Forks in shuffled files give the tree of all of them, and a batch writes what it settles."""
    rng = random.Random(6)
    edges = [(rng.randrange(30), rng.randrange(30), 10 * (i + 1)) for i in range(240)]
    edges += edges[:15]
    late = 300
    dealt = [[e for e in edges if (e[2] + rng.randrange(late)) // 500 == i] for i in range(6)]
    schema = "parent_pid long, child_pid long, ts_ns long"
    for i, part in enumerate(dealt):
        spark.createDataFrame(rng.sample(part, len(part)), schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    seen = [e for part in dealt for e in part]
    stream = jobs.tail(spark, f"{tmp_path}/*", schema, "parquet", files_per_batch=1)
    forest = jobs.growing_forest(stream, lateness_ns=2 * late + 500)
    got = sorted((r["pid"], r["birth_ns"], r["root"], r["depth"]) for r in forest.collect())
    want = sorted((r["pid"], r["birth_ns"], r["root"], r["depth"]) for r in fork_tree(spark.createDataFrame(seen, schema)).collect())
    assert got == want and len(got) == len(set(got))
    sizes = {r["batch"]: r["count"] for r in forest.groupBy("batch").count().collect()}
    assert len(sizes) >= 4 and max(sizes.values()) < 0.6 * len(got)


def test_an_empty_forest(spark, tmp_path):
    schema = "parent_pid long, child_pid long, ts_ns long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/0")
    assert jobs.tracked_processes(jobs.tail(spark, f"{tmp_path}/*", schema, "parquet"), [1]).count() == 0
