"""Streaming queries: the event table is read as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import int_div
from iotrail.plans.pages import FREQUENCY_SQL, HEAT_SQL
from iotrail.plans.registry import Tables, micros, query
from iotrail.streaming import jobs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
PARTS = "p_partkey bigint"


def stream(t: Tables, table: str, schema: str) -> DataFrame:
    return jobs.tail(t.spark, t.dir, schema, "parquet", pattern=f"{table}.parquet")


def sized_events(t: Tables) -> DataFrame:
    rows = stream(t, "events", EVENTS)
    return rows.select(
        "event_id",
        "event_type",
        (F.col("user_id") % 20).alias("pid"),
        F.col("user_id").alias("tid"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size"),
        F.col("ts").cast("timestamp").alias("time"),
        (micros(F.col("ts")) * 1000).alias("ts_ns"),
    )


def to_micros(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in ("start", "end")}).drop("batch")


WINDOW_SQL = """
m AS (SELECT max(epoch_us(ts)) mx FROM events),
e AS (SELECT epoch_us(ts) us, user_id % 20 pid, CAST(floor(value * 100) AS BIGINT) size, event_type FROM events)
"""
H = 3_600_000_000


@query(
    "stream_tumbling_status",
    "R1 R2 R10",
    WINDOW_SQL
    + f""", b AS (SELECT us // {6 * H} * {6 * H} AS st, * FROM e)
      SELECT st AS "start", st + {6 * H} AS "end", event_type, count(*) n, CAST(sum(size) AS BIGINT) bytes
      FROM b GROUP BY st, event_type""",
)
def stream_tumbling_status(t: Tables) -> DataFrame:
    """Six-hour windows; the watermark is an hour behind, and the end of the stream closes the last ones."""
    events, close = jobs.closable(sized_events(t), "time")
    rows = jobs.tumbling_status(events, "time", "6 hours", "1 hour", ["event_type"])
    return to_micros(jobs.run_available(rows, name="tumbling", close=close))


@query(
    "stream_sliding_status",
    "R3",
    WINDOW_SQL
    + f""", x AS (SELECT us // {6 * H} * {6 * H} - k * {6 * H} AS st, size FROM e, (SELECT unnest([0, 1, 2, 3]) k))
      SELECT st AS "start", st + {24 * H} AS "end", count(*) n, CAST(sum(size) AS BIGINT) bytes FROM x GROUP BY st""",
)
def stream_sliding_status(t: Tables) -> DataFrame:
    events, close = jobs.closable(sized_events(t), "time")
    rows = jobs.tumbling_status(events, "time", "24 hours", "1 hour", slide="6 hours")
    return to_micros(jobs.run_available(rows, name="sliding", close=close))


@query(
    "stream_activity_sessions",
    "R4 W11",
    WINDOW_SQL
    + f""", l AS (SELECT *, lag(us) OVER (PARTITION BY pid ORDER BY us) p FROM e),
      s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= {4 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY us ROWS UNBOUNDED PRECEDING) k FROM l)
      SELECT pid, min(us) AS "start", max(us) + {4 * H} AS "end", count(*) n FROM s GROUP BY pid, k""",
)
def stream_activity_sessions(t: Tables) -> DataFrame:
    events, close = jobs.closable(sized_events(t), "time")
    rows = jobs.activity_sessions(events, "time", "4 hours", "1 hour", ["pid"])
    return to_micros(jobs.run_available(rows, name="sessions", close=close))


@query(
    "stream_histogram",
    "R8",
    """SELECT event_type, CASE WHEN floor(value * 100) < 1 THEN 0 ELSE CAST(floor(log2(floor(value * 100))) AS BIGINT) END bucket, count(*) n
       FROM events GROUP BY ALL""",
)
def stream_histogram(t: Tables) -> DataFrame:
    rows = jobs.live_histogram(sized_events(t), "size", "event_type")
    return jobs.latest(jobs.run_available(rows, "update", "histogram"), ["event_type", "bucket"])


TIMEOUT = 48 * 3_600_000_000_000

PAIR_SQL = f"""
e AS (SELECT user_id tid, epoch_us(ts) * 1000 ns, event_type = 'view' st FROM events WHERE event_type IN ('view', 'purchase')),
l AS (SELECT *, lead(ns) OVER w nns, lead(st) OVER w nst FROM e WINDOW w AS (PARTITION BY tid ORDER BY ns, st)),
x AS (SELECT (max(ns) // 1000000) - 3600000 mark FROM e)
"""


@query(
    "stream_pairs",
    "R5 R6 J6",
    PAIR_SQL
    + f"""SELECT tid, CASE WHEN nns IS NULL AND (ns + {TIMEOUT}) // 1000000 > mark THEN 'open' WHEN nns IS NULL OR nns - ns > {TIMEOUT} THEN 'expired' ELSE 'paired' END outcome,
         ns start_ns, CASE WHEN nns - ns <= {TIMEOUT} THEN nns END end_ns FROM l, x WHERE st AND (nns IS NULL OR nns - ns > {TIMEOUT} OR NOT nst)""",
)
def stream_pairs(t: Tables) -> DataFrame:
    """Starts and ends paired per thread; starts older than two days have expired, those left at the end are open."""
    rows = sized_events(t).filter("event_type IN ('view', 'purchase')")
    rows, close = jobs.closable(rows.withColumn("is_start", F.col("event_type") == "view"), "time")
    emitted = jobs.run_available(jobs.paired(rows, ["tid"], "time", "1 hour", TIMEOUT), name="pairs", close=close)
    return emitted.select("tid", "outcome", "start_ns", "end_ns")


CAP = 6

CAP_SQL = f"""
e AS (SELECT user_id tid, user_id % 4 queue, epoch_us(ts) * 1000 ns, event_type = 'view' st FROM events WHERE event_type IN ('view', 'purchase')),
o AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ns, st, tid) k FROM e),
l AS (SELECT *, lead(ns) OVER w nns, lead(st) OVER w nst, lead(k) OVER w nk, max(ns) OVER (PARTITION BY queue) top FROM o WINDOW w AS (PARTITION BY tid ORDER BY k)),
x AS (SELECT (max(ns) // 1000000) - 3600000 mark FROM e),
z AS (SELECT r.queue, r.k, row_number() OVER (PARTITION BY r.queue, s.k ORDER BY r.k DESC) age FROM l r JOIN l s ON r.queue = s.queue AND r.st AND s.st
      AND r.k <= s.k AND (r.nk IS NULL OR r.nk > s.k) AND s.ns - r.ns <= {TIMEOUT}),
v AS (SELECT DISTINCT queue, k FROM z WHERE age > {CAP}),
c AS (SELECT l.queue, tid, CASE WHEN v.k IS NOT NULL THEN 'evicted' WHEN nns - ns <= {TIMEOUT} AND NOT nst THEN 'paired' WHEN nns - ns <= {TIMEOUT} THEN 'replaced'
             WHEN nns IS NULL AND ns + {TIMEOUT} >= top AND (ns + {TIMEOUT}) // 1000000 >= mark THEN 'open' ELSE 'expired' END outcome,
             ns start_ns, nns FROM l LEFT JOIN v ON l.queue = v.queue AND l.k = v.k, x WHERE st),
r AS (SELECT queue, tid, outcome, start_ns, CASE WHEN outcome = 'paired' THEN nns END end_ns FROM c WHERE outcome <> 'replaced')
"""


def _bounded(t: Tables) -> DataFrame:
    rows = sized_events(t).filter("event_type IN ('view', 'purchase')").withColumn("queue", F.col("tid") % 4)
    rows, close = jobs.closable(rows.withColumn("is_start", F.col("event_type") == "view"), "time")
    pairs = jobs.bounded_pairs(rows, "queue", "tid", "time", "1 hour", TIMEOUT, CAP)
    return jobs.run_available(pairs, name="bounded", close=close, conf=jobs.ROCKSDB).drop("batch")


@query("stream_bounded_pairs", "R6", CAP_SQL + "SELECT queue, tid, outcome, start_ns, end_ns FROM r")
def stream_bounded_pairs(t: Tables) -> DataFrame:
    """Pairs of four queues that may each have six open starts; the oldest ones beyond that are evicted."""
    return _bounded(t)


@query("stream_pair_counters", "R6 R11", CAP_SQL + "SELECT queue, outcome, count(*) n FROM r GROUP BY queue, outcome")
def stream_pair_counters(t: Tables) -> DataFrame:
    """How many starts were paired, expired, evicted or left open, by queue."""
    return _bounded(t).groupBy("queue", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _touches(t: Tables) -> tuple[DataFrame, Callable[[], None]]:
    rows = stream(t, "events", EVENTS)
    addr = F.col("event_id") * 104729 % 209715200
    touches = rows.select(int_div(addr, 1048576).alias("block"), (F.col("event_id") % 50).alias("sample"))
    return jobs.closable(jobs.with_sample_time(touches), jobs.SAMPLE_TIME)


@query(
    "stream_block_heat",
    "R7 W15",
    HEAT_SQL + "SELECT block, points, last_sample FROM hd",
    "touch",
)
def stream_block_heat(t: Tables) -> DataFrame:
    touches, close = _touches(t)
    emitted = jobs.run_available(jobs.block_heat(touches, decay=2, cap=36, lateness=50), "update", "heat", close)
    return jobs.latest(emitted, ["block"])


@query(
    "stream_block_frequency",
    "R7 W16",
    FREQUENCY_SQL + "SELECT block, points, last_sample FROM hd",
    "touch",
)
def stream_block_frequency(t: Tables) -> DataFrame:
    """The moving-sum frequency of the same touches as a stream."""
    touches, close = _touches(t)
    emitted = jobs.run_available(jobs.block_frequency(touches, window=20, lateness=50), "update", "frequency", close)
    return jobs.latest(emitted, ["block"])


@query(
    "stream_tracked_processes",
    "R9 F7",
    """WITH RECURSIVE ed AS (SELECT p_partkey ts, p_partkey // 3 % 150 parent, p_partkey % 150 child FROM part),
      pe AS MATERIALIZED (SELECT e.ts, e.parent, e.child, coalesce(b.ts, -1) born FROM ed e ASOF LEFT JOIN ed b ON b.child = e.parent AND e.ts > b.ts),
      tr AS (SELECT CAST(0 AS BIGINT) pid, CAST(-1 AS BIGINT) birth_ns, CAST(0 AS BIGINT) depth
             UNION ALL SELECT child, ts, depth + 1 FROM tr JOIN pe ON pe.parent = tr.pid AND pe.born = tr.birth_ns)
      SELECT pid, birth_ns, depth FROM tr""",
)
def stream_tracked_processes(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    edges = stream(t, "part", PARTS)
    edges = edges.select((int_div(key, 3) % 150).alias("parent_pid"), (key % 150).alias("child_pid"), key.alias("ts_ns"))
    return jobs.tracked_processes(edges, [0]).select("pid", "birth_ns", "depth")


@query(
    "wall_clock_times",
    "R12 M10",
    """a AS (SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 1000 mono, epoch_us(ts) * 1000 + event_id real FROM events WHERE event_type = 'error')
      SELECT s.event_id, s.ts_ns + real - mono wall_ns FROM sysev s ASOF LEFT JOIN a ON s.ts_ns >= a.mono""",
    "sysev",
)
def wall_clock_times(t: Tables) -> DataFrame:
    """Monotonic times turned into wall-clock times by drifting anchors."""
    us = micros(F.col("ts"))
    anchors = t.events.filter("event_type = 'error'").select(
        ((us - t.epoch_us) * 1000).alias("monotonic_ns"),
        (us * 1000 + F.col("event_id")).alias("realtime_ns"),
    )
    return jobs.wall_clock(t.sysev, anchors).select("event_id", "wall_ns")
