"""Block-layer queries: pairing, latency, depth, sizes, address heat, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions import scalar as S
from iotrail.functions.stats import cdf, quantiles
from iotrail.operators import blocks as B
from iotrail.operators import series
from iotrail.operators.pairing import (
    consuming_pairs,
    latency_long,
    lifecycles,
    sequence_then_address,
)
from iotrail.operators.scan import Clamped, RunningSum, Scan
from iotrail.plans.registry import Tables, query
from iotrail.session import pin

LBS = 512
BUCKET_NS = 21_600_000_000_000
BUCKET_S = BUCKET_NS / 1e9
MIB = 1048576.0
IU, NPWG, AWUN = 8, 16, 32
# A power of two keeps bin widths, and so the split bytes, exact.
ADDRESS_BINS = 128


def r6(column, digits: int = 6):
    return F.round(column, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating-point column, so that engines agree on the last digits."""
    return df.select(
        *[
            r6(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else f.name
            for f in df.schema.fields
        ]
    )


LIFE_SQL = """
e AS (SELECT * FROM blk WHERE action IN ('Q', 'D', 'C')),
a AS (SELECT *, sum(CASE action WHEN 'Q' THEN 1 WHEN 'C' THEN -1 ELSE 0 END) OVER w s FROM e
      WINDOW w AS (PARTITION BY sector, nblocks ORDER BY ts_ns, cpu, seq ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, s + greatest(0, max(CASE action WHEN 'C' THEN 0 ELSE 1 END - s) OVER w) l FROM a
      WINDOW w AS (PARTITION BY sector, nblocks ORDER BY ts_ns, cpu, seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, coalesce(lag(l) OVER (PARTITION BY sector, nblocks ORDER BY ts_ns, cpu, seq), 0) b0 FROM m),
i AS (SELECT *, action = 'Q' OR (action = 'D' AND b0 = 0) push,
             sum(CASE WHEN action = 'Q' OR (action = 'D' AND b0 = 0) THEN 1 ELSE 0 END) OVER w pu,
             sum(CASE WHEN action = 'C' AND b0 > 0 THEN 1 ELSE 0 END) OVER w po FROM b
      WINDOW w AS (PARTITION BY sector, nblocks ORDER BY ts_ns, cpu, seq ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, CASE WHEN action = 'Q' THEN pu WHEN action = 'D' THEN po + 1 WHEN b0 > 0 THEN po END item FROM i),
g AS (SELECT sector, nblocks, CAST(item AS BIGINT) item,
             bool_or(push AND rwbs LIKE '%R%') is_read,
             max(ts_ns) FILTER (action = 'Q') queue_ns, max(ts_ns) FILTER (action = 'D') issue_ns,
             max(ts_ns) FILTER (action = 'C') complete_ns
      FROM k WHERE item IS NOT NULL GROUP BY ALL),
life AS (SELECT *, (complete_ns - queue_ns) / 1000.0 q2c_us, (complete_ns - issue_ns) / 1000.0 d2c_us,
                (issue_ns - queue_ns) / 1000.0 q2d_us FROM g WHERE complete_ns IS NOT NULL),
lat AS (SELECT is_read, unnest(['q2c', 'd2c', 'q2d']) kind, unnest([q2c_us, d2c_us, q2d_us]) us FROM life),
latp AS (SELECT * FROM lat WHERE us > 0)
"""

PARAMS = f"p AS (SELECT max(ts_ns) span, greatest(1, (max(ts_ns) + {BUCKET_NS} - 1) // {BUCKET_NS}) n FROM blk)"


@query(
    "block_lifecycles",
    "J1 M1 M2 F1",
    LIFE_SQL
    + """SELECT sector, nblocks, item, is_read, queue_ns, issue_ns, complete_ns,
        round(q2c_us, 3) q2c_us, round(d2c_us, 3) d2c_us, round(q2d_us, 3) q2d_us FROM life""",
    "blk",
)
def block_lifecycles(t: Tables) -> DataFrame:
    return rounded(lifecycles(t.blk).drop("major", "minor"), 3)


LAT_POINTS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


@query(
    "block_latency_distributions",
    "A16 A17 F2",
    LIFE_SQL
    + """SELECT kind, is_read, count(*) n, """
    + ", ".join(f"round(quantile_cont(us, {q}), 3) {n}" for n, q in LAT_POINTS.items())
    + ", round(min(us), 3) min_us, round(max(us), 3) max_us FROM latp GROUP BY ALL",
    "blk",
)
def block_latency_distributions(t: Tables) -> DataFrame:
    rows = latency_long(lifecycles(t.blk))
    points = {**LAT_POINTS, "min_us": 0.0, "max_us": 1.0}
    return rounded(quantiles(rows, ["kind", "is_read"], "us", points), 3)


@query(
    "block_latency_over_time",
    "A18",
    LIFE_SQL
    + f""", {PARAMS}, x AS (SELECT is_read, coalesce(nullif(d2c_us, 0), q2c_us) us,
             coalesce(issue_ns, queue_ns) t FROM life),
      y AS (SELECT least(t // {BUCKET_NS}, n - 1) bucket, is_read, us FROM x, p WHERE us > 0),
      s AS (SELECT unnest(range(n)) bucket FROM p)
      SELECT s.bucket, round(coalesce(quantile_cont(us, 0.5) FILTER (is_read), 0), 3) p50_read,
             round(coalesce(quantile_cont(us, 0.99) FILTER (is_read), 0), 3) p99_read,
             round(coalesce(quantile_cont(us, 0.5) FILTER (NOT is_read), 0), 3) p50_write,
             round(coalesce(quantile_cont(us, 0.99) FILTER (NOT is_read), 0), 3) p99_write
      FROM s LEFT JOIN y USING (bucket) GROUP BY s.bucket""",
    "blk",
)
def block_latency_over_time(t: Tables) -> DataFrame:
    n = series.bucket_count(t.blk_span_ns, BUCKET_NS)
    us = F.coalesce(F.nullif(F.col("d2c_us"), F.lit(0.0)), F.col("q2c_us"))
    start = F.coalesce("issue_ns", "queue_ns")
    rows = lifecycles(t.blk).select(
        S.time_bucket(start, 0, BUCKET_NS, n).alias("bucket"), "is_read", us.alias("us")
    )
    both = quantiles(rows.filter("us > 0"), ["bucket", "is_read"], "us", {"p50": 0.5, "p99": 0.99})
    sides = {"read": F.col("is_read"), "write": ~F.col("is_read")}
    columns = [
        F.max(F.when(side, F.col(p))).alias(f"{p}_{name}")
        for name, side in sides.items()
        for p in ("p50", "p99")
    ]
    wide = both.groupBy("bucket").agg(*columns)
    return rounded(series.dense(wide, n, dict.fromkeys(wide.columns[1:], 0.0)), 3)


@query(
    "block_latency_cdf",
    "D10",
    LIFE_SQL
    + """SELECT DISTINCT kind, us, round(cume_dist() OVER (PARTITION BY kind ORDER BY us), 9) share
         FROM latp""",
    "blk",
)
def block_latency_cdf(t: Tables) -> DataFrame:
    rows = latency_long(lifecycles(t.blk))
    return cdf(rows, ["kind"], "us").select("kind", "us", r6(F.col("share"), 9).alias("share"))


@query(
    "block_latency_density",
    "D11",
    LIFE_SQL
    + """, c AS (SELECT quantile_cont(us, 0.995) hi, min(us) lo FROM latp WHERE kind = 'q2c'),
      v AS (SELECT us, lo, hi, CAST(least(floor((us - lo) / (hi - lo) * 100), 99) AS BIGINT) bin
            FROM latp, c WHERE kind = 'q2c' AND us <= hi),
      n AS (SELECT count(*) n FROM v)
      SELECT bin, count(*) n, round(count(*) / (any_value(n.n) * (any_value(hi) - any_value(lo)) / 100), 12) density
      FROM v, n GROUP BY bin""",
    "blk",
)
def block_latency_density(t: Tables) -> DataFrame:
    rows = pin(latency_long(lifecycles(t.blk)).filter("kind = 'q2c'"))
    low, high = quantiles(rows, [], "us", {"lo": 0.0, "hi": 0.995}).select("lo", "hi").first()
    inside = rows.filter(F.col("us") <= high)
    n = inside.count()
    spot = S.closed_bin(F.col("us"), low, high, 100)
    bins = inside.groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.withColumn("density", r6(F.col("n") / F.lit(n * (high - low) / 100), 12))


@query(
    "block_latency_summary",
    "A1 A7",
    LIFE_SQL
    + """SELECT kind, is_read, count(*) n, round(min(us), 3) min_us, round(quantile_cont(us, 0.5), 3) p50, round(quantile_cont(us, 0.95), 3) p95,
         round(quantile_cont(us, 0.99), 3) p99, round(max(us), 3) max_us FROM latp GROUP BY kind, is_read""",
    "blk",
)
def block_latency_summary(t: Tables) -> DataFrame:
    """Queue, dispatch and total latency of either direction."""
    points = {"min_us": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "max_us": 1.0}
    return rounded(quantiles(latency_long(lifecycles(t.blk)), ["kind", "is_read"], "us", points), 3)


@query(
    "block_latency_log2_histogram",
    "A9 M7",
    LIFE_SQL
    + """, h AS (SELECT is_read, CAST(length(bin(complete_ns - queue_ns)) - 1 AS BIGINT) bucket, count(*) n FROM life WHERE complete_ns > queue_ns GROUP BY ALL)
      SELECT is_read, bucket, n, CAST(n * (1 << bucket) AS BIGINT) approx_ns,
             round(sum(n) OVER (PARTITION BY is_read ORDER BY bucket) * 100 / sum(n) OVER (PARTITION BY is_read), 6) cumulative_pct FROM h""",
    "blk",
)
def block_latency_log2_histogram(t: Tables) -> DataFrame:
    """Latencies in nanoseconds; every request with a latency is in a bucket."""
    rows = lifecycles(t.blk).withColumn("ns", F.col("complete_ns") - F.col("queue_ns")).filter("ns > 0")
    return rounded(B.log2_histogram(rows, "ns", "is_read", cap=62).withColumnRenamed("approx_bytes", "approx_ns"))


@query(
    "block_trace_summary",
    "A1 W4",
    LIFE_SQL
    + f""", d AS (SELECT *, rwbs LIKE '%R%' rd FROM blk),
      lq AS (SELECT kind, is_read, us FROM latp)
      SELECT (SELECT max(ts_ns) / 1e9 FROM blk) duration_s, count(*) events,
             count(*) FILTER (action = 'Q' AND rd) reads,
             count(*) FILTER (action = 'Q' AND NOT rd) writes,
             (SELECT count(*) FROM life) completed,
             round(count(*) FILTER (action = 'C') / (max(ts_ns) / 1e9), 9) iops,
             round(sum(nblocks * {LBS}) FILTER (action = 'C') / (max(ts_ns) / 1e9) / {MIB}, 9) mbps,
             CAST(min(nblocks * {LBS}) FILTER (action = 'Q') AS DOUBLE) min_size,
             quantile_cont(nblocks * {LBS}, 0.5) FILTER (action = 'Q') median_size,
             CAST(max(nblocks * {LBS}) FILTER (action = 'Q') AS DOUBLE) max_size,
             (SELECT round(quantile_cont(us, 0.5), 3) FROM lq WHERE kind = 'q2c') q2c_p50,
             (SELECT round(quantile_cont(us, 0.99), 3) FROM lq WHERE kind = 'q2c') q2c_p99,
             (SELECT round(quantile_cont(us, 0.5), 3) FROM lq WHERE kind = 'd2c') d2c_p50,
             (SELECT round(quantile_cont(us, 0.99), 3) FROM lq WHERE kind = 'd2c') d2c_p99
      FROM d""",
    "blk",
)
def block_trace_summary(t: Tables) -> DataFrame:
    blk, action = t.blk, F.col("action")
    reads, span_s = S.is_read(F.col("rwbs")), F.max("ts_ns") / 1e9
    size = F.col("nblocks") * LBS
    head = blk.agg(
        span_s.alias("duration_s"),
        F.count(F.lit(1)).alias("events"),
        B.count_if((action == "Q") & reads).alias("reads"),
        B.count_if((action == "Q") & ~reads).alias("writes"),
        r6(B.count_if(action == "C") / span_s, 9).alias("iops"),
        r6(F.sum(F.when(action == "C", size)) / span_s / MIB, 9).alias("mbps"),
    )
    sizes = blk.filter(action == "Q").select(size.cast("double").alias("size"))
    sizes = quantiles(sizes, [], "size", {"min_size": 0.0, "median_size": 0.5, "max_size": 1.0})
    life = pin(lifecycles(t.blk))
    lat = quantiles(latency_long(life), ["kind"], "us", {"p50": 0.5, "p99": 0.99})
    wide = lat.agg(
        *[
            r6(F.max(F.when(F.col("kind") == k, F.col(p))), 3).alias(f"{k}_{p}")
            for k in ("q2c", "d2c")
            for p in ("p50", "p99")
        ]
    )
    rest = {**sizes.drop("n").first().asDict(), **wide.first().asDict(), "completed": life.count()}
    return head.withColumns({name: F.lit(value) for name, value in rest.items()})


@query(
    "block_throughput_iops",
    "A2 A3 P17",
    f"""{PARAMS}, s AS (SELECT unnest(range(n)) bucket FROM p),
      c AS (SELECT least(ts_ns // {BUCKET_NS}, n - 1) bucket, rwbs LIKE '%R%' rd, nblocks * {LBS} b
            FROM blk, p WHERE action = 'C')
      SELECT s.bucket, round(coalesce(sum(b) FILTER (rd), 0) / {BUCKET_S} / {MIB}, 12) read_mbps,
             round(coalesce(sum(b) FILTER (NOT rd), 0) / {BUCKET_S} / {MIB}, 12) write_mbps,
             round(count(*) FILTER (rd) / {BUCKET_S}, 9) read_iops,
             round(count(*) FILTER (NOT rd) / {BUCKET_S}, 9) write_iops
      FROM s LEFT JOIN c USING (bucket) GROUP BY s.bucket""",
    "blk",
)
def block_throughput_iops(t: Tables) -> DataFrame:
    done = t.blk.filter("action = 'C'")
    reads, size = S.is_read(F.col("rwbs")), F.col("nblocks") * LBS
    n = series.bucket_count(t.blk_span_ns, BUCKET_NS)
    mb = {
        side: r6(F.coalesce(F.sum(F.when(cond, size)), F.lit(0)) / BUCKET_S / MIB, 12)
        for side, cond in (("read", reads), ("write", ~reads))
    }
    rows = series.bucketed(
        done,
        "ts_ns",
        0,
        t.blk_span_ns,
        BUCKET_NS,
        read_mbps=mb["read"],
        write_mbps=mb["write"],
        read_iops=r6(B.count_if(reads) / BUCKET_S, 9),
        write_iops=r6(B.count_if(~reads) / BUCKET_S, 9),
    )
    return series.dense(rows, n, dict.fromkeys(rows.columns[1:], 0.0))


@query(
    "block_arrival_series",
    "A4 A5 A6",
    f"""{PARAMS}, s AS (SELECT unnest(range(n)) bucket FROM p),
      c AS (SELECT least(ts_ns // {BUCKET_NS}, n - 1) bucket, rwbs LIKE '%R%' rd, rwbs LIKE '%W%' wr,
                   nblocks * {LBS} b FROM blk, p WHERE action = 'Q' AND nblocks > 0),
      g AS (SELECT s.bucket, count(b) n, count(*) FILTER (rd) r, count(*) FILTER (NOT rd AND wr) w,
                   CAST(coalesce(sum(b), 0) AS BIGINT) bytes
            FROM s LEFT JOIN c USING (bucket) GROUP BY s.bucket)
      SELECT bucket, round(r / {BUCKET_S}, 9) read_rate, round(w / {BUCKET_S}, 9) write_rate,
             CAST(sum(n) OVER o AS BIGINT) cum_count, CAST(sum(bytes) OVER o AS BIGINT) cum_bytes,
             round(coalesce(r / nullif(r + w, 0), 0.5), 9) read_ratio
      FROM g WINDOW o AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)""",
    "blk",
)
def block_arrival_series(t: Tables) -> DataFrame:
    queued = t.blk.filter("action = 'Q' AND nblocks > 0")
    reads = S.is_read(F.col("rwbs"))
    writes = ~reads & S.is_write(F.col("rwbs"))
    rows = series.bucketed(
        queued,
        "ts_ns",
        0,
        t.blk_span_ns,
        BUCKET_NS,
        n=F.count(F.lit(1)),
        r=B.count_if(reads),
        w=B.count_if(writes),
        bytes=F.sum(F.col("nblocks") * LBS),
    )
    full = series.dense(
        rows, series.bucket_count(t.blk_span_ns, BUCKET_NS), {"n": 0, "r": 0, "w": 0, "bytes": 0}
    )
    scan = Scan(full, [], ["bucket"])
    scan.add(RunningSum("cum_count", F.col("n")), RunningSum("cum_bytes", F.col("bytes")))
    ratio = F.coalesce(F.try_divide("r", F.col("r") + F.col("w")), F.lit(0.5))
    return scan.df.select(
        "bucket",
        r6(F.col("r") / BUCKET_S, 9).alias("read_rate"),
        r6(F.col("w") / BUCKET_S, 9).alias("write_rate"),
        "cum_count",
        "cum_bytes",
        r6(ratio, 9).alias("read_ratio"),
    )


QD_SQL = """
d AS (SELECT *, CASE action WHEN 'D' THEN 1 ELSE -1 END dl, rwbs LIKE '%R%' is_read FROM blk
      WHERE action IN ('D', 'C')),
a AS (SELECT *, sum(dl) OVER w s, sum(CASE WHEN is_read THEN dl ELSE 0 END) OVER w sr,
             sum(CASE WHEN is_read THEN 0 ELSE dl END) OVER w sw FROM d
      WINDOW w AS (ORDER BY ts_ns, dl, is_read, cpu, seq ROWS UNBOUNDED PRECEDING)),
q AS (SELECT seq, ts_ns, CAST(s - least(0, min(s) OVER w) AS BIGINT) qd,
             CAST(sr - least(0, min(sr) OVER w) AS BIGINT) qd_read,
             CAST(sw - least(0, min(sw) OVER w) AS BIGINT) qd_write FROM a
      WINDOW w AS (ORDER BY ts_ns, dl, is_read, cpu, seq ROWS UNBOUNDED PRECEDING))
"""


@query("block_queue_depth", "W1", QD_SQL + "SELECT * FROM q", "blk")
def block_queue_depth(t: Tables) -> DataFrame:
    return series.queue_depth(t.blk).select("seq", "ts_ns", "qd", "qd_read", "qd_write")


@query(
    "block_depth_summary",
    "A1 A60",
    QD_SQL
    + """SELECT max(qd) max_qd, round(avg(qd), 9) mean_qd, quantile_cont(qd, 0.5) p50, quantile_cont(qd, 0.9) p90, quantile_cont(qd, 0.99) p99,
         round(quantile_cont(qd, 0.999), 6) p999 FROM q""",
    "blk",
)
def block_depth_summary(t: Tables) -> DataFrame:
    """Queue depth after every event: mean, largest and quantiles."""
    depth = pin(series.queue_depth(t.blk).select("qd"))
    points = quantiles(depth.select(F.col("qd").cast("double").alias("qd")), [], "qd", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}).drop("n")
    head = depth.agg(F.max("qd").alias("max_qd"), r6(F.avg("qd"), 9).alias("mean_qd"))
    return head.withColumns({name: r6(F.lit(value)) for name, value in points.first().asDict().items()})


@query(
    "block_queue_depth_series",
    "W2",
    QD_SQL
    + f""", {PARAMS}, s AS (SELECT unnest(range(n)) bucket FROM p)
      SELECT s.bucket, round(coalesce(avg(qd), 0), 6) qd, round(coalesce(avg(qd_read), 0), 6) qd_read,
             round(coalesce(avg(qd_write), 0), 6) qd_write
      FROM s LEFT JOIN q ON q.ts_ns // {BUCKET_NS} = s.bucket GROUP BY s.bucket""",
    "blk",
)
def block_queue_depth_series(t: Tables) -> DataFrame:
    depth = series.queue_depth(t.blk)
    at = S.int_div(F.col("ts_ns"), BUCKET_NS).alias("bucket")
    names = ("qd", "qd_read", "qd_write")
    means = depth.groupBy(at).agg(*[r6(F.avg(n)).alias(n) for n in names])
    n = series.bucket_count(t.blk_span_ns, BUCKET_NS)
    return series.dense(means, n, dict.fromkeys(names, 0.0))


@query(
    "block_queue_depth_stats",
    "W4",
    QD_SQL
    + """SELECT count(*) n, round(quantile_cont(qd, 0.5), 6) p50, round(quantile_cont(qd, 0.9), 6) p90,
         round(quantile_cont(qd, 0.99), 6) p99, round(quantile_cont(qd, 0.999), 6) p999 FROM q""",
    "blk",
)
def block_queue_depth_stats(t: Tables) -> DataFrame:
    depth = series.queue_depth(t.blk).select(F.col("qd").cast("double").alias("qd"))
    return rounded(quantiles(depth, [], "qd", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}))


@query(
    "block_queue_depth_histogram",
    "W4",
    QD_SQL
    + """SELECT qd, count(*) n, round(sum(count(*)) OVER (ORDER BY qd) / sum(count(*)) OVER (), 9) share
         FROM q GROUP BY qd""",
    "blk",
)
def block_queue_depth_histogram(t: Tables) -> DataFrame:
    rows = cdf(series.queue_depth(t.blk), [], "qd")
    return rows.select("qd", F.col("n_here").alias("n"), r6(F.col("share"), 9).alias("share"))


@query(
    "block_submitted_in_flight",
    "W3 W18",
    """d AS (SELECT *, CASE action WHEN 'Q' THEN 1 ELSE -1 END dl FROM blk WHERE action IN ('Q', 'C')),
      a AS (SELECT *, sum(dl) OVER (ORDER BY ts_ns, cpu, seq ROWS UNBOUNDED PRECEDING) s,
                   sum(CASE WHEN action = 'Q' THEN 1 ELSE 0 END)
                     OVER (ORDER BY ts_ns, cpu, seq ROWS UNBOUNDED PRECEDING) qn FROM d),
      f AS (SELECT *, CAST(s - least(0, min(s) OVER (ORDER BY ts_ns, cpu, seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) inflight
            FROM a)
      SELECT seq, ts_ns, inflight FROM f WHERE action = 'Q' AND qn % 4 = 0""",
    "blk",
)
def block_submitted_in_flight(t: Tables) -> DataFrame:
    """Requests submitted and not completed, sampled at every fourth submission."""
    action = F.col("action")
    events = t.blk.filter(action.isin("Q", "C"))
    queued = action == "Q"
    scan = Scan(events, [], ["ts_ns", "cpu", "seq"]).add(
        Clamped("inflight", F.when(queued, 1).otherwise(-1)),
        RunningSum("queued", F.when(queued, 1).otherwise(0)),
    )
    return scan.df.filter(queued & (F.col("queued") % 4 == 0)).select("seq", "ts_ns", "inflight")


@query(
    "block_pairs_by_number_or_address",
    "J2 P2",
    """u AS (SELECT *, seq % 1000 num FROM blk WHERE action IN ('Q', 'C')),
      a AS (SELECT *, lag(action) OVER w la, lag(ts_ns) OVER w lt, lag(rwbs) OVER w lr, lag(sector) OVER w ls
            FROM u WINDOW w AS (PARTITION BY num ORDER BY ts_ns, cpu, seq)),
      h AS (SELECT *, coalesce(action = 'C' AND la = 'Q', false) hit FROM a),
      k AS (SELECT *, CASE WHEN hit THEN ls ELSE sector END addr_key FROM h),
      b AS (SELECT *, lag(action) OVER w oa, lag(ts_ns) OVER w ot, lag(rwbs) OVER w orw FROM k
            WINDOW w AS (PARTITION BY addr_key ORDER BY ts_ns, cpu, seq)),
      z AS (SELECT *, NOT hit AND coalesce(oa = 'Q', false) addr FROM b WHERE action = 'C')
      SELECT seq, CASE WHEN hit THEN 'seq' WHEN addr THEN 'address' ELSE 'none' END matched,
             CASE WHEN CASE WHEN hit THEN lr WHEN addr THEN orw ELSE rwbs END LIKE '%R%' THEN 'R' ELSE 'W' END rw,
             round((ts_ns - CASE WHEN hit THEN lt WHEN addr THEN ot END) / 1e6, 6) lat_ms FROM z""",
    "blk",
)
def block_pairs_by_number_or_address(t: Tables) -> DataFrame:
    numbered = t.blk.withColumn("num", F.col("seq") % 1000)
    rows = sequence_then_address(numbered, seq="num")
    rw = S.rw_class(F.col("rwbs")).alias("rw")
    return rows.select("seq", "matched", rw, r6(F.col("lat_ms")).alias("lat_ms"))


@query(
    "block_issue_complete_pairs",
    "J3 R5",
    """d AS (SELECT * FROM blk WHERE action IN ('D', 'C')),
      a AS (SELECT *, lag(action) OVER w la, lag(ts_ns) OVER w lt FROM d
            WINDOW w AS (PARTITION BY sector, nblocks ORDER BY ts_ns, cpu, seq))
      SELECT seq, sector, nblocks, lt start_ts_ns, ts_ns, ts_ns - lt lat_ns FROM a
      WHERE action = 'C' AND la = 'D'""",
    "blk",
)
def block_issue_complete_pairs(t: Tables) -> DataFrame:
    events = t.blk.filter(F.col("action").isin("D", "C"))
    starts = F.col("action") == "D"
    pairs = consuming_pairs(events, ["sector", "nblocks"], ["ts_ns", "cpu", "seq"], starts, ["ts_ns"])
    lat = (F.col("ts_ns") - F.col("start_ts_ns")).alias("lat_ns")
    return pairs.select("seq", "sector", "nblocks", "start_ts_ns", "ts_ns", lat)


@query(
    "block_request_classes",
    "P1 P2 P3 P10 P14 P15 P16 P20 P13 P12 P11",
    f"""SELECT rwbs LIKE '%R%' is_read, rwbs LIKE '%W%' is_write,
         CASE WHEN rwbs LIKE '%R%' THEN 'R' WHEN rwbs LIKE '%W%' THEN 'W' ELSE 'O' END rw,
         CASE left(rwbs, 1) WHEN 'R' THEN 'read' WHEN 'W' THEN 'write' ELSE 'other' END op_class,
         nblocks * {LBS} size_bytes, CAST(floor(log2(nblocks * {LBS})) AS BIGINT) log2_size,
         CAST(least(floor(log2(nblocks)), 11) AS BIGINT) sector_log,
         CASE WHEN nblocks * 512 < 4096 THEN '<4K' WHEN nblocks * 512 < 65536 THEN '4K-64K' ELSE '64K-256K' END group4,
         CASE WHEN nblocks <= 8 THEN '<=4K' WHEN nblocks <= 32 THEN '4K-16K' ELSE '16K-128K' END group5,
         CAST(least(ceil(log2(nblocks * 512)), 14) AS BIGINT) ceiling_log2,
         CAST(floor(log2(nblocks)) AS BIGINT) coarse_bin, count(*) n
       FROM blk GROUP BY ALL""",
    "blk",
)
def block_request_classes(t: Tables) -> DataFrame:
    rwbs, size = F.col("rwbs"), F.col("nblocks") * LBS
    largest = t.blk.agg(F.max(size)).first()[0]
    rows = t.blk.select(
        S.is_read(rwbs).alias("is_read"),
        S.is_write(rwbs).alias("is_write"),
        S.rw_class(rwbs).alias("rw"),
        S.op_class(rwbs).alias("op_class"),
        size.alias("size_bytes"),
        S.floor_log2(size).alias("log2_size"),
        S.sector_log_bucket(size).alias("sector_log"),
        S.size_group4(size).alias("group4"),
        S.size_group5(size).alias("group5"),
        S.power_ceiling(size, largest).alias("ceiling_log2"),
        S.coarse_bin(size).alias("coarse_bin"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "block_address_heatmap",
    "A10 P18",
    f"""h AS (SELECT max(ts_ns) span, greatest(1, least(200, max(ts_ns) // {BUCKET_NS})) nt FROM blk),
      e AS (SELECT * FROM blk WHERE action IN ('Q', 'D') AND sector > 0),
      mx AS (SELECT max(sector) mx FROM e)
      SELECT CAST(least(floor(sector / (mx + 1) * 64), 63) AS BIGINT) si,
             CAST(least(floor(ts_ns / span * nt), nt - 1) AS BIGINT) ti, count(*) n,
             count(*) FILTER (rwbs LIKE '%R%') n_read,
             count(*) FILTER (rwbs NOT LIKE '%R%' AND rwbs LIKE '%W%') n_write
      FROM e, h, mx GROUP BY ALL""",
    "blk",
)
def block_address_heatmap(t: Tables) -> DataFrame:
    events = t.blk.filter("action IN ('Q', 'D') AND sector > 0")
    span, top = t.blk_span_ns, events.agg(F.max("sector")).first()[0]
    nt = max(1, min(200, span // BUCKET_NS))
    return B.heat_cells(events, span, top, nt, 64)


@query(
    "completion_heatmap_cut",
    "A10 P19",
    """e AS (SELECT * FROM blk WHERE action = 'C'),
      r AS (SELECT min(ts_ns) t0, max(ts_ns) t1, min(sector) s0, max(sector) s1 FROM e)
      SELECT CAST(greatest(least(ceil((ts_ns - t0) / ((t1 - t0) / 120)) - 1, 119), 0) AS BIGINT) ti,
             CAST(greatest(least(ceil((sector - s0) / ((s1 - s0) / 60)) - 1, 59), 0) AS BIGINT) si,
             CASE WHEN rwbs LIKE '%R%' THEN 'R' ELSE 'W' END rw, count(*) n
      FROM e, r GROUP BY ALL""",
    "blk",
)
def completion_heatmap_cut(t: Tables) -> DataFrame:
    done = t.blk.filter("action = 'C'")
    t0, t1, s0, s1 = done.agg(
        F.min("ts_ns"), F.max("ts_ns"), F.min("sector"), F.max("sector")
    ).first()
    return done.groupBy(
        S.right_closed_cut(F.col("ts_ns"), t0, t1, 120).alias("ti"),
        S.right_closed_cut(F.col("sector"), s0, s1, 60).alias("si"),
        S.rw_class(F.col("rwbs")).alias("rw"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "block_address_histogram",
    "A11",
    """e AS (SELECT * FROM blk WHERE action = 'Q' AND sector > 0), m AS (SELECT max(sector) mx FROM e)
      SELECT CAST(least(floor(sector / mx * 50), 49) AS BIGINT) bin,
             count(*) FILTER (rwbs LIKE '%R%') reads, count(*) FILTER (rwbs NOT LIKE '%R%') writes
      FROM e, m GROUP BY ALL""",
    "blk",
)
def block_address_histogram(t: Tables) -> DataFrame:
    queued = t.blk.filter("action = 'Q' AND sector > 0")
    top = queued.agg(F.max("sector")).first()[0]
    reads = S.is_read(F.col("rwbs"))
    at = S.scaled_bin(F.col("sector"), top, 50).alias("bin")
    return queued.groupBy(at).agg(B.count_if(reads).alias("reads"), B.count_if(~reads).alias("writes"))


EXTENT_SQL = f"""
ends AS (SELECT *, sector + nblocks e FROM req),
md AS (SELECT quantile_cont(e, 0.5) med FROM ends),
lim AS (SELECT max(e) FILTER (e <= med * 8) / 128 w FROM ends, md),
pl AS (SELECT ends.*, w, CAST(greatest(least(floor(sector / w), 127), 0) AS BIGINT) f,
              CAST(greatest(least(ceil(e / w) - 1, 127), 0) AS BIGINT) l FROM ends, lim),
un AS (SELECT *, unnest(range(f, l + 1)) bin FROM pl),
ov AS (SELECT *, least(e, (bin + 1) * w) - greatest(sector, bin * w) ov FROM un),
bb AS (SELECT *, CASE WHEN f = l THEN nblocks ELSE ov END * {LBS} bytes FROM ov WHERE f = l OR ov > 0),
bins AS (SELECT bin, count(*) io_count, round(sum(bytes), 1) total_bytes,
                round(coalesce(sum(bytes) FILTER (is_write), 0), 1) write_bytes,
                round(coalesce(sum(bytes) FILTER (NOT is_write), 0), 1) read_bytes,
                count(*) FILTER (is_write) write_count, count(*) FILTER (NOT is_write) read_count
         FROM bb GROUP BY bin)
"""


@query(
    "address_extent_bins",
    "A12 A14 X5",
    EXTENT_SQL + "SELECT *, round(write_bytes / nullif(total_bytes, 0), 4) write_fraction FROM bins",
    "req",
)
def address_extent_bins(t: Tables) -> DataFrame:
    return _extent_bins(t).withColumn("write_fraction", r6(F.col("write_fraction"), 4))


def _extent_bins(t: Tables) -> DataFrame:
    placed = series.extent_bins(t.req, ADDRESS_BINS, LBS, series.robust_limit(t.req))
    bins = B.address_bins(placed)
    return bins.withColumns({c: r6(F.col(c), 1) for c in ("total_bytes", "write_bytes", "read_bytes")})


@query(
    "address_start_bins",
    "A12",
    EXTENT_SQL
    + f"""SELECT f bin, count(*) io_count, CAST(sum(nblocks) * {LBS} AS BIGINT) total_bytes
         FROM pl GROUP BY f""",
    "req",
)
def address_start_bins(t: Tables) -> DataFrame:
    width = series.robust_limit(t.req) / ADDRESS_BINS
    at = F.greatest(F.least(F.floor(F.col("sector") / width), F.lit(ADDRESS_BINS - 1)), F.lit(0)).cast("long")
    return t.req.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("io_count"), F.sum(F.col("nblocks") * LBS).alias("total_bytes")
    )


@query(
    "address_extent_lost_bytes",
    "X5",
    EXTENT_SQL
    + f"""SELECT round((SELECT CAST(sum(nblocks) * {LBS} AS DOUBLE) FROM req) - sum(bytes), 0) + 0.0 lost_bytes
         FROM bb""",
    "req",
)
def address_extent_lost_bytes(t: Tables) -> DataFrame:
    placed = series.extent_bins(t.req, ADDRESS_BINS, LBS, series.robust_limit(t.req))
    total = t.req.agg(F.sum(F.col("nblocks") * LBS)).first()[0]
    return placed.agg((F.round(F.lit(float(total)) - F.sum("bin_bytes"), 0) + 0.0).alias("lost_bytes"))


@query(
    "hot_address_views",
    "A13 K1 T4",
    EXTENT_SQL
    + """, c AS (SELECT *, row_number() OVER (ORDER BY io_count DESC, bin) rank FROM bins QUALIFY rank <= 15),
      b AS (SELECT *, row_number() OVER (ORDER BY total_bytes DESC, bin) rank FROM bins QUALIFY rank <= 15),
      x AS (SELECT c.* EXCLUDE (rank), row_number() OVER (ORDER BY write_bytes DESC, bin) rank FROM c),
      u AS (SELECT 'count' AS view, * FROM c UNION ALL SELECT 'bytes', * FROM b
            UNION ALL SELECT 'count_by_write_bytes', * FROM x)
      SELECT view, rank, bin, io_count, total_bytes, write_bytes, read_bytes, write_count, read_count,
             round(read_bytes * 100 / greatest(total_bytes, 1), 4) read_pct,
             round(100 - read_bytes * 100 / greatest(total_bytes, 1), 4) write_pct FROM u""",
    "req",
)
def hot_address_views(t: Tables) -> DataFrame:
    views = B.hot_views(_extent_bins(t).drop("write_fraction"), 15)
    return views.withColumns(
        {
            "rank": F.col("rank").cast("long"),
            "read_pct": r6(F.col("read_pct"), 4),
            "write_pct": r6(F.col("write_pct"), 4),
        }
    )


@query(
    "request_size_distribution",
    "A8 P12",
    f"""SELECT CASE WHEN nblocks >= 1 THEN CAST(least(floor(log2(nblocks)), 11) AS BIGINT) END size_bin,
         is_read, count(*) n, round(sum(nblocks * {LBS}) / {MIB}, 6) mib,
         round(avg(nblocks * {LBS}), 6) mean_size
       FROM req GROUP BY ALL""",
    "req",
)
def request_size_distribution(t: Tables) -> DataFrame:
    return rounded(B.size_histogram(t.req, LBS))


@query(
    "request_log2_histogram",
    "A9 M7",
    f"""h AS (SELECT is_read, CAST(floor(log2(nblocks * {LBS})) AS BIGINT) bucket, count(*) n
            FROM req GROUP BY ALL)
      SELECT is_read, bucket, n, CAST(n * (1 << bucket) AS BIGINT) approx_bytes,
             round(sum(n) OVER (PARTITION BY is_read ORDER BY bucket) * 100
                   / sum(n) OVER (PARTITION BY is_read), 6) cumulative_pct FROM h""",
    "req",
)
def request_log2_histogram(t: Tables) -> DataFrame:
    sized = t.req.withColumn("size", F.col("nblocks") * LBS)
    return rounded(B.log2_histogram(sized, "size", "is_read"))


@query(
    "command_zone_histogram",
    "A15 P20",
    """z AS (SELECT least(slba * 8 // 1048576, 4095) zone, op_name, count(*) n FROM cmd GROUP BY ALL),
      a AS (SELECT zone, sum(n) s FROM z GROUP BY zone),
      k AS (SELECT zone, row_number() OVER (ORDER BY s DESC, zone) r FROM a)
      SELECT zone, op_name, n FROM z JOIN k USING (zone)
      WHERE r <= (SELECT greatest(8, least(64, count(*))) FROM a)""",
    "cmd",
)
def command_zone_histogram(t: Tables) -> DataFrame:
    zones = B.zones(t.cmd, F.col("slba") * 8, "op_name")
    totals = zones.groupBy("zone").agg(F.sum("n").alias("s"))
    active = totals.count()
    top = totals.orderBy(F.desc("s"), "zone").limit(max(8, min(64, active))).select("zone")
    return zones.join(F.broadcast(top), "zone", "left_semi")


def _align_sql(u: int, prefix: str) -> str:
    return (
        f"(sector + nblocks - 1) // {u} - sector // {u} {prefix}_crossings, "
        f"(sector + nblocks - 1) // {u} - sector // {u} + 1 {prefix}_touched"
    )


ALIGN_SQL = f"""
al AS (SELECT *, NOT is_read wr, {_align_sql(IU, 'iu')}, {_align_sql(NPWG, 'np')}, {_align_sql(AWUN, 'aw')},
              greatest(1, (nblocks + {IU} - 1) // {IU}) iu_ideal,
              sector % {IU} = 0 AND nblocks % {IU} = 0 iu_aligned,
              NOT is_read AND nblocks < {IU} sub_iu,
              nblocks % {NPWG} = 0 AND nblocks >= {NPWG} npsz, sector % {NPWG} = 0 npst FROM req),
am AS (SELECT *, iu_touched / iu_ideal waf, CASE WHEN wr THEN aw_crossings ELSE 0 END awc FROM al)
"""


def _aligned(t: Tables) -> DataFrame:
    return B.alignment(t.req, IU, NPWG, AWUN)


@query(
    "alignment_summary",
    "A19 A20 A21 P21 P22 P23 M3 M4",
    ALIGN_SQL
    + """SELECT count(*) FILTER (wr) writes, count(*) FILTER (is_read) reads,
       count(*) FILTER (sub_iu) sub_iu, round(count(*) FILTER (sub_iu) * 100 / count(*) FILTER (wr), 6) sub_iu_pct,
       count(*) FILTER (wr AND iu_aligned) aligned_writes, count(*) FILTER (is_read AND iu_aligned) aligned_reads,
       count(*) FILTER (wr AND iu_crossings > 0) crossing_writes,
       round(avg(waf) FILTER (wr), 6) mean_waf, round(max(waf) FILTER (wr), 6) max_waf,
       count(*) FILTER (wr AND NOT iu_aligned) misaligned_writes,
       round(avg(waf) FILTER (wr AND NOT iu_aligned), 6) misaligned_mean_waf,
       count(*) FILTER (wr AND npsz AND npst) npwg_full, count(*) FILTER (wr AND npsz AND NOT npst) npwg_size_only,
       count(*) FILTER (wr AND NOT npsz) npwg_unaligned, count(*) FILTER (wr AND awc = 0) atomic_safe,
       count(*) FILTER (wr AND awc > 0) atomic_unsafe, max(awc) awun_max_crossings FROM am""",
    "req",
)
def alignment_summary(t: Tables) -> DataFrame:
    return rounded(B.alignment_summary(_aligned(t)))


@query(
    "alignment_histograms",
    "A22 A23 P24",
    ALIGN_SQL
    + f"""SELECT 'iu_bin' AS kind, is_read, CASE WHEN nblocks < {IU} THEN 0
            WHEN nblocks / {IU} <= 16 THEN nblocks // {IU} ELSE 17 END AS value, count(*) n FROM am GROUP BY ALL
       UNION ALL SELECT 'iu_crossings', is_read, least(iu_crossings, 21), count(*) FROM am GROUP BY ALL
       UNION ALL SELECT 'npwg_units', is_read, least(np_touched, 33), count(*) FROM am GROUP BY ALL
       UNION ALL SELECT 'awun_crossings', is_read, least(awc, 17), count(*) FROM am GROUP BY ALL""",
    "req",
)
def alignment_histograms(t: Tables) -> DataFrame:
    """All four histograms from one pass; the last bin of each holds all that is larger."""
    ends = {"iu_bin": 17, "iu_crossings": 21, "npwg_units": 33, "awun_crossings": 17}
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.least(F.col(k), F.lit(e)).alias("value")) for k, e in ends.items()])
    rows = _aligned(t).select("is_read", F.explode(entries).alias("h"))
    return rows.groupBy("h.kind", "is_read", "h.value").agg(F.count(F.lit(1)).alias("n"))


REQ_BUCKET_US = 30 * 86_400_000_000


@query(
    "alignment_over_time",
    "A24 A26",
    ALIGN_SQL
    + f""", p AS (SELECT min(ts_us) t0, greatest(1, (max(ts_us) - min(ts_us) + {REQ_BUCKET_US} - 1) // {REQ_BUCKET_US}) n FROM req),
      s AS (SELECT unnest(range(n)) bucket FROM p),
      w AS (SELECT least((ts_us - t0) // {REQ_BUCKET_US}, n - 1) bucket, * FROM am, p WHERE wr)
      SELECT s.bucket, round(coalesce(sum(iu_touched) / sum(iu_ideal), 1), 6) waf,
             count(*) FILTER (sub_iu) sub_iu,
             round(count(*) FILTER (awc = 0) / {REQ_BUCKET_US / 1e6}, 9) safe_rate,
             round(count(*) FILTER (awc > 0) / {REQ_BUCKET_US / 1e6}, 9) unsafe_rate
      FROM s LEFT JOIN w USING (bucket) GROUP BY s.bucket""",
    "req",
)
def alignment_over_time(t: Tables) -> DataFrame:
    t0, t1 = t.req.agg(F.min("ts_us"), F.max("ts_us")).first()
    seconds = REQ_BUCKET_US / 1e6
    rows = series.bucketed(
        _aligned(t).filter(~F.col("is_read")),
        "ts_us",
        t0,
        t1 - t0,
        REQ_BUCKET_US,
        waf=r6(F.sum("iu_touched") / F.sum("iu_ideal")),
        sub_iu=B.count_if(F.col("sub_iu")),
        safe_rate=r6(B.count_if(F.col("awun_safe")) / seconds, 9),
        unsafe_rate=r6(B.count_if(~F.col("awun_safe")) / seconds, 9),
    )
    n = series.bucket_count(t1 - t0, REQ_BUCKET_US)
    return series.dense(rows, n, {"waf": 1.0, "sub_iu": 0, "safe_rate": 0.0, "unsafe_rate": 0.0})


@query(
    "sizes_by_granularity_alignment",
    "A27",
    ALIGN_SQL + "SELECT npsz AND npst aligned, nblocks, count(*) n FROM am WHERE wr GROUP BY ALL",
    "req",
)
def sizes_by_granularity_alignment(t: Tables) -> DataFrame:
    aligned = (F.col("npwg_size_aligned") & F.col("npwg_start_aligned")).alias("aligned")
    writes = _aligned(t).filter(~F.col("is_read"))
    return writes.groupBy(aligned, "nblocks").agg(F.count(F.lit(1)).alias("n"))


@query(
    "latency_by_alignment",
    "J13 A25",
    LIFE_SQL
    + f""", x AS (SELECT sector % {IU} = 0 AND nblocks % {IU} = 0 ok, nblocks < {IU} sub, d2c_us us
                 FROM life WHERE NOT is_read AND d2c_us > 0),
      y AS (SELECT CASE WHEN ok THEN 'aligned' ELSE 'misaligned' END AS class, us FROM x
            UNION ALL SELECT 'sub_iu', us FROM x WHERE sub)
      SELECT class, count(*) n, round(quantile_cont(us, 0.5), 3) p50, round(quantile_cont(us, 0.95), 3) p95,
             round(quantile_cont(us, 0.99), 3) p99, round(max(us), 3) max_us FROM y GROUP BY class""",
    "blk",
)
def latency_by_alignment(t: Tables) -> DataFrame:
    """Alignment depends on the pairing key alone, so no join is needed."""
    done = lifecycles(t.blk).filter(~F.col("is_read") & (F.col("d2c_us") > 0))
    unit = S.unit_metrics(F.col("sector"), F.col("nblocks"), IU)
    classes = F.array_compact(
        F.array(
            F.when(unit["aligned"], "aligned").otherwise("misaligned"),
            F.when(unit["sub_unit"], "sub_iu"),
        )
    )
    rows = done.select(F.explode(classes).alias("class"), F.col("d2c_us").alias("us"))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "max_us": 1.0}
    return rounded(quantiles(rows, ["class"], "us", points), 3)


@query(
    "completion_dashboard",
    "A7 T9 M5",
    f"""c AS (SELECT ts_ns // {BUCKET_NS} bkt, CASE WHEN rwbs LIKE '%R%' THEN 'R' ELSE 'W' END rw, nblocks * {LBS} b
            FROM blk WHERE action = 'C'),
      g AS (SELECT bkt, rw, count(*) n, CAST(sum(b) AS BIGINT) bytes FROM c GROUP BY ALL)
      SELECT rw, CAST(sum(n) AS BIGINT) total, CAST(sum(bytes) AS BIGINT) bytes,
             round(max(n) / {BUCKET_S}, 9) peak_iops, arg_max(bkt, n * 1000000 - bkt) peak_bucket,
             round(max(bytes) / {BUCKET_S} / {MIB}, 12) peak_mbps FROM g GROUP BY rw""",
    "blk",
)
def completion_dashboard(t: Tables) -> DataFrame:
    done = t.blk.filter("action = 'C'")
    rows = done.groupBy(
        S.int_div(F.col("ts_ns"), BUCKET_NS).alias("bkt"), S.rw_class(F.col("rwbs")).alias("rw")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("nblocks") * LBS).alias("bytes"))
    return rows.groupBy("rw").agg(
        F.sum("n").alias("total"),
        F.sum("bytes").alias("bytes"),
        r6(F.max("n") / BUCKET_S, 9).alias("peak_iops"),
        F.max_by("bkt", F.struct(F.col("n"), -F.col("bkt"))).alias("peak_bucket"),
        r6(F.max("bytes") / BUCKET_S / MIB, 12).alias("peak_mbps"),
    )


@query(
    "completion_buckets",
    "A7 T9 M5",
    f"""SELECT ts_ns // {BUCKET_NS} bkt, CASE WHEN rwbs LIKE '%R%' THEN 'R' ELSE 'W' END rw, count(*) n, CAST(sum(nblocks * {LBS}) AS BIGINT) bytes,
        round(count(*) / {BUCKET_S}, 9) iops, round(sum(nblocks * {LBS}) / {BUCKET_S} / {MIB}, 12) mbps FROM blk WHERE action = 'C' GROUP BY ALL""",
    "blk",
)
def completion_buckets(t: Tables) -> DataFrame:
    """Completions, bytes and rates of every bucket and direction."""
    bucket, rw = S.int_div(F.col("ts_ns"), BUCKET_NS).alias("bkt"), S.rw_class(F.col("rwbs")).alias("rw")
    n, size = F.count(F.lit(1)), F.sum(F.col("nblocks") * LBS)
    rates = (r6(n / BUCKET_S, 9).alias("iops"), r6(size / BUCKET_S / MIB, 12).alias("mbps"))
    return t.blk.filter("action = 'C'").groupBy(bucket, rw).agg(n.alias("n"), size.alias("bytes"), *rates)


@query(
    "completion_sample",
    "T8",
    """SELECT seq, ts_ns, sector, nblocks FROM blk WHERE action = 'C'
       ORDER BY md5(CAST(seq AS VARCHAR) || ':42'), seq LIMIT 500""",
    "blk",
)
def completion_sample(t: Tables) -> DataFrame:
    """A uniform sample of 500 completions that is the same on every run."""
    mark = F.md5(F.concat(F.col("seq").cast("string"), F.lit(":42")).cast("binary"))
    done = t.blk.filter("action = 'C'")
    return done.orderBy(mark, "seq").limit(500).select("seq", "ts_ns", "sector", "nblocks")
