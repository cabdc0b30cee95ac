"""Read amplification queries over fault, cache and device events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions import scalar as S
from iotrail.operators import readamp as A
from iotrail.operators.scan import RunningSum, Scan
from iotrail.plans.blocks import r6, rounded
from iotrail.plans.objects import DAY
from iotrail.plans.registry import Tables, micros, query
from iotrail.session import pin


def faults(t: Tables) -> DataFrame:
    """Fault entries and exits of every line; some are retried, fail or never end."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    qty = F.col("l_quantity").cast("long")
    flags = F.lit(0x40) + F.when(qty % 3 == 0, 1).otherwise(0) + F.when(qty % 17 == 0, 0x100).otherwise(0)
    ret = F.when(qty % 11 == 0, 0x2).when(qty % 4 == 0, 0x4).when(qty % 5 == 0, 0x400).otherwise(0)
    base = t.lineitem.select(
        (F.col("l_suppkey") % 10).alias("tgid"),
        k.alias("tid"),
        n.alias("page"),
        (F.col("l_suppkey") % 3).alias("dev"),
        F.col("l_partkey").alias("ino"),
        (n * 8 + qty % 8).alias("pgoff"),
        flags.cast("long").alias("flags"),
        ret.cast("long").alias("ret"),
        (micros(F.col("l_shipdate")) * 1000).alias("ts_ns"),
        qty.alias("qty"),
    )
    enter = base.withColumn("phase", F.lit("enter"))
    done = base.filter("qty % 13 <> 0").withColumns(
        {"phase": F.lit("exit"), "ts_ns": F.col("ts_ns") + 1000}
    )
    return enter.unionByName(done)


FAULT_SQL = """
fb AS (SELECT l_suppkey % 10 tgid, l_orderkey tid, CAST(l_linenumber AS BIGINT) page, l_suppkey % 3 dev, l_partkey ino, CAST(l_quantity AS BIGINT) qty,
              l_linenumber * 8 + CAST(l_quantity AS BIGINT) % 8 pgoff, epoch_us(l_shipdate) * 1000 ts_ns FROM lineitem),
fe AS (SELECT *, 0 ph, qty % 17 <> 0 followed FROM fb UNION ALL SELECT * REPLACE (ts_ns + 1000 AS ts_ns), 1, true FROM fb WHERE qty % 13 <> 0),
ff AS (SELECT * FROM fe WHERE followed),
fl AS (SELECT *, lag(ph) OVER (PARTITION BY tid, page ORDER BY ts_ns, ph, ino, qty, tgid, dev) p FROM ff),
fk AS (SELECT * FROM fl WHERE ph = 1 OR p IS NULL OR p = 1),
fp AS (SELECT *, lag(ph) OVER w p2, lag(dev) OVER w d2, lag(ino) OVER w i2, lag(pgoff) OVER w g2, lag(qty) OVER w q2 FROM fk
       WINDOW w AS (PARTITION BY tid, page ORDER BY ts_ns, ph, ino, qty, tgid, dev)),
fc AS (SELECT tgid, d2 dev, i2 ino, g2 pgoff, q2 % 3 = 0 wr, qty % 4 = 0 OR qty % 5 = 0 major, qty % 5 = 0 AND qty % 4 <> 0 retried
       FROM fp WHERE ph = 1 AND p2 = 0 AND qty % 11 <> 0)
"""


def _completed(t: Tables) -> DataFrame:
    return A.completed_faults(faults(t), ["ts_ns", "phase", "ino", "qty", "tgid", "dev"])


@query(
    "fault_stats",
    "J26 A40 P28 M23",
    FAULT_SQL
    + """SELECT tgid, dev, ino, count(*) faults, count(*) FILTER (major) major, count(*) FILTER (NOT major) minor, count(*) FILTER (wr) writes,
         count(*) FILTER (retried) retries, count(*) * 4096 fault_bytes, count(*) FILTER (major) * 4096 major_bytes FROM fc GROUP BY ALL""",
)
def fault_stats(t: Tables) -> DataFrame:
    return A.fault_stats(_completed(t))


def inserts(t: Tables) -> DataFrame:
    return t.lineitem.select(
        (F.col("l_suppkey") % 3).alias("dev"),
        F.col("l_partkey").alias("ino"),
        (F.col("l_quantity").cast("long") % 6).alias("order"),
    )


FILL_SQL = """
fi AS (SELECT l_suppkey % 3 dev, l_partkey ino, CAST(sum(1 << (CAST(l_quantity AS BIGINT) % 6)) AS BIGINT) fill_pages FROM lineitem GROUP BY ALL)
"""


@query("cache_fills", "A42", FILL_SQL + "SELECT *, fill_pages * 4096 fill_bytes FROM fi")
def cache_fills(t: Tables) -> DataFrame:
    return A.cache_fills(inserts(t))


@query(
    "call_intent",
    "A43 M23",
    """SELECT l_suppkey % 3 dev, l_partkey ino, l_returnflag = 'N' is_write, count(*) calls, CAST(sum(CAST(l_quantity AS BIGINT) * 700) AS BIGINT) bytes,
       min(CAST(l_quantity AS BIGINT) * 700) min_bytes, CAST(sum(CAST(l_quantity AS BIGINT) * 700) // count(*) AS BIGINT) avg_bytes,
       max(CAST(l_quantity AS BIGINT) * 700) max_bytes FROM lineitem GROUP BY ALL""",
)
def call_intent(t: Tables) -> DataFrame:
    calls = t.lineitem.select(
        (F.col("l_suppkey") % 3).alias("dev"),
        F.col("l_partkey").alias("ino"),
        (F.col("l_returnflag") == "N").alias("is_write"),
        (F.col("l_quantity").cast("long") * 700).alias("bytes"),
    )
    return A.call_intent(calls)


def direct(t: Tables) -> DataFrame:
    qty = F.col("l_quantity").cast("long")
    return t.lineitem.select(
        (F.col("l_suppkey") % 3).alias("dev"),
        F.col("l_partkey").alias("ino"),
        (F.col("l_linenumber").cast("long") * 5000).alias("pos"),
        (qty * 900).alias("count"),
        F.when(qty % 9 == 0, -5).otherwise(qty * 900).alias("ret"),
    )


DIRECT_SQL = """
dr AS (SELECT l_suppkey % 3 dev, l_partkey ino, l_linenumber * 5000 pos, CAST(l_quantity AS BIGINT) * 900 cnt,
              CASE WHEN CAST(l_quantity AS BIGINT) % 9 = 0 THEN -5 ELSE CAST(l_quantity AS BIGINT) * 900 END ret FROM lineitem)
"""


@query(
    "direct_io",
    "A44",
    DIRECT_SQL
    + """SELECT dev, ino, count(*) dio_calls, CAST(sum(ret) AS BIGINT) dio_bytes, round(avg(ret), 6) avg_bytes FROM dr WHERE ret > 0 GROUP BY ALL""",
)
def direct_io(t: Tables) -> DataFrame:
    return rounded(A.direct_io(direct(t)))


def requests(t: Tables) -> DataFrame:
    flag = F.when(F.col("is_read"), "RA").when(F.col("is_write"), "WS").otherwise("D")
    return t.req.select(
        (F.col("sector") % 5).alias("dev"), flag.alias("rwbs"), "sector", (F.col("nblocks") * 512).alias("bytes")
    )


def geometry(t: Tables) -> DataFrame:
    """Queue limits of the five devices, from the nations of region number."""
    key = F.col("r_regionkey").cast("long")
    limits = t.region.select(
        key.alias("dev"),
        F.when(key == 1, 16384).when(key == 2, 0).otherwise(512).alias("min_io"),
        F.when(key == 3, 4096).otherwise(512).alias("phys"),
        (key != 4).alias("is_nvme"),
    )
    unit = S.geometry_unit(F.col("min_io"), F.col("phys"), F.col("is_nvme"))
    return limits.select("dev", *[c.alias(n) for n, c in unit.items()])


REQUEST_SQL = """
rq AS (SELECT sector % 5 dev, CASE WHEN is_read THEN 'RA' WHEN is_write THEN 'WS' ELSE 'D' END rwbs, sector, nblocks * 512 bytes FROM req),
ge AS (SELECT CAST(r_regionkey AS BIGINT) dev, CASE r_regionkey WHEN 1 THEN 16384 WHEN 4 THEN 512 WHEN 3 THEN 512 ELSE 4096 END iu FROM region),
rw AS (SELECT rq.*, iu, rwbs = 'WS' is_write, ((sector * 512 + bytes - 1) // iu - sector * 512 // iu + 1) * iu iub
       FROM rq LEFT JOIN ge USING (dev) WHERE rwbs <> 'D')
"""


@query(
    "device_io",
    "A45 P25 P26",
    REQUEST_SQL
    + """SELECT dev, is_write, count(*) ios, CAST(sum(bytes) AS BIGINT) bytes, min(bytes) min_bytes, CAST(sum(bytes) // count(*) AS BIGINT) avg_bytes,
         max(bytes) max_bytes, round(sum(iub) / sum(bytes), 9) iu_amplification, round(count(*) FILTER (bytes < iu) * 100 / count(*), 9) sub_iu_pct
         FROM rw GROUP BY ALL""",
    "req",
)
def device_io(t: Tables) -> DataFrame:
    return rounded(A.device_io(requests(t), geometry(t)), 9)


@query(
    "device_io_histogram",
    "A45 P15",
    REQUEST_SQL
    + "SELECT dev, is_write, CAST(least(floor(log2(bytes // 512)), 11) AS BIGINT) bucket, count(*) n FROM rw GROUP BY ALL",
    "req",
)
def device_io_histogram(t: Tables) -> DataFrame:
    return A.device_io_histogram(requests(t))


def ahead(t: Tables) -> DataFrame:
    return t.lineitem.select(
        (F.col("l_suppkey") % 3).alias("dev"),
        F.col("l_partkey").alias("ino"),
        (F.col("l_quantity").cast("long") - 5).alias("nr_pages"),
    )


AHEAD_SQL = """
ra AS (SELECT l_suppkey % 3 dev, l_partkey ino, CAST(sum(greatest(CAST(l_quantity AS BIGINT) - 5, 0)) AS BIGINT) prepared_pages, count(*) ra_calls
       FROM lineitem GROUP BY ALL)
"""


@query("readahead_prepared", "A46", AHEAD_SQL + "SELECT * FROM ra")
def readahead_prepared(t: Tables) -> DataFrame:
    return A.readahead(ahead(t))


FOOT_SQL = (
    FAULT_SQL
    + ", "
    + DIRECT_SQL
    + """, pg AS (SELECT dev, ino, unnest(range(pos // 4096, (pos + cnt + 4095) // 4096)) page FROM dr UNION SELECT dev, ino, pgoff FROM fc),
 fo AS (SELECT dev, ino, count(*) unique_pages, count(*) * 4096 footprint_bytes FROM pg GROUP BY ALL)
"""
)


@query("page_footprint", "A47 X18", FOOT_SQL + "SELECT * FROM fo")
def page_footprint(t: Tables) -> DataFrame:
    return A.footprint(_completed(t), direct(t))


@query(
    "amplification_ladder",
    "A48 A46",
    FOOT_SQL
    + ", "
    + FILL_SQL
    + ", "
    + AHEAD_SQL
    + """, dm AS (SELECT dev, ino, count(*) * 4096 fault_bytes FROM fc GROUP BY ALL),
 us AS (SELECT l_suppkey % 3 dev, l_partkey ino, CAST(sum(CAST(l_quantity AS BIGINT) * 100) AS BIGINT) useful FROM lineitem GROUP BY ALL)
 SELECT fi.dev, fi.ino, round(fill_pages * 4096 / useful, 9) ra_signal, round(fill_pages * 4096 / footprint_bytes, 9) actual_over_footprint,
        round(footprint_bytes / useful, 9) footprint_over_useful, fill_pages * 4096 - coalesce(fault_bytes, 0) overfetch_bytes,
        prepared_pages * 4096 - coalesce(fault_bytes, 0) prepared_overfetch_bytes
 FROM fi LEFT JOIN dm USING (dev, ino) LEFT JOIN fo USING (dev, ino) LEFT JOIN ra USING (dev, ino) LEFT JOIN us USING (dev, ino)""",
)
def amplification_ladder(t: Tables) -> DataFrame:
    done = pin(_completed(t))  # read twice
    useful = A.direct_io(
        t.lineitem.select(
            (F.col("l_suppkey") % 3).alias("dev"),
            F.col("l_partkey").alias("ino"),
            (F.col("l_quantity").cast("long") * 100).alias("ret"),
        )
    ).select("dev", "ino", F.col("dio_bytes").alias("useful_bytes"))
    ladder = A.amplification_ladder(
        A.fault_stats(done), A.cache_fills(inserts(t)), A.footprint(done, direct(t)), A.readahead(ahead(t)), useful
    )
    return rounded(ladder, 9)


MARK_SQL = f"""
mc AS (SELECT ts_start_ns // {30 * DAY} b, count(*) c FROM obj GROUP BY b),
mk AS (SELECT b * {30 * DAY} mono_ns, CAST(sum(c) OVER (ORDER BY b) * 100000 AS BIGINT) signal_bytes FROM mc)
"""


def markers(t: Tables) -> DataFrame:
    counts = t.obj.groupBy(S.int_div(F.col("ts_start_ns"), 30 * DAY).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    rows = Scan(counts, [], ["b"]).add(RunningSum("s", F.col("c"))).df
    return rows.select((F.col("b") * (30 * DAY)).alias("mono_ns"), (F.col("s") * 100000).alias("signal_bytes"))


@query(
    "intent_against_device",
    "J20 F5 W21",
    MARK_SQL
    + """, lim AS (SELECT min(mono_ns) lo, max(mono_ns) hi FROM mk),
      rd AS (SELECT *, sum(bytes) OVER (ORDER BY ts_ns, user_data, slba, bytes ROWS UNBOUNDED PRECEDING) device_bytes
             FROM (SELECT cmd.* FROM cmd, lim WHERE op_name = 'read' AND ts_ns BETWEEN lo AND hi)),
      a AS (SELECT rd.*, m.mono_ns m0, m.signal_bytes s0 FROM rd ASOF JOIN mk m ON rd.ts_ns >= m.mono_ns),
      b AS (SELECT a.*, m.mono_ns m1, m.signal_bytes s1 FROM a ASOF JOIN mk m ON a.ts_ns <= m.mono_ns)
      SELECT ts_ns, CAST(device_bytes AS BIGINT) device_bytes,
             round(s0 + (s1 - s0) * coalesce((ts_ns - m0) / nullif(m1 - m0, 0), 0), 3) useful_bytes FROM b""",
    "obj cmd",
)
def intent_against_device(t: Tables) -> DataFrame:
    reads = t.cmd.filter("op_name = 'read'")
    rows = A.intent_against_device(reads, markers(t), ["user_data", "slba", "bytes"])
    return rows.select("ts_ns", "device_bytes", r6(F.col("useful_bytes"), 3).alias("useful_bytes"))


@query(
    "running_amplification",
    "W21 J20",
    MARK_SQL + "SELECT mono_ns, round((signal_bytes * 3 + mono_ns % 1000003) / signal_bytes, 9) amplification FROM mk WHERE signal_bytes > 0",
    "obj",
)
def running_amplification(t: Tables) -> DataFrame:
    read = F.col("signal_bytes") * 3 + F.col("mono_ns") % 1000003
    rows = A.running_amplification(markers(t).withColumn("store_bytes", read))
    return rows.select("mono_ns", r6(F.col("amplification"), 9).alias("amplification"))
