"""Queries that tie device commands to application objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions import scalar as S
from iotrail.functions.stats import quantiles
from iotrail.operators import objects as O
from iotrail.operators import series
from iotrail.operators.blocks import count_if
from iotrail.operators.fold import assign_lanes
from iotrail.operators.pairing import latest_pairs
from iotrail.operators.scan import RunningSum, Scan, dealt
from iotrail.plans.blocks import r6, rounded
from iotrail.plans.registry import Tables, micros, query
from iotrail.session import pin

DAY = 86_400_000_000_000
TIE = ("user_data", "slba", "bytes", "op_name")
TIE_SQL = "user_data, slba, bytes, op_name"
LBA = 4096


def nearest(x: str, q: float) -> str:
    """Nearest-rank quantile in DuckDB."""
    n = f"count({x})"
    return f"(list({x} ORDER BY {x}) FILTER ({x} IS NOT NULL))[CAST(least({n}, floor({q} * {n}) + 1) AS BIGINT)]"


def completions(t: Tables) -> DataFrame:
    """Completions of the lines that have status O."""
    line = F.col("l_linenumber").cast("long")
    tag = (F.col("l_orderkey") + 1).cast("decimal(20,0)") * F.lit(4294967296)
    sent = (micros(F.col("l_shipdate")) + line) * 1000
    done = t.lineitem.filter("l_linestatus = 'O'")
    return done.select(
        (tag + line).cast("decimal(20,0)").alias("user_data"),
        (sent + (F.col("l_partkey") % 50 + 1) * DAY).alias("ts_ns"),
    )


CMP_SQL = f"""
cmp AS (SELECT CAST(l_orderkey + 1 AS HUGEINT) * 4294967296 + l_linenumber user_data,
               (epoch_us(l_shipdate) + l_linenumber) * 1000 + (l_partkey % 50 + 1) * {DAY} ts_ns
        FROM lineitem WHERE l_linestatus = 'O')
"""
PAIR_SQL = (
    CMP_SQL
    + f""", st AS (SELECT user_data, ts_ns, 0 side, slba, bytes, op_name, tid FROM cmd
             UNION ALL SELECT user_data, ts_ns, 1, NULL, NULL, NULL, NULL FROM cmp),
 st1 AS (SELECT *, sum(CASE side WHEN 0 THEN 1 ELSE -1 END) OVER w s FROM st
         WINDOW w AS (PARTITION BY user_data ORDER BY ts_ns, side, slba, bytes, op_name ROWS UNBOUNDED PRECEDING)),
 st2 AS (SELECT *, s + greatest(0, max(-s) OVER w) dep FROM st1
         WINDOW w AS (PARTITION BY user_data ORDER BY ts_ns, side, slba, bytes, op_name ROWS UNBOUNDED PRECEDING)),
 st3 AS (SELECT *, CASE side WHEN 0 THEN dep ELSE coalesce(lag(dep) OVER w, 0) END lev FROM st2
         WINDOW w AS (PARTITION BY user_data ORDER BY ts_ns, side, slba, bytes, op_name)),
 st4 AS (SELECT *, CASE WHEN lead(side) OVER w = 1 THEN lead(ts_ns) OVER w END c FROM st3 WHERE lev > 0
         WINDOW w AS (PARTITION BY user_data, lev ORDER BY ts_ns, side, slba, bytes, op_name)),
 paired AS (SELECT user_data, tid, op_name, slba, bytes, ts_ns, c - ts_ns dur_ns FROM st4 WHERE side = 0)
"""
)


def paired(t: Tables) -> DataFrame:
    return latest_pairs(t.cmd, completions(t), "user_data", "ts_ns", ["slba", "bytes", "op_name"])


@query("command_completion_pairs", "J7 P8 M9 M10", PAIR_SQL + "SELECT tid, op_name, slba, bytes, ts_ns, dur_ns FROM paired", "cmd")
def command_completion_pairs(t: Tables) -> DataFrame:
    return paired(t).select("tid", "op_name", "slba", "bytes", "ts_ns", "dur_ns")


@query(
    "replay_stream_latency",
    "A54",
    PAIR_SQL
    + """SELECT CASE tid % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'device' ELSE 'capture' END stream, count(*) n, round(quantile_cont(dur_ns / 1000, 0.5), 6) p50_us,
         round(quantile_cont(dur_ns / 1000, 0.99), 6) p99_us FROM paired WHERE dur_ns IS NOT NULL GROUP BY stream""",
    "cmd",
)
def replay_stream_latency(t: Tables) -> DataFrame:
    """Latency quantiles of each replay stream."""
    side = F.col("tid") % 5
    name = F.when(side == 0, "file").when(side == 1, "device").otherwise("capture")
    rows = paired(t).filter("dur_ns IS NOT NULL").select(name.alias("stream"), (F.col("dur_ns") / 1000).alias("us"))
    return rounded(quantiles(rows, ["stream"], "us", {"p50_us": 0.5, "p99_us": 0.99}))


@query(
    "command_shown_durations",
    "P33 P35 P36",
    PAIR_SQL
    + f""", r AS (SELECT *, CASE WHEN op_name = 'write' THEN 'writes' ELSE 'reads' END AS role FROM paired),
      n AS (SELECT *, lead(ts_ns) OVER (PARTITION BY role ORDER BY ts_ns, {TIE_SQL}) nx FROM r),
      b AS (SELECT min(ts_ns) base FROM cmd)
      SELECT role, count(*) n, count(dur_ns) n_real,
             round(CAST(sum(greatest(1, coalesce(dur_ns, coalesce(least(20000, CAST(floor((nx - ts_ns) * CAST(0.9 AS DOUBLE)) AS BIGINT)), 20000)))) AS DOUBLE) / 1e9, 3) shown_s,
             max(ts_ns - base) last_rel_ns FROM n, b GROUP BY role""",
    "cmd",
)
def command_shown_durations(t: Tables) -> DataFrame:
    base = t.cmd.agg(F.min("ts_ns")).first()[0]
    rows = O.durations(paired(t), TIE, 20_000)
    return rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("is_real")).alias("n_real"),
        r6(F.sum(F.col("shown_ns").cast("decimal(20,0)")).cast("double") / 1e9, 3).alias("shown_s"),
        F.max(F.col("ts_ns") - base).alias("last_rel_ns"),
    )


@query(
    "command_report",
    "A49 U1 K4",
    PAIR_SQL
    + f"""SELECT op_name, count(*) n, count(dur_ns) n_real, CAST(sum(bytes) AS BIGINT) bytes,
       max(ts_ns + coalesce(dur_ns, 0)) - min(ts_ns) wall_ns, round(count(dur_ns) / count(*), 9) real_cover,
       {nearest('dur_ns', 0.5)} p50, {nearest('dur_ns', 0.95)} p95, {nearest('dur_ns', 0.99)} p99,
       max(dur_ns) max_ns, round(sum(bytes) / (max(ts_ns + coalesce(dur_ns, 0)) - min(ts_ns)), 12) gbs
       FROM paired GROUP BY op_name""",
    "cmd",
)
def command_report(t: Tables) -> DataFrame:
    return O.command_report(paired(t)).withColumns({"real_cover": r6(F.col("real_cover"), 9), "gbs": r6(F.col("gbs"), 12)})


@query(
    "commands_by_tag",
    "J8 A41 F3 F11",
    """x AS (SELECT cmd.*, o.op, o.error FROM cmd LEFT JOIN obj o ON o.trace_id = cmd.tid)
       SELECT op, op_name, count(*) n, CAST(sum(bytes) AS BIGINT) bytes, count(DISTINCT tid) objects,
              count(*) FILTER (error IS NOT NULL) failed FROM x GROUP BY ALL""",
    "cmd obj",
)
def commands_by_tag(t: Tables) -> DataFrame:
    rows = O.by_tag(t.cmd, t.obj)
    return rows.groupBy(F.col("obj_op").alias("op"), "op_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("bytes").alias("bytes"),
        F.count_distinct("tid").alias("objects"),
        count_if(F.col("obj_error").isNotNull()).alias("failed"),
    )


@query(
    "device_totals_per_object",
    "A41",
    """SELECT tid, count(*) cmds, CAST(sum(bytes) AS BIGINT) bytes, count(DISTINCT bytes) sizes,
              min(ts_ns) first_ns, max(ts_ns) last_ns FROM cmd GROUP BY tid""",
    "cmd",
)
def device_totals_per_object(t: Tables) -> DataFrame:
    return O.device_totals(t.cmd)


KEYED_SQL = """
ko AS (SELECT 'obj-' || obj_key AS key, ts_ns FROM obj),
ids AS (SELECT key, row_number() OVER (ORDER BY min(ts_ns), lower(hex(encode(key)))) object_id FROM ko GROUP BY key),
kc AS (SELECT 'obj-' || l_partkey AS key FROM lineitem)
"""


@query(
    "commands_by_key",
    "J9",
    KEYED_SQL
    + """SELECT coalesce(object_id, 0) object_id, count(*) n FROM kc LEFT JOIN ids USING (key) GROUP BY ALL""",
    "obj",
)
def commands_by_key(t: Tables) -> DataFrame:
    records = t.obj.select(
        F.concat(F.lit("obj-"), F.col("obj_key")).alias("key"),
        F.lit(None).cast("string").alias("key_hex"),
        "ts_ns",
    )
    text = F.concat(F.lit("obj-"), F.col("l_partkey"))
    commands = t.lineitem.select(F.hex(F.encode(text, "UTF-8")).alias("key_hex"))
    return O.by_key(records, commands).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


EXTENT_SQL = f"""
ob AS (SELECT *, (trace_id - 1) // 2 * 2097152 lo FROM obj),
op AS (SELECT lo, lo + 4096 + (bytes + 4095) // 4096 * 4096 hi, ts_start_ns - 5000000 t0, ts_ns + 5000000 t1,
              ts_start_ns, trace_id, op FROM ob),
sl AS (SELECT lo, arg_min(hi, CAST(ts_start_ns AS HUGEINT) * 1000000 + trace_id) hi FROM op GROUP BY lo),
sn AS (SELECT *, lead(lo) OVER (ORDER BY lo) nxt FROM sl),
cm AS (SELECT *, row_number() OVER (ORDER BY user_data, ts_ns, slba, bytes, op_name) cid, slba * {LBA} off FROM cmd),
aj AS (SELECT cm.*, sn.lo, sn.hi, sn.nxt FROM cm ASOF LEFT JOIN sn ON cm.off >= sn.lo),
pl AS (SELECT *, CASE WHEN lo IS NULL OR off >= hi THEN 'unmatched' WHEN off + bytes > hi AND nxt < off + bytes THEN 'cross_object'
                      WHEN off + bytes > hi THEN 'gap_spill' ELSE 'inside' END place FROM aj),
hit AS (SELECT cid, arg_min(op.trace_id, (CASE WHEN (op.op = 'store' AND op_name = 'write') OR (op.op = 'load' AND op_name = 'read')
                 THEN 0 ELSE 1 END)::HUGEINT * 10000000000000000000000000000 + CAST(ts_start_ns AS HUGEINT) * 1000000 + op.trace_id) oid
        FROM pl JOIN op ON pl.lo = op.lo AND ts_ns BETWEEN t0 AND t1 WHERE place = 'inside' GROUP BY cid),
att AS (SELECT pl.*, oid obj_id, CASE WHEN place <> 'inside' THEN place WHEN oid IS NOT NULL THEN 'unique' ELSE 'unmatched' END AS match
        FROM pl LEFT JOIN hit USING (cid))
"""


def _extent(t: Tables) -> DataFrame:
    """Two operations share a slot, so both space and time decide."""
    obj = t.obj.withColumn("slot_offset", S.int_div(F.col("trace_id") - 1, 2) * 2097152)
    return O.by_extent(obj, t.cmd.drop("user_data"), ["ts_start_ns", "trace_id"], LBA)


@query(
    "commands_by_extent",
    "J10",
    EXTENT_SQL + "SELECT tid, slba, bytes, op_name, ts_ns, obj_id, match FROM att",
    "obj cmd",
)
def commands_by_extent(t: Tables) -> DataFrame:
    return _extent(t).select("tid", "slba", "bytes", "op_name", "ts_ns", "obj_id", "match")


@query(
    "extent_tag_parity",
    "J11",
    EXTENT_SQL
    + """SELECT count(*) FILTER (match = 'unique') "unique", count(*) FILTER (match = 'cross_object') cross_object,
       count(*) FILTER (match = 'gap_spill') gap_spill, count(*) FILTER (match = 'unmatched') unmatched,
       count(*) FILTER (tid <> 0) tagged, count(*) FILTER (match = 'unique' AND tid <> 0) ground_truth,
       count(*) FILTER (match = 'unique' AND obj_id = tid) agree, count(*) FILTER (match = 'unique' AND tid = 0) extent_only
       FROM att""",
    "obj cmd",
)
def extent_tag_parity(t: Tables) -> DataFrame:
    return O.parity(_extent(t))


OCC_SQL = f"""
oc AS (SELECT *, row_number() OVER (PARTITION BY obj_key ORDER BY ts_ns, trace_id) - 1 occ FROM obj),
ck AS (SELECT cmd.*, obj_key FROM cmd JOIN obj ON tid = trace_id),
en AS (SELECT obj_key, ts_ns end_ns, min(occ) occ FROM oc GROUP BY ALL),
fa AS (SELECT ck.*, en.occ FROM ck ASOF LEFT JOIN en ON ck.obj_key = en.obj_key AND ck.ts_ns <= en.end_ns),
la AS (SELECT obj_key, max(occ) lo FROM oc GROUP BY obj_key),
co AS (SELECT fa.* EXCLUDE (occ), coalesce(occ, lo) occ FROM fa JOIN la USING (obj_key)),
po AS (SELECT obj_key, occ, count(*) n_cmds, CAST(sum(bytes) AS BIGINT) cmd_bytes, min(ts_ns) first_cmd_ns, max(ts_ns) last_cmd_ns,
              first(slba ORDER BY ts_ns, {TIE_SQL}) first_slba, last(slba ORDER BY ts_ns, {TIE_SQL}) last_slba FROM co GROUP BY ALL),
sp AS (SELECT oc.obj_key, oc.occ, trace_id, op, error, bytes, n_cmds, cmd_bytes, first_slba, last_slba,
              least(ts_start_ns, coalesce(first_cmd_ns, ts_start_ns)) begin_ns, greatest(ts_ns, coalesce(last_cmd_ns, ts_ns)) end_ns,
              coalesce(last_cmd_ns > ts_ns, false) late FROM oc LEFT JOIN po USING (obj_key, occ))
"""


def _spans(t: Tables) -> DataFrame:
    occ = O.occurrences(t.obj, "obj_key", tie=["trace_id"])
    owner = t.obj.select(F.col("trace_id").alias("tid"), "obj_key")
    cmd = O.to_occurrence(t.cmd.join(owner, "tid"), occ, "obj_key")
    return O.object_spans(occ, cmd, "obj_key", ["ts_ns", *TIE])


@query(
    "object_spans",
    "J12 J24 W14 K7 M25",
    OCC_SQL
    + """SELECT obj_key, occ, trace_id, op, n_cmds, cmd_bytes, first_slba, last_slba, begin_ns, end_ns, late,
         n_cmds IS NOT NULL OR end_ns > begin_ns is_span FROM sp""",
    "obj cmd",
)
def object_spans(t: Tables) -> DataFrame:
    names = "obj_key occ trace_id op n_cmds cmd_bytes first_slba last_slba begin_ns end_ns late is_span"
    return _spans(t).select(*names.split())


@query(
    "objects_in_flight",
    "W5",
    OCC_SQL
    + """, ev AS (SELECT begin_ns ts, 1 d FROM sp UNION ALL SELECT end_ns, -1 FROM sp),
      g AS (SELECT ts, d, sum(d) delta FROM ev GROUP BY ALL)
      SELECT ts, CASE d WHEN -1 THEN 0 ELSE 1 END side, CAST(sum(delta) OVER (ORDER BY ts, d ROWS UNBOUNDED PRECEDING) AS BIGINT) open FROM g""",
    "obj cmd",
)
def objects_in_flight(t: Tables) -> DataFrame:
    return series.inflight(_spans(t), "begin_ns", "end_ns").select("ts", "side", "open")


@query(
    "objects_in_flight_overlap",
    "F4",
    OCC_SQL
    + f""", r AS (SELECT {nearest('begin_ns', 0.25)} lo, {nearest('begin_ns', 0.5)} hi FROM sp)
      SELECT trace_id, begin_ns, end_ns FROM sp, r WHERE end_ns >= lo AND begin_ns <= hi""",
    "obj cmd",
)
def objects_in_flight_overlap(t: Tables) -> DataFrame:
    """Spans that overlap the second quarter of the trace."""
    spans = pin(_spans(t).select("trace_id", "begin_ns", "end_ns"))  # read for the quantiles, too
    ranked = quantiles(spans, [], "begin_ns", {"a": 0.25, "b": 0.5}, nearest=True)
    low, high = ranked.select("a", "b").first()
    keep = (F.col("end_ns") >= low) & (F.col("begin_ns") <= high)
    return spans.filter(keep).select("trace_id", "begin_ns", "end_ns")


@query(
    "command_queue_depth_weighted",
    "W6",
    PAIR_SQL
    + """, ev AS (SELECT ts_ns ts, 1 d FROM paired WHERE dur_ns IS NOT NULL
             UNION ALL SELECT ts_ns + dur_ns, -1 FROM paired WHERE dur_ns IS NOT NULL),
      g AS (SELECT ts, d, sum(d) delta FROM ev GROUP BY ALL),
      s AS (SELECT ts, d, sum(delta) OVER (ORDER BY ts, d ROWS UNBOUNDED PRECEDING) lv,
                   coalesce(lead(ts) OVER (ORDER BY ts, d) - ts, 0) dt FROM g)
      SELECT round(sum(CAST(lv AS DOUBLE) * dt) / sum(dt), 6) mean_level, CAST(max(lv) AS BIGINT) max_level,
             round(sum(CASE WHEN lv <= 1 THEN dt ELSE 0 END) / sum(dt), 9) share_le1, CAST(sum(dt) AS BIGINT) span_ns FROM s""",
    "cmd",
)
def command_queue_depth_weighted(t: Tables) -> DataFrame:
    real = paired(t).filter("dur_ns IS NOT NULL")
    spans = real.select("ts_ns", (F.col("ts_ns") + F.col("dur_ns")).alias("end_ns"))
    levels = series.inflight(spans, "ts_ns", "end_ns")
    levels = levels.withColumn("open", F.col("open").cast("double"))
    rows = series.time_weighted(levels, "ts", "open")
    return rows.select(
        r6(F.col("mean_level")).alias("mean_level"),
        F.col("max_level").cast("long").alias("max_level"),
        r6(F.col("share_le1"), 9).alias("share_le1"),
        "span_ns",
    )


@query(
    "submission_gap_verdict",
    "W7",
    PAIR_SQL
    + f""", k AS (SELECT tid, CASE WHEN first(op_name ORDER BY ts_ns, {TIE_SQL}) = 'read' THEN 'load' ELSE 'store' END kind
             FROM cmd GROUP BY tid HAVING count(*) >= 4),
      gp AS (SELECT kind, ts_ns - lag(ts_ns) OVER (PARTITION BY tid ORDER BY ts_ns, {TIE_SQL}) gap_ns FROM cmd JOIN k USING (tid)),
      g AS (SELECT kind, count(gap_ns) n, {nearest('gap_ns', 0.5)} gap_p50, {nearest('gap_ns', 0.95)} gap_p95 FROM gp GROUP BY kind),
      s AS (SELECT CASE op_name WHEN 'read' THEN 'load' ELSE 'store' END kind, {nearest('dur_ns', 0.25)} service_p25
            FROM paired GROUP BY ALL)
      SELECT kind, n, gap_p50, gap_p95, service_p25,
             CASE WHEN gap_p50 >= 0.5 * service_p25 THEN 'serialized' ELSE 'pipelined' END verdict
      FROM g LEFT JOIN s USING (kind)""",
    "cmd",
)
def submission_gap_verdict(t: Tables) -> DataFrame:
    gaps = O.submission_gaps(t.cmd, TIE)
    return O.serialization(gaps, paired(t))


@query(
    "submission_batches",
    "W8",
    f"""l AS (SELECT tid, ts_ns, user_data, slba, bytes, op_name, lag(ts_ns) OVER (PARTITION BY tid ORDER BY ts_ns, {TIE_SQL}) p FROM cmd),
      b AS (SELECT tid, sum(CASE WHEN p IS NULL OR ts_ns - p > {30 * DAY} THEN 1 ELSE 0 END)
              OVER (PARTITION BY tid ORDER BY ts_ns, {TIE_SQL} ROWS UNBOUNDED PRECEDING) batch FROM l),
      s AS (SELECT tid, batch, count(*) size FROM b GROUP BY ALL)
      SELECT count(*) n, {nearest('size', 0.5)} size_p50, {nearest('size', 0.95)} size_p95, max(size) size_max FROM s""",
    "cmd",
)
def submission_batches(t: Tables) -> DataFrame:
    sizes = O.batches(t.cmd, TIE, 30 * DAY, ["tid"])
    points = {"size_p50": 0.5, "size_p95": 0.95, "size_max": 1.0}
    return quantiles(sizes, [], "size", points, nearest=True)


@query(
    "submission_batches_global",
    "W8",
    f"""l AS (SELECT ts_ns, slba, user_data, bytes, op_name, lag(ts_ns) OVER (ORDER BY ts_ns, {TIE_SQL}) p FROM cmd),
      b AS (SELECT ts_ns, sum(CASE WHEN p IS NULL OR ts_ns - p > 10000 THEN 1 ELSE 0 END)
              OVER (ORDER BY ts_ns, {TIE_SQL} ROWS UNBOUNDED PRECEDING) batch FROM l)
      SELECT CAST(batch AS BIGINT) batch, count(*) size, min(ts_ns) start_ns FROM b GROUP BY batch""",
    "cmd",
)
def submission_batches_global(t: Tables) -> DataFrame:
    return O.batches(t.cmd, TIE, 10_000)


@query(
    "write_locality",
    "W9",
    f"""w AS (SELECT *, lag(slba) OVER (ORDER BY ts_ns, {TIE_SQL}) ps, lag(bytes) OVER (ORDER BY ts_ns, {TIE_SQL}) pb
            FROM cmd WHERE op_name = 'write')
      SELECT count(*) writes, count(*) - count(DISTINCT slba) reused,
             round(count(*) FILTER (slba = ps + pb // 512) / greatest(count(*) - 1, 1), 9) seq_share FROM w""",
    "cmd",
)
def write_locality(t: Tables) -> DataFrame:
    return rounded(O.write_locality(t.cmd, TIE, 512), 9)


@query(
    "read_interleaving",
    "W10",
    f"""r AS (SELECT tid, lag(tid) OVER (ORDER BY ts_ns, {TIE_SQL}) p FROM cmd WHERE op_name = 'read')
      SELECT count(*) FILTER (p = tid) same_object, count(*) FILTER (p <> tid) other_object,
             round(count(*) FILTER (p <> tid) / count(p), 9) interleave_rate FROM r""",
    "cmd",
)
def read_interleaving(t: Tables) -> DataFrame:
    return rounded(O.interleaving(t.cmd, TIE), 9)


RUN_SQL = f"""
bk AS (SELECT tid, ts_ns // {7 * DAY} bucket, count(*) cmds, CAST(sum(bytes) AS BIGINT) bytes FROM cmd GROUP BY ALL)
"""


def _weekly(t: Tables) -> DataFrame:
    return dealt(t.cmd, ["tid"]).groupBy("tid", S.int_div(F.col("ts_ns"), 7 * DAY).alias("bucket")).agg(
        F.count(F.lit(1)).alias("cmds"), F.sum("bytes").alias("bytes")
    )


@query(
    "activity_runs",
    "W11",
    RUN_SQL
    + f""", r AS (SELECT *, bucket - row_number() OVER (PARTITION BY tid ORDER BY bucket) run FROM bk)
      SELECT tid, min(bucket) * {7 * DAY} begin_ns, (max(bucket) + 1) * {7 * DAY} end_ns, CAST(sum(cmds) AS BIGINT) cmds,
             CAST(sum(bytes) AS BIGINT) bytes, round(sum(bytes) / ((max(bucket) + 1 - min(bucket)) * {7 * DAY}), 15) gbps
      FROM r GROUP BY tid, run""",
    "cmd",
)
def activity_runs(t: Tables) -> DataFrame:
    width = 7 * DAY
    span = (F.max("bucket") + 1 - F.min("bucket")) * width
    return (
        series.runs(_weekly(t), ["tid"], "bucket")
        .groupBy("tid", "run")
        .agg(
            (F.min("bucket") * width).alias("begin_ns"),
            ((F.max("bucket") + 1) * width).alias("end_ns"),
            F.sum("cmds").alias("cmds"),
            F.sum("bytes").alias("bytes"),
            r6(F.sum("bytes") / span, 15).alias("gbps"),
        )
        .drop("run")
    )


@query(
    "command_rate_counters",
    "W12",
    RUN_SQL
    + """, n AS (SELECT *, lead(bucket) OVER (PARTITION BY tid ORDER BY bucket) nx FROM bk)
      SELECT tid, bucket, cmds FROM n
      UNION ALL SELECT tid, bucket + 1, 0 FROM n WHERE nx IS NULL OR nx > bucket + 1""",
    "cmd",
)
def command_rate_counters(t: Tables) -> DataFrame:
    return series.zero_filled(_weekly(t), "bucket", "cmds", ["tid"])


LANES_SQL = """
sp AS (SELECT obj_key, list(trace_id ORDER BY ts_start_ns, ts_ns, trace_id) ids, list(ts_start_ns ORDER BY ts_start_ns, ts_ns, trace_id) bs,
              list(ts_ns ORDER BY ts_start_ns, ts_ns, trace_id) es, list({'e': [ts_ns], 'l': [ts_start_ns]} ORDER BY ts_start_ns, ts_ns, trace_id) xs FROM obj GROUP BY obj_key),
ln AS (SELECT *, list_reduce(list_prepend({'e': CAST([] AS BIGINT[]), 'l': CAST([] AS BIGINT[])}, xs), lambda a, x:
         {'e': CASE WHEN list_position(list_transform(a.e, lambda z: z < x.l[1]), true) > 0
                    THEN list_concat(list_concat(a.e[:list_position(list_transform(a.e, lambda z: z < x.l[1]), true) - 1], x.e), a.e[list_position(list_transform(a.e, lambda z: z < x.l[1]), true) + 1:])
                    ELSE list_concat(a.e, x.e) END,
          'l': list_append(a.l, CAST(CASE WHEN list_position(list_transform(a.e, lambda z: z < x.l[1]), true) > 0
                    THEN list_position(list_transform(a.e, lambda z: z < x.l[1]), true) - 1 ELSE len(a.e) END AS BIGINT))}).l lanes FROM sp)
SELECT obj_key, unnest(ids) trace_id, unnest(bs) ts_start_ns, unnest(es) ts_ns, unnest(lanes) lane FROM ln
"""


@query("command_lanes", "W13", LANES_SQL, "obj")
def command_lanes(t: Tables) -> DataFrame:
    """Lanes of the object operations: spans that overlap never share one."""
    spans = t.obj.select("obj_key", "trace_id", "ts_start_ns", "ts_ns")
    return assign_lanes(spans, ["obj_key"], "ts_start_ns", "ts_ns", ["trace_id"])


@query(
    "object_report",
    "A50",
    f"""fc AS (SELECT tid, min(ts_ns) fc FROM cmd GROUP BY tid),
      r AS (SELECT op, ts_ns - ts_start_ns span, CASE WHEN ts_ns > ts_start_ns THEN bytes / ((ts_ns - ts_start_ns) / 1e9) / 1e6 END mbps,
                   fc - ts_start_ns pre FROM obj LEFT JOIN fc ON trace_id = tid WHERE error IS NULL)
      SELECT op, count(*) n, {nearest('span', 0.5)} span_p50, {nearest('span', 0.99)} span_p99,
             round({nearest('mbps', 0.5)}, 15) mbps_p50, {nearest('pre', 0.5)} presubmit_p50 FROM r GROUP BY op""",
    "obj cmd",
)
def object_report(t: Tables) -> DataFrame:
    return rounded(O.object_report(t.obj, t.cmd), 15)


@query(
    "failed_operations",
    "A50 F11",
    "SELECT op, error, count(*) n FROM obj WHERE error IS NOT NULL GROUP BY ALL",
    "obj",
)
def failed_operations(t: Tables) -> DataFrame:
    return t.obj.filter("error IS NOT NULL").groupBy("op", "error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "serving_spans",
    "A51 M13",
    f"""s AS (SELECT o_orderpriority op, greatest((o_orderkey % 97) * {DAY}, 1) dur FROM orders)
      SELECT op, count(*) n, {nearest('dur', 0.5)} p50, {nearest('dur', 0.99)} p99 FROM s GROUP BY op""",
)
def serving_spans(t: Tables) -> DataFrame:
    """Serving spans per operation; spans without length last 1 ns."""
    start = micros(F.col("o_orderdate")) * 1000
    end = start + F.col("o_orderkey") % 97 * DAY
    spans = t.orders.select(F.col("o_orderpriority").alias("op"), F.greatest(end - start, F.lit(1)).alias("dur"))
    return quantiles(spans, ["op"], "dur", {"p50": 0.5, "p99": 0.99}, nearest=True)


@query(
    "all_rank_barrier",
    "A52",
    f"""g AS (SELECT op, (trace_id - 1) // 3 chunk, max(ts_ns) - min(ts_ns) gap FROM obj
            WHERE error IS NULL AND op IN ('store', 'load') GROUP BY ALL HAVING count(*) = 3)
      SELECT op, count(*) n, {nearest('gap', 0.5)} gap_p50, {nearest('gap', 0.99)} gap_p99 FROM g GROUP BY op""",
    "obj",
)
def all_rank_barrier(t: Tables) -> DataFrame:
    chunked = t.obj.withColumn("chunk", S.int_div(F.col("trace_id") - 1, 3))
    gaps = O.barrier_gaps(chunked, ["op", "chunk"], 3)
    return quantiles(gaps, ["op"], "gap_ns", {"gap_p50": 0.5, "gap_p99": 0.99}, nearest=True)


@query(
    "capture_pair_deltas",
    "J17 S21 U1",
    f"""k AS (SELECT *, trace_id % 2 = 0 base, row_number() OVER (PARTITION BY trace_id % 2, obj_key, op ORDER BY ts_start_ns, trace_id) k
            FROM obj WHERE op IN ('store', 'load')),
      d AS (SELECT a.op, (b.ts_ns - b.ts_start_ns) - (a.ts_ns - a.ts_start_ns) delta FROM k a JOIN k b
            ON a.base AND NOT b.base AND a.obj_key = b.obj_key AND a.op = b.op AND a.k = b.k)
      SELECT op, count(*) n, {nearest('delta', 0.5)} p50 FROM d GROUP BY op""",
    "obj",
)
def capture_pair_deltas(t: Tables) -> DataFrame:
    arms = [
        t.obj.filter(F.col("trace_id") % 2 == side).withColumn("label", F.lit(name))
        for name, side in (("a", 0), ("b", 1))
    ]
    both = arms[0].unionByName(arms[1], allowMissingColumns=True).withColumnRenamed("obj_key", "key")
    deltas = O.ab_deltas(both, "label", F.col("label") == "a", ["trace_id"])
    return quantiles(deltas, ["op"], "delta_ns", {"p50": 0.5}, nearest=True)


@query(
    "load_path_summary",
    "A55",
    """r AS (SELECT * FROM cmd WHERE op_name = 'read'),
      o AS (SELECT tid, sum(bytes) b, min(ts_ns) f, max(ts_ns) l FROM r GROUP BY tid)
      SELECT count(*) objects, CAST(sum(b) AS BIGINT) bytes, count(DISTINCT b) object_sizes,
             (max(l) - min(f)) / 1e9 span_s, round(sum(b) / ((max(l) - min(f)) / 1e9) / 1e6, 12) mbps FROM o""",
    "cmd",
)
def load_path_summary(t: Tables) -> DataFrame:
    per_object = O.device_totals(t.cmd.filter("op_name = 'read'"))
    span = (F.max("last_ns") - F.min("first_ns")) / 1e9
    return per_object.agg(
        F.count(F.lit(1)).alias("objects"),
        F.sum("bytes").alias("bytes"),
        F.count_distinct("bytes").alias("object_sizes"),
        span.alias("span_s"),
        r6(F.sum("bytes") / span / 1e6, 12).alias("mbps"),
    )


@query(
    "load_objects_by_rank",
    "A55",
    """o AS (SELECT tid, sum(bytes) b, count(*) c FROM cmd WHERE op_name = 'read' GROUP BY tid)
      SELECT tid % 4 rank, count(*) objects, CAST(sum(c) AS BIGINT) cmds, CAST(sum(b) AS BIGINT) bytes, count(DISTINCT b) object_sizes FROM o GROUP BY rank""",
    "cmd",
)
def load_objects_by_rank(t: Tables) -> DataFrame:
    """Objects read by each rank; the tag tells the rank here."""
    per_object = O.device_totals(t.cmd.filter("op_name = 'read'")).withColumn("rank", F.col("tid") % 4)
    totals = (F.count(F.lit(1)).alias("objects"), F.sum("cmds").alias("cmds"), F.sum("bytes").alias("bytes"), F.count_distinct("bytes").alias("object_sizes"))
    return per_object.groupBy("rank").agg(*totals)


@query(
    "load_issuers",
    "A55",
    """r AS (SELECT *, slba // 32 % 8 pid, slba // 32 % 8 * 100 + tid % 7 thread FROM cmd WHERE op_name = 'read')
      SELECT coalesce(CAST(tid % 4 AS VARCHAR), 'all') rank, count(*) cmds, count(DISTINCT pid) pids, count(DISTINCT thread) threads,
             count(DISTINCT tid) objects FROM r GROUP BY GROUPING SETS ((tid % 4), ())""",
    "cmd",
)
def load_issuers(t: Tables) -> DataFrame:
    """Processes and threads that read, by rank and in all; the address tells the process here, the tag the thread."""
    pid = (S.int_div(F.col("slba"), 32) % 8).alias("pid")
    reads = t.cmd.filter("op_name = 'read'").select("tid", (F.col("tid") % 4).cast("string").alias("rank"), pid)
    return O.issuers(reads.withColumn("thread", F.col("pid") * 100 + F.col("tid") % 7), "rank")


@query(
    "load_objects_by_size",
    "A55",
    """o AS (SELECT tid, CAST(sum(bytes) AS BIGINT) bytes FROM cmd WHERE op_name = 'read' GROUP BY tid)
      SELECT bytes, count(*) objects FROM o GROUP BY bytes""",
    "cmd",
)
def load_objects_by_size(t: Tables) -> DataFrame:
    per_object = O.device_totals(t.cmd.filter("op_name = 'read'"))
    return per_object.groupBy("bytes").agg(F.count(F.lit(1)).alias("objects"))


@query(
    "load_concurrency_peak",
    "A55 W5",
    """o AS (SELECT tid, min(ts_ns) f, max(ts_ns) l FROM cmd WHERE op_name = 'read' GROUP BY tid),
      e AS (SELECT f ts, 1 d FROM o UNION ALL SELECT l, -1 FROM o),
      s AS (SELECT sum(d) OVER (ORDER BY ts, d ROWS UNBOUNDED PRECEDING) open FROM e)
      SELECT CAST(max(open) AS BIGINT) peak FROM s""",
    "cmd",
)
def load_concurrency_peak(t: Tables) -> DataFrame:
    """The highest number of objects in flight; at one instant ends come before begins."""
    per_object = O.device_totals(t.cmd.filter("op_name = 'read'"))
    return series.inflight(per_object, "first_ns", "last_ns").agg(F.max("open").alias("peak"))


@query(
    "replay_manifest",
    "A57 K3 M28 P44",
    """u AS (SELECT * FROM obj WHERE op IN ('store', 'load') AND error IS NULL),
      o AS (SELECT obj_key, max(bytes) payload_bytes, min(ts_start_ns) f,
                   min(ts_start_ns * 1 + 0) mf, first(trace_id ORDER BY ts_start_ns, trace_id) ft FROM u GROUP BY obj_key),
      k AS (SELECT obj_key, op, row_number() OVER (PARTITION BY obj_key, op ORDER BY ts_start_ns, trace_id) r, ts_start_ns, trace_id FROM u),
      l AS (SELECT obj_key, string_agg(op, '>' ORDER BY ts_start_ns, trace_id) ops FROM k WHERE r = 1 GROUP BY obj_key)
      SELECT row_number() OVER (ORDER BY f, ft, obj_key) - 1 "index", obj_key, 'kv' part, payload_bytes, ops,
             ((SELECT max(payload_bytes) FROM o) + 4096 + 4095) // 4096 * 4096 slot_bytes
      FROM o JOIN l USING (obj_key)""",
    "obj",
)
def replay_manifest(t: Tables) -> DataFrame:
    rows = O.manifest(t.obj, "obj_key", ["ts_start_ns", "trace_id"])
    largest = rows.agg(F.max("payload_bytes")).first()[0]
    slot = -(-(largest + 4096) // 4096) * 4096
    return rows.withColumns({"ops": F.array_join("ops", ">"), "slot_bytes": F.lit(slot).cast("long")})


@query(
    "block_size_inference",
    "J27 T6",
    """s AS (SELECT trace_id, slot_offset FROM obj WHERE op = 'store'),
      c AS (SELECT unnest([512, 4096, 8192]) block_bytes, unnest([0, 1, 2]) prio),
      v AS (SELECT block_bytes, prio, trace_id, max(CASE WHEN slba * block_bytes = slot_offset + 131072 THEN 1 ELSE 0 END) hit
            FROM s JOIN cmd ON tid = trace_id, c GROUP BY ALL),
      t AS (SELECT block_bytes, prio, CAST(sum(hit) AS BIGINT) score FROM v GROUP BY ALL)
      SELECT block_bytes, score, row_number() OVER (ORDER BY score DESC, prio) = 1 AND score > 0 chosen FROM t""",
    "obj cmd",
)
def block_size_inference(t: Tables) -> DataFrame:
    """Stores here start with a command 128 KiB into their slot."""
    obj = t.obj.withColumn("slot_offset", F.col("slot_offset") + 131072)
    return O.inferred_block_bytes(obj, t.cmd, [512, 4096, 8192])


@query(
    "header_payload_commands",
    "P34",
    """x AS (SELECT slba * 4096 = slot_offset + 131072 hd, cmd.bytes FROM cmd JOIN obj ON tid = trace_id WHERE op = 'store')
      SELECT CASE WHEN hd THEN 'header' ELSE 'payload' END AS role, count(*) n, CAST(sum(bytes) AS BIGINT) bytes FROM x GROUP BY ALL""",
    "obj cmd",
)
def header_payload_commands(t: Tables) -> DataFrame:
    rows = O.by_tag(t.cmd, t.obj).filter("obj_op = 'store'")
    header = F.col("slba") * 4096 == F.col("obj_slot_offset") + 131072
    role = F.when(header, "header").otherwise("payload").alias("role")
    return rows.groupBy(role).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(
    "object_key_fields",
    "P9 P37",
    """k AS (SELECT 'm' || obj_key % 7 || '@f' || obj_key % 3 || '@' || CASE WHEN obj_key % 5 = 0 THEN 'x' ELSE CAST(obj_key % 4 AS VARCHAR) END
                   || '@' || md5(CAST(obj_key AS VARCHAR)) AS key, trace_id FROM obj)
      SELECT trace_id, try_cast(split_part(key, '@', 3) AS BIGINT) rank, left(split_part(key, '@', 4), 12) chunk,
             split_part(key, '@', 2) fmt,
             CAST(('0x' || left(md5('arm/flow/' || trace_id), 16))::UBIGINT & 9223372036854775807 AS BIGINT) flow_id FROM k""",
    "obj",
)
def object_key_fields(t: Tables) -> DataFrame:
    k = F.col("obj_key")
    rank = F.when(k % 5 == 0, "x").otherwise((k % 4).cast("string"))
    digest = F.md5(k.cast("string").cast("binary"))
    key = F.concat(F.lit("m"), k % 7, F.lit("@f"), k % 3, F.lit("@"), rank, F.lit("@"), digest)
    fields = S.key_fields(F.col("key"))
    flow = S.path_id(F.lit("arm"), F.lit("flow"), F.col("trace_id"))
    rows = t.obj.select("trace_id", key.alias("key"))
    return rows.select("trace_id", *[c.alias(n) for n, c in fields.items()], flow.alias("flow_id"))


@query(
    "commands_in_trace_range",
    "F3 F5 K8",
    """SELECT op_name, count(*) n, CAST(sum(bytes) AS BIGINT) bytes FROM cmd
       WHERE tid BETWEEN (SELECT min(tid) FROM cmd) + 100 AND (SELECT max(tid) FROM cmd) - 100
         AND ts_ns BETWEEN (SELECT min(ts_ns) FROM cmd) AND (SELECT max(ts_ns) FROM cmd) - 31536000000000000
       GROUP BY op_name""",
    "cmd",
)
def commands_in_trace_range(t: Tables) -> DataFrame:
    """An id range (without the outermost ids) and a phase (without the last year)."""
    lo, hi, t0, t1 = t.cmd.agg(F.min("tid"), F.max("tid"), F.min("ts_ns"), F.max("ts_ns")).first()
    phase = F.col("ts_ns").between(t0, t1 - 365 * DAY)
    rows = t.cmd.filter(F.col("tid").between(lo + 100, hi - 100) & phase)
    return rows.groupBy("op_name").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


@query(
    "cumulative_device_bytes",
    "W21 W18",
    f"""r AS (SELECT *, sum(bytes) OVER (ORDER BY ts_ns, {TIE_SQL} ROWS UNBOUNDED PRECEDING) cum,
                   row_number() OVER (ORDER BY ts_ns, {TIE_SQL}) rn, count(*) OVER () n FROM cmd WHERE op_name = 'read')
      SELECT rn, ts_ns, CAST(cum AS BIGINT) cum_bytes FROM r WHERE (rn - 1) % greatest(1, n // 100) = 0 OR rn = n""",
    "cmd",
)
def cumulative_device_bytes(t: Tables) -> DataFrame:
    """Running device bytes, shown at every n/100-th read and at the last one."""
    reads = t.cmd.filter("op_name = 'read'")
    n = reads.count()
    scan = Scan(reads, [], ["ts_ns", *TIE])
    scan.add(RunningSum("cum_bytes", F.col("bytes")), RunningSum("rn", F.lit(1)))
    step = max(1, n // 100)
    shown = ((F.col("rn") - 1) % step == 0) | (F.col("rn") == n)
    return scan.df.filter(shown).select("rn", "ts_ns", "cum_bytes")


@query(
    "object_timeline",
    "K7",
    OCC_SQL
    + """, ev AS (SELECT begin_ns ts, 1 d FROM sp UNION ALL SELECT end_ns, -1 FROM sp),
      g AS (SELECT ts, d, sum(d) delta FROM ev GROUP BY ALL),
      fl AS (SELECT ts, CAST(sum(delta) OVER (ORDER BY ts, d ROWS UNBOUNDED PRECEDING) AS BIGINT) v FROM g),
      tl AS (SELECT ts ts_ns, 1 ord, 'counter' kind, 'objects in flight' "name", CAST(NULL AS BIGINT) id, v "value" FROM fl
        UNION ALL SELECT begin_ns, 2, 'begin', obj_key, trace_id, cmd_bytes FROM sp WHERE n_cmds IS NOT NULL OR end_ns > begin_ns
        UNION ALL SELECT begin_ns, 3, 'instant', obj_key, trace_id, bytes FROM sp WHERE NOT (n_cmds IS NOT NULL OR end_ns > begin_ns)
        UNION ALL SELECT first_cmd_ns, 3, 'flow_out', obj_key, trace_id, first_slba FROM sp JOIN (SELECT obj_key, occ, first_cmd_ns FROM po) USING (obj_key, occ)
        UNION ALL SELECT last_cmd_ns, 3, 'flow_in', obj_key, trace_id, last_slba FROM sp JOIN (SELECT obj_key, occ, last_cmd_ns FROM po) USING (obj_key, occ)
        UNION ALL SELECT ts_ns, 3, 'late', obj_key, trace_id, n_cmds FROM sp JOIN (SELECT obj_key, occ, ts_ns FROM oc) USING (obj_key, occ) WHERE late
        UNION ALL SELECT end_ns, 4, 'end', obj_key, trace_id, n_cmds FROM sp WHERE n_cmds IS NOT NULL OR end_ns > begin_ns)
      SELECT row_number() OVER (ORDER BY ts_ns, ord, kind, id NULLS FIRST, "name" NULLS FIRST, "value" NULLS FIRST) AS "position", ts_ns, ord, kind, CAST("name" AS VARCHAR) AS "name", id,
             CAST("value" AS BIGINT) AS "value" FROM tl""",
    "obj cmd",
)
def object_timeline(t: Tables) -> DataFrame:
    """Spans, instants, late marks, flows and the count of objects in flight in one drawing order."""
    names = "obj_key trace_id bytes n_cmds cmd_bytes first_slba last_slba first_cmd_ns last_cmd_ns ts_ns begin_ns end_ns late is_span"
    spans = pin(_spans(t).select(*names.split()))
    counters = series.inflight(spans, "begin_ns", "end_ns").select(F.col("ts").alias("ts_ns"), F.lit("objects in flight").alias("name"), F.col("open").alias("value"))
    return O.timeline(spans, counters)
