"""Queries on projected device work and on its agreement with what was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions import scalar as S
from iotrail.operators import objects as O
from iotrail.operators import reconcile as R
from iotrail.operators.pairing import consuming_pairs
from iotrail.plans.blocks import r6, rounded
from iotrail.plans.objects import DAY, nearest
from iotrail.plans.registry import Tables, micros, query
from iotrail.sources import records

MDTS = 1048576
GEOMETRY = {"mdts_bytes": MDTS, "header_bytes": 4096, "block_bytes": 512}


def _loads(t: Tables) -> DataFrame:
    """Objects whose payload is the largest command of the order."""
    largest = t.cmd.groupBy(F.col("tid").alias("trace_id")).agg(F.max("bytes").alias("bytes"))
    return t.obj.drop("bytes").join(largest, "trace_id")


LOADS_SQL = """
lg AS (SELECT tid trace_id, max(bytes) bytes FROM cmd GROUP BY tid),
ld AS (SELECT obj.* REPLACE (lg.bytes AS bytes) FROM obj JOIN lg USING (trace_id)
       WHERE op IN ('store', 'load') AND error IS NULL),
pr AS (SELECT *, (bytes + 1048575) // 1048576 n0 FROM ld),
pj AS (SELECT *, n0 + CASE op WHEN 'store' THEN 1 ELSE 0 END n_commands,
              (bytes - (n0 - 1) * 1048576 + 511) // 512 * 512 tail FROM pr),
pt AS (SELECT *, (n0 - 1) * 1048576 + tail + CASE op WHEN 'store' THEN 4096 ELSE 0 END total_bytes FROM pj),
ps0 AS (SELECT trace_id, op, 1048576 size, n0 - 1 n FROM pt UNION ALL SELECT trace_id, op, tail, 1 FROM pt
        UNION ALL SELECT trace_id, op, 4096, 1 FROM pt WHERE op = 'store'),
psz AS (SELECT trace_id, op, size, sum(n) n FROM ps0 WHERE n > 0 GROUP BY ALL),
msz AS (SELECT trace_id, op, cmd.bytes size, count(*) n FROM cmd JOIN ld ON tid = trace_id GROUP BY ALL)
"""


@query(
    "projected_commands",
    "P43",
    """u AS (SELECT * FROM obj WHERE op IN ('store', 'load') AND error IS NULL),
      n AS (SELECT *, (bytes + 131071) // 131072 k FROM u)
      SELECT trace_id, op, CASE op WHEN 'store' THEN 2 ELSE 1 END device_ops,
             k + CASE op WHEN 'store' THEN 1 ELSE 0 END n_commands,
             (bytes - (k - 1) * 131072 + 511) // 512 * 512 tail_bytes,
             (k - 1) * 131072 + (bytes - (k - 1) * 131072 + 511) // 512 * 512 + CASE op WHEN 'store' THEN 4096 ELSE 0 END total_bytes
      FROM n""",
    "obj",
)
def projected_commands(t: Tables) -> DataFrame:
    rows = O.projected_totals(t.obj)
    ints = ("device_ops", "n_commands", "tail_bytes", "total_bytes")
    return rows.select("trace_id", "op", *[F.col(c).cast("long").alias(c) for c in ints])


@query(
    "projected_command_sizes",
    "P43",
    """n AS (SELECT trace_id, bytes, (bytes + 131071) // 131072 k FROM obj)
      SELECT trace_id, array_to_string(list_concat([131072 for x in range(k - 1)], [(bytes - (k - 1) * 131072 + 511) // 512 * 512]), ',') sizes
      FROM n""",
    "obj",
)
def projected_command_sizes(t: Tables) -> DataFrame:
    sizes = S.split_sizes(F.col("bytes"), 131072, 512)
    return t.obj.select("trace_id", F.array_join(sizes.cast("array<string>"), ",").alias("sizes"))


@query(
    "projection_score",
    "A53 J19 D6",
    LOADS_SQL
    + """, me AS (SELECT pt.trace_id, n_commands, total_bytes, count(cmd.bytes) cmds, coalesce(sum(cmd.bytes), 0) mb
              FROM pt LEFT JOIN cmd ON tid = pt.trace_id GROUP BY ALL),
      off AS (SELECT DISTINCT coalesce(p.trace_id, m.trace_id) trace_id FROM psz p
              FULL JOIN msz m ON p.trace_id = m.trace_id AND p.size = m.size WHERE coalesce(p.n, 0) <> coalesce(m.n, 0))
      SELECT count(*) objects, count(*) FILTER (cmds = n_commands AND mb = total_bytes) exact,
             count(*) FILTER (cmds = n_commands) cmds_exact, count(*) FILTER (mb = total_bytes) bytes_exact,
             count(*) FILTER (trace_id NOT IN (SELECT trace_id FROM off)) sizes_exact,
             round(sum(abs(mb - total_bytes)) / sum(mb), 9) wape FROM me""",
    "obj cmd",
)
def projection_score(t: Tables) -> DataFrame:
    return rounded(O.projection_score(_loads(t), t.cmd, **GEOMETRY), 9)


@query(
    "projected_size_variation",
    "A53 D5 U4",
    LOADS_SQL
    + """, b AS (SELECT op, CAST(floor(log2(size)) AS BIGINT) bin, sum(p) p, sum(m) m FROM
             (SELECT op, size, n p, 0 m FROM psz UNION ALL SELECT op, size, 0, n FROM msz) GROUP BY ALL),
      tt AS (SELECT op, sum(p) sp, sum(m) sm FROM b GROUP BY op),
      tv AS (SELECT op, round(sum(abs(p / sp - m / sm)) / 2, 9) tv FROM b JOIN tt USING (op) GROUP BY op)
      SELECT op, CAST((SELECT sum(n) FROM psz x WHERE x.op = tv.op) AS BIGINT) proj_n,
             (SELECT min(size) FROM psz x WHERE x.op = tv.op) proj_min, (SELECT max(size) FROM psz x WHERE x.op = tv.op) proj_max,
             CAST((SELECT sum(n) FROM msz x WHERE x.op = tv.op) AS BIGINT) meas_n,
             (SELECT min(size) FROM msz x WHERE x.op = tv.op) meas_min, (SELECT max(size) FROM msz x WHERE x.op = tv.op) meas_max, tv
      FROM tv""",
    "obj cmd",
)
def projected_size_variation(t: Tables) -> DataFrame:
    return rounded(O.size_variation(_loads(t), t.cmd, **GEOMETRY), 9)


@query(
    "projected_variation_by_part",
    "A53 D5 U4",
    LOADS_SQL
    + """, sd AS (SELECT op, trace_id % 3 part, size, n p, 0 m FROM psz UNION ALL SELECT op, trace_id % 3, size, 0, n FROM msz),
      b AS (SELECT op, part, CAST(floor(log2(size)) AS BIGINT) bin, sum(p) p, sum(m) m FROM sd GROUP BY ALL),
      tt AS (SELECT op, part, CAST(sum(p) AS BIGINT) proj_n, min(size) FILTER (p > 0) proj_min, max(size) FILTER (p > 0) proj_max,
                    CAST(sum(m) AS BIGINT) meas_n, min(size) FILTER (m > 0) meas_min, max(size) FILTER (m > 0) meas_max FROM sd GROUP BY ALL)
      SELECT tt.*, tv FROM tt JOIN (SELECT op, part, round(sum(abs(p / proj_n - m / meas_n)) / 2, 9) tv FROM b JOIN tt USING (op, part) GROUP BY ALL) USING (op, part)""",
    "obj cmd",
)
def projected_variation_by_part(t: Tables) -> DataFrame:
    loads = _loads(t).withColumn("part", F.col("trace_id") % 3)
    return rounded(O.size_variation(loads, t.cmd, ["op", "part"], **GEOMETRY), 9)


@query(
    "model_object_sizes",
    "P42 P45",
    """m AS (SELECT p_partkey, p_size layers, p_partkey % 16 + 1 heads, (p_partkey % 4 + 1) * 32 head_dim, 2 width FROM part),
      b AS (SELECT *, 2 * layers * heads * head_dim * width per_token FROM m)
      SELECT p_partkey, per_token, per_token * 256 chunk_bytes, per_token * 256 // layers layer_bytes,
             round(per_token / 1024, 6) per_token_kib, round(per_token * 256 / 1048576, 6) chunk_mib FROM b""",
)
def model_object_sizes(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    layers = F.col("p_size").cast("long")
    token = S.token_bytes(layers, key % 16 + 1, (key % 4 + 1) * 32, F.lit(2))
    rows = t.part.select("p_partkey", layers.alias("layers"), token.alias("per_token"))
    chunk = F.col("per_token") * 256
    return rows.select(
        "p_partkey",
        "per_token",
        chunk.alias("chunk_bytes"),
        S.int_div(chunk, F.col("layers")).alias("layer_bytes"),
        r6(F.col("per_token") / 1024).alias("per_token_kib"),
        r6(chunk / 1048576).alias("chunk_mib"),
    )


@query(
    "readable_sizes",
    "P45",
    """SELECT trace_id, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes % 1024 = 0 THEN bytes // 1024 || ' KiB'
          ELSE printf('%.1f', bytes / 1024) || ' KiB' END AS text FROM obj""",
    "obj",
)
def readable_sizes(t: Tables) -> DataFrame:
    return t.obj.select("trace_id", S.human_size(F.col("bytes")).alias("text"))


TRUTH_SQL = """
tr AS (SELECT o_orderkey ud, o_orderkey * 4096 "offset", CAST(floor(o_totalprice) AS BIGINT) req,
              CASE WHEN o_orderstatus = 'F' THEN 'READ' ELSE 'WRITE' END ddir FROM orders),
ti AS (SELECT o_orderkey + CASE WHEN o_orderkey % 101 = 7 THEN 100000000 ELSE 0 END ud, o_orderkey * 4096 + CASE WHEN o_orderkey % 53 = 1 THEN 512 ELSE 0 END "offset",
              CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 59 = 2 THEN 1 ELSE 0 END req, o_orderkey % 7 <> 3 valid,
              CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 210 = 3 THEN 5 ELSE -5 END lowb,
              CASE WHEN o_orderkey % 61 = 4 THEN 'READ' WHEN o_orderstatus = 'F' THEN 'READ' ELSE 'WRITE' END ddir, o_orderkey rid FROM orders
       UNION ALL SELECT o_orderkey, o_orderkey * 4096, CAST(floor(o_totalprice) AS BIGINT), true, 0,
              CASE WHEN o_orderstatus = 'F' THEN 'READ' ELSE 'WRITE' END, o_orderkey + 1000000000 FROM orders WHERE o_orderkey % 97 = 5),
tc AS (SELECT o_orderkey ud FROM orders WHERE o_orderkey % 67 <> 6)
"""


def _truth(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ground truth, traced submissions and traced completions with planted faults."""
    k, size = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    ddir = F.when(F.col("o_orderstatus") == "F", "READ").otherwise("WRITE")
    truth = t.orders.select(
        k.alias("user_data"),
        (k * 4096).alias("offset"),
        size.alias("requested_bytes"),
        ddir.alias("ddir"),
        ddir.alias("op_name"),
        F.when(k % 71 != 8, size).otherwise(size - 1).alias("cqe_res"),
    )
    main = t.orders.select(
        F.when(k % 101 == 7, k + 100_000_000).otherwise(k).alias("user_data"),
        F.when(k % 53 == 1, k * 4096 + 512).otherwise(k * 4096).alias("offset"),
        F.when(k % 59 == 2, size + 1).otherwise(size).alias("requested_bytes"),
        (k % 7 != 3).alias("requested_bytes_valid"),
        F.when(k % 210 == 3, size + 5).otherwise(size - 5).alias("requested_bytes_lower"),
        F.when(k % 61 == 4, "READ").otherwise(ddir).alias("ddir"),
        k.alias("row"),
    )
    again = t.orders.filter(k % 97 == 5).select(
        k.alias("user_data"),
        (k * 4096).alias("offset"),
        size.alias("requested_bytes"),
        F.lit(True).alias("requested_bytes_valid"),
        F.lit(0).cast("long").alias("requested_bytes_lower"),
        ddir.alias("ddir"),
        (k + 1_000_000_000).alias("row"),
    )
    done = t.orders.filter(k % 67 != 6).select(k.alias("user_data"))
    return truth, main.unionByName(again), done


@query(
    "tracer_reconciliation",
    "J18 U2 M14 S19",
    TRUTH_SQL
    + """, f AS (SELECT ud, count(*) n, arg_min("offset", rid) o, arg_min(req, rid) r, arg_min(valid, rid) v, arg_min(lowb, rid) l, arg_min(ddir, rid) d
              FROM ti GROUP BY ud),
      j AS (SELECT coalesce(tr.ud, f.ud) ud, tr.ud IS NULL sp, f.ud IS NULL ms, n, tr."offset" <> o AS "off", v AND tr.req <> r bad, NOT v AND l > tr.req low,
                   tr.ddir <> d dd, tr.ud NOT IN (SELECT ud FROM tc) nc FROM tr FULL JOIN f ON tr.ud = f.ud),
      p AS (SELECT unnest(list_filter([CASE WHEN ms THEN 'missing' END, CASE WHEN sp THEN 'spurious' END, CASE WHEN NOT sp AND n > 1 THEN 'duplicate' END,
                   CASE WHEN "off" THEN 'offset' END, CASE WHEN bad THEN 'bytes' END, CASE WHEN low THEN 'lower_bound' END, CASE WHEN dd THEN 'direction' END,
                   CASE WHEN nc AND NOT ms AND NOT sp THEN 'no_completion' END], lambda x: x IS NOT NULL)) problem, ud FROM j)
      SELECT problem, ud user_data FROM p""",
)
def tracer_reconciliation(t: Tables) -> DataFrame:
    truth, submitted, done = _truth(t)
    return R.reconcile(truth, submitted, done, ["row"])


@query(
    "ground_truth_scan",
    "S19",
    """SELECT row_number() OVER (ORDER BY o_orderkey) line, CASE WHEN o_orderkey % 40 <> 11 THEN o_orderkey END user_data,
       CASE WHEN o_orderkey % 40 <> 11 THEN o_orderkey * 4096 END "offset", CASE WHEN o_orderkey % 40 <> 11 THEN o_custkey END requested_bytes,
       CASE WHEN o_orderkey % 40 <> 11 THEN 'READ' END op_name, o_orderkey % 40 = 11 bad FROM orders""",
)
def ground_truth_scan(t: Tables) -> DataFrame:
    """Records as JSON lines; every 40th line is cut off and reported with its number."""
    k = F.col("o_orderkey")
    doc = F.to_json(
        F.struct(k.alias("user_data"), (k * 4096).alias("offset"), F.col("o_custkey").cast("long").alias("requested_bytes"), F.lit("READ").alias("op_name"))
    )
    cut = F.when(k % 40 == 11, F.substring(doc, 1, 9)).otherwise(doc)
    rows = records.ground_truth(t.orders.select(k, cut.alias("value")), ["o_orderkey"])
    return rows.select("line", F.col("user_data").cast("long").alias("user_data"), "offset", "requested_bytes", "op_name", "bad")


RING_SQL = """
e AS (SELECT user_id * 64 req, epoch_us(ts) * 1000 ns, event_id, event_type = 'view' sub FROM events WHERE event_type IN ('view', 'purchase')),
l AS (SELECT *, lag(sub) OVER w ps, lag(ns) OVER w pn, lag(event_id) OVER w pe FROM e WINDOW w AS (PARTITION BY req ORDER BY ns, event_id))
"""


@query(
    "ring_request_pairs",
    "J6",
    RING_SQL + "SELECT req, pe submit_id, event_id complete_id, ns - pn latency_ns FROM l WHERE NOT sub AND ps",
)
def ring_request_pairs(t: Tables) -> DataFrame:
    """Ring submissions and completions that share a request pointer, which is used again."""
    rows = t.events.filter("event_type IN ('view', 'purchase')").select(
        (F.col("user_id") * 64).alias("req"), (micros(F.col("ts")) * 1000).alias("ns"), "event_id", (F.col("event_type") == "view").alias("is_submit")
    )
    pairs = consuming_pairs(rows, ["req"], ["ns", "event_id"], F.col("is_submit"), ["ns", "event_id"])
    return pairs.select("req", F.col("start_event_id").alias("submit_id"), F.col("event_id").alias("complete_id"), (F.col("ns") - F.col("start_ns")).alias("latency_ns"))


@query(
    "truth_self_check",
    "S19 W22",
    """k AS (SELECT o_orderkey ud FROM orders),
      m AS (SELECT ud < lag(ud) OVER (ORDER BY ud) bad FROM k)
      SELECT (SELECT count(*) - count(DISTINCT ud) FROM k) duplicates,
             (SELECT count(*) FROM orders WHERE o_orderkey % 71 = 8) result_mismatch,
             (SELECT count(*) FROM m WHERE bad) not_monotonic""",
)
def truth_self_check(t: Tables) -> DataFrame:
    truth, _, _ = _truth(t)
    return R.self_check(truth.withColumn("row", F.col("user_data")), ["row"])


@query(
    "component_accounting",
    "J25 M11",
    """o AS (SELECT trace_id, bytes, bytes // 2 k, bytes // 4 v, bytes // 8 s, bytes - bytes // 2 - bytes // 4 - bytes // 8 h, obj_key FROM obj)
      SELECT trace_id, CASE WHEN trace_id % 40 = 9 THEN 'v>sum' ELSE 'sum' END problem
      FROM o WHERE trace_id % 20 = 9""",
    "obj",
)
def component_accounting(t: Tables) -> DataFrame:
    """Records whose parts do not add up, with planted differences."""
    b, k = F.col("bytes"), F.col("trace_id")
    half, quarter, eighth = (S.int_div(b, n) for n in (2, 4, 8))
    truth = t.obj.select(
        k.alias("key"),
        half.alias("k_bytes"),
        quarter.alias("v_bytes"),
        eighth.alias("scale_bytes"),
        (b - half - quarter - eighth).alias("header_bytes"),
    )
    off = F.when(k % 40 == 9, 1).otherwise(0)
    records = t.obj.select(
        k.alias("key"),
        k.alias("object_id"),
        F.lit("kv").alias("part"),
        F.when(k % 40 == 29, b + 3).otherwise(b).alias("bytes"),
        F.struct(
            half.alias("k_bytes"), (quarter + off).alias("v_bytes"), eighth.alias("scale_bytes")
        ).alias("components"),
    )
    rows = R.component_problems(records, truth)
    return rows.select(F.col("key").alias("trace_id"), F.array_join("problems", ">").alias("problem"))


@query(
    "replay_latency_report",
    "A56 S20",
    f"""u AS (SELECT op, obj_key % 10 object, (ts_ns - ts_start_ns) / 1e6 ms, bytes FROM obj WHERE op IN ('store', 'load')),
      a AS (SELECT op, object, count(*) n, {nearest('ms', 0.5)} p50_ms, {nearest('ms', 0.99)} p99_ms, avg(ms) mean, max(bytes) payload FROM u GROUP BY ALL)
      SELECT op, object, n, p50_ms, p99_ms, round(payload / (mean / 1e3) / 1e6, 12) mbps,
             round(((payload + 131071) // 131072 + CASE op WHEN 'store' THEN 1 ELSE 0 END) / (mean / 1e3), 12) cmds_per_s FROM a""",
    "obj",
)
def replay_latency_report(t: Tables) -> DataFrame:
    """Timings of replayed objects with the rates the projection implies."""
    ms = (F.col("ts_ns") - F.col("ts_start_ns")) / 1e6
    timings = t.obj.filter("op IN ('store', 'load')").select(
        "op", (F.col("obj_key") % 10).alias("object"), ms.alias("ms"), "bytes"
    )
    return R.replay_report(timings, 131072)


@query(
    "worker_speedup",
    "A76",
    f"""w AS (SELECT o_custkey % 8 + 1 workers, min(o_orderkey % 97 + 1) best_days, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) bytes FROM orders GROUP BY ALL)
      SELECT workers, best_days * {DAY} best_ns, round(bytes / (best_days * {DAY}), 15) gbs,
             round(first(best_days ORDER BY workers) OVER (ORDER BY workers) / best_days, 9) speedup FROM w""",
)
def worker_speedup(t: Tables) -> DataFrame:
    runs = t.orders.select(
        (F.col("o_custkey") % 8 + 1).alias("workers"),
        ((F.col("o_orderkey") % 97 + 1) * DAY).alias("wall_ns"),
        F.floor("o_totalprice").cast("long").alias("bytes"),
    )
    return R.speedup(runs)

