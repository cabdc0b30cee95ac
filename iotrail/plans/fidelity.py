"""Replay fidelity queries: the two arms are the even and the odd block events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions.stats import pearson
from iotrail.operators import fidelity as X
from iotrail.operators import reconcile as R
from iotrail.plans.blocks import BUCKET_NS, BUCKET_S, LBS, LIFE_SQL, r6, rounded
from iotrail.plans.registry import REGISTRY, Tables, query
from iotrail.sinks import replay_log

SPAN_SQL = f"""
sp AS (SELECT max(ts_ns) FILTER (arm = 0) t0, max(ts_ns) FILTER (arm = 1) t1 FROM arms),
p AS (SELECT least(t0, t1) common, greatest(1, (least(t0, t1) + {BUCKET_NS} - 1) // {BUCKET_NS}) n,
             greatest(1, (t0 + {BUCKET_NS} - 1) // {BUCKET_NS}) n0, greatest(1, (t1 + {BUCKET_NS} - 1) // {BUCKET_NS}) n1 FROM sp),
grid AS (SELECT unnest(range(n)) bucket FROM p),
q AS (SELECT least(ts_ns // {BUCKET_NS}, n - 1) bucket, arm, rwbs LIKE '%R%' rd, rwbs LIKE '%W%' wr, nblocks * {LBS} b
      FROM arms, p WHERE action = 'Q' AND nblocks > 0),
rates AS (SELECT grid.bucket, count(*) FILTER (arm = 0 AND rd) / {BUCKET_S} cap_read_rate,
                 count(*) FILTER (arm = 0 AND NOT rd AND wr) / {BUCKET_S} cap_write_rate,
                 count(*) FILTER (arm = 1 AND rd) / {BUCKET_S} rep_read_rate,
                 count(*) FILTER (arm = 1 AND NOT rd AND wr) / {BUCKET_S} rep_write_rate
          FROM grid LEFT JOIN q USING (bucket) GROUP BY grid.bucket)
"""


def smape_sql(a: str, b: str) -> str:
    return f"coalesce(avg(2 * abs({a} - {b}) / (abs({a}) + abs({b}))) FILTER (abs({a}) + abs({b}) > 0), 0)"


@query(
    "fidelity_rate_series",
    "J21 A4 D7",
    SPAN_SQL
    + """SELECT bucket, round(cap_read_rate, 9) cap_read_rate, round(cap_write_rate, 9) cap_write_rate,
         round(rep_read_rate, 9) rep_read_rate, round(rep_write_rate, 9) rep_write_rate,
         round((cap_read_rate + cap_write_rate) - (rep_read_rate + rep_write_rate), 9) + 0.0 residual FROM rates""",
    "arms",
)
def fidelity_rate_series(t: Tables) -> DataFrame:
    rows = rounded(X.rate_series(t.arms, BUCKET_NS), 9)
    return rows.withColumn("residual", F.col("residual") + 0.0)


@query(
    "fidelity_rate_scores",
    "D1 D2 D8",
    SPAN_SQL
    + f"""SELECT round(corr(cap_read_rate, rep_read_rate), 6) q_rate_corr_read, round(corr(cap_write_rate, rep_write_rate), 6) q_rate_corr_write,
         round({smape_sql('(cap_read_rate + cap_write_rate)', '(rep_read_rate + rep_write_rate)')}, 6) q_rate_smape FROM rates""",
    "arms",
)
def fidelity_rate_scores(t: Tables) -> DataFrame:
    return rounded(X.rate_scores(X.rate_series(t.arms, BUCKET_NS)))


@query(
    "fidelity_drift",
    "D7 A5",
    SPAN_SQL
    + """, g AS (SELECT grid.bucket, count(b) FILTER (arm = 0) cn, count(b) FILTER (arm = 1) rn,
                     coalesce(sum(b) FILTER (arm = 0), 0) cb, coalesce(sum(b) FILTER (arm = 1), 0) rb
              FROM grid LEFT JOIN q USING (bucket) GROUP BY grid.bucket),
      c AS (SELECT bucket, CAST(sum(cn) OVER w AS BIGINT) cap_count, CAST(sum(rn) OVER w AS BIGINT) rep_count,
                   CAST(sum(cb) OVER w AS BIGINT) cap_bytes, CAST(sum(rb) OVER w AS BIGINT) rep_bytes FROM g
            WINDOW w AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING))
      SELECT *, cap_count - rep_count count_drift, cap_bytes - rep_bytes bytes_drift,
             round(CASE WHEN cap_count > 0 THEN (cap_count - rep_count) * 100 / cap_count ELSE 0 END, 9) pct_drift FROM c""",
    "arms",
)
def fidelity_drift(t: Tables) -> DataFrame:
    return rounded(X.drift(t.arms, BUCKET_NS, LBS), 9)


COMPLETION_SQL = (
    SPAN_SQL
    + f""", cc AS (SELECT arm, least(ts_ns // {BUCKET_NS}, CASE arm WHEN 0 THEN n0 ELSE n1 END - 1) bucket, nblocks * {LBS} b FROM arms, p WHERE action = 'C'),
 comp AS (SELECT grid.bucket, coalesce(sum(b) FILTER (arm = 0), 0) / {BUCKET_S} / 1048576 cap_mbps, count(b) FILTER (arm = 0) / {BUCKET_S} cap_iops,
                 coalesce(sum(b) FILTER (arm = 1), 0) / {BUCKET_S} / 1048576 rep_mbps, count(b) FILTER (arm = 1) / {BUCKET_S} rep_iops
          FROM grid LEFT JOIN cc USING (bucket) GROUP BY grid.bucket)
"""
)


@query(
    "fidelity_throughput_scores",
    "D8",
    COMPLETION_SQL
    + f"""SELECT round(corr(cap_mbps, rep_mbps), 6) mbps_corr, round({smape_sql('cap_mbps', 'rep_mbps')}, 6) mbps_smape,
         round(corr(cap_iops, rep_iops), 6) iops_corr, round({smape_sql('cap_iops', 'rep_iops')}, 6) iops_smape FROM comp""",
    "arms",
)
def fidelity_throughput_scores(t: Tables) -> DataFrame:
    wide = X.completion_series(t.arms, BUCKET_NS, LBS)
    return rounded(X.series_scores(wide, ["mbps", "iops"]))


DEPTH_SQL = (
    SPAN_SQL
    + f""", d0 AS (SELECT arm, ts_ns, cpu, seq, rwbs LIKE '%R%' rd, CASE action WHEN 'D' THEN 1 ELSE -1 END dl FROM arms WHERE action IN ('D', 'C')),
 d1 AS (SELECT *, sum(dl) OVER (PARTITION BY arm ORDER BY ts_ns, dl, rd, cpu, seq ROWS UNBOUNDED PRECEDING) s FROM d0),
 d2 AS (SELECT arm, ts_ns // {BUCKET_NS} bucket, s - least(0, min(s) OVER (PARTITION BY arm ORDER BY ts_ns, dl, rd, cpu, seq ROWS UNBOUNDED PRECEDING)) qd FROM d1),
 dep AS (SELECT grid.bucket, coalesce(avg(qd) FILTER (arm = 0), 0) cap_qd, coalesce(avg(qd) FILTER (arm = 1), 0) rep_qd
         FROM grid LEFT JOIN d2 USING (bucket) GROUP BY grid.bucket)
"""
)


@query(
    "fidelity_depth_scores",
    "D8 W2",
    DEPTH_SQL + f"SELECT round(corr(cap_qd, rep_qd), 6) qd_corr, round({smape_sql('cap_qd', 'rep_qd')}, 6) qd_smape FROM dep",
    "arms",
)
def fidelity_depth_scores(t: Tables) -> DataFrame:
    return rounded(X.series_scores(X.depth_series(t.arms, BUCKET_NS), ["qd"]))


def distances_sql(source: str, by: str) -> str:
    """KS and JSD of ``v`` by ``arm`` within ``by`` over the rows of ``source``."""
    return f"""
 en AS (SELECT {by}, min(v) lo, max(v) hi, count(*) FILTER (arm = 0) na, count(*) FILTER (arm = 1) nb FROM {source} GROUP BY ALL),
 vc AS (SELECT {by}, v, count(*) FILTER (arm = 0) a, count(*) FILTER (arm = 1) b FROM {source} GROUP BY ALL),
 cu AS (SELECT *, sum(a) OVER (PARTITION BY {by} ORDER BY v) ca, sum(b) OVER (PARTITION BY {by} ORDER BY v) cb FROM vc),
 ks AS (SELECT {by}, max(abs(ca / na - cb / nb)) ks FROM cu JOIN en USING ({by}) GROUP BY ALL),
 bi AS (SELECT {by}, least(floor((v - lo) / (hi - lo) * 100), 99) bin, count(*) FILTER (arm = 0) / any_value(na) p,
               count(*) FILTER (arm = 1) / any_value(nb) q FROM {source} JOIN en USING ({by}) GROUP BY ALL),
 js AS (SELECT {by}, sum(p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12)) + q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))) / 2 jsd FROM bi GROUP BY ALL)
"""


SIZE_SQL = f"""
sz AS (SELECT arm, nblocks * {LBS} v, unnest(['all', CASE WHEN rwbs LIKE '%R%' THEN 'reads' ELSE 'writes' END]) AS class
       FROM arms WHERE action = 'Q' AND nblocks > 0), """


@query(
    "fidelity_size_distances",
    "D3 D4 D8",
    SIZE_SQL + distances_sql("sz", "class") + "SELECT class, round(ks, 9) ks, round(jsd, 9) jsd FROM ks JOIN js USING (class)",
    "arms",
)
def fidelity_size_distances(t: Tables) -> DataFrame:
    return rounded(X.size_distances(t.arms, LBS), 9)


LAT_SQL = (
    LIFE_SQL.replace("FROM blk", "FROM arms")
    .replace("PARTITION BY sector, nblocks", "PARTITION BY arm, sector, nblocks")
    .replace("SELECT sector, nblocks, CAST(item", "SELECT arm, sector, nblocks, CAST(item")
    .replace("lat AS (SELECT is_read,", "lat AS (SELECT arm, is_read,")
    + """, lv AS (SELECT arm, us v, kind || CASE WHEN is_read THEN '_read' ELSE '_write' END grp FROM latp WHERE kind <> 'q2d'), """
)


@query(
    "fidelity_latency_distances",
    "D3 D4 D8",
    LAT_SQL + distances_sql("lv", "grp") + "SELECT grp, round(ks, 9) ks, round(jsd, 9) jsd FROM ks JOIN js USING (grp)",
    "arms",
)
def fidelity_latency_distances(t: Tables) -> DataFrame:
    rows = X.latency_distances(t.arms)
    side = F.when(F.col("is_read"), "read").otherwise("write")
    return rounded(rows.select(F.concat_ws("_", "kind", side).alias("grp"), "ks", "jsd"), 9)


CELL_SQL = (
    SPAN_SQL
    + f""", ev AS (SELECT * FROM arms WHERE action = 'Q' AND nblocks > 0 AND sector > 0),
 mx AS (SELECT max(sector) mx FROM ev), nt AS (SELECT greatest(1, least(200, common // {BUCKET_NS})) nt, common FROM p),
 cells AS (SELECT CAST(least(floor(sector / (mx + 1) * 64), 63) AS BIGINT) si, CAST(least(floor(ts_ns / common * nt), nt - 1) AS BIGINT) ti,
                  count(*) FILTER (arm = 0) cap, count(*) FILTER (arm = 1) rep FROM ev, mx, nt GROUP BY ALL),
 prof AS (SELECT s.si, CAST(coalesce(sum(cap), 0) AS BIGINT) cap, CAST(coalesce(sum(rep), 0) AS BIGINT) rep
          FROM (SELECT unnest(range(64)) si) s LEFT JOIN cells USING (si) GROUP BY s.si)
"""
)


@query("fidelity_address_cells", "D12 A10", CELL_SQL + "SELECT *, cap - rep diff FROM cells", "arms")
def fidelity_address_cells(t: Tables) -> DataFrame:
    return X.address_cells(t.arms, BUCKET_NS, 64)


@query("fidelity_address_profile", "D12", CELL_SQL + "SELECT *, cap - rep diff FROM prof", "arms")
def fidelity_address_profile(t: Tables) -> DataFrame:
    return X.address_profile(X.address_cells(t.arms, BUCKET_NS, 64), 64)


@query(
    "fidelity_address_score",
    "D8 D12",
    CELL_SQL + "SELECT round(corr(cap, rep), 6) lba_freq_corr FROM prof",
    "arms",
)
def fidelity_address_score(t: Tables) -> DataFrame:
    profile = X.address_profile(X.address_cells(t.arms, BUCKET_NS, 64), 64)
    corr = pearson(F.col("cap").cast("double"), F.col("rep").cast("double"))
    return profile.agg(r6(corr).alias("lba_freq_corr"))


def _flat(name: str, columns: list[str]) -> str:
    parts = (f"SELECT '{c}' metric, CAST({c} AS DOUBLE) AS value FROM ({REGISTRY[name].sql})" for c in columns)
    return " UNION ALL ".join(parts)


def _stems(name: str, stem: str) -> str:
    parts = (
        f"SELECT {stem} || '_{k}' metric, round({k}, 6) AS value FROM ({REGISTRY[name].sql})" for k in ("ks", "jsd")
    )
    return " UNION ALL ".join(parts)


METRICS_SQL = " UNION ALL ".join(
    [
        _flat("fidelity_rate_scores", ["q_rate_corr_read", "q_rate_corr_write", "q_rate_smape"]),
        _flat("fidelity_throughput_scores", ["mbps_corr", "mbps_smape", "iops_corr", "iops_smape"]),
        _flat("fidelity_depth_scores", ["qd_corr", "qd_smape"]),
        _flat("fidelity_address_score", ["lba_freq_corr"]),
        _stems("fidelity_size_distances", "'size_' || class"),
        _stems("fidelity_latency_distances", "'lat_' || grp"),
    ]
)


@query("fidelity_metrics", "D8 K4", METRICS_SQL)
def fidelity_metrics(t: Tables) -> DataFrame:
    return rounded(X.metrics(t.arms, BUCKET_NS, LBS, 64))


@query(
    "fidelity_score",
    "D9",
    f"""WITH m AS ({METRICS_SQL}),
      s AS (SELECT avg(value) FILTER (metric LIKE '%corr%') correlation, 1 - avg(value) FILTER (metric LIKE '%smape%') one_minus_smape,
                   1 - avg(value) FILTER (metric LIKE '%\\_ks%' ESCAPE '\\') one_minus_ks FROM m),
      o AS (SELECT *, (correlation + one_minus_smape + one_minus_ks) / 3 overall FROM s)
      SELECT round(correlation, 4) correlation, round(one_minus_smape, 4) one_minus_smape, round(one_minus_ks, 4) one_minus_ks, round(overall, 4) overall,
             CASE WHEN overall > 0.95 THEN 'EXCELLENT' WHEN overall > 0.9 THEN 'GOOD' WHEN overall > 0.8 THEN 'FAIR' ELSE 'POOR' END grade FROM o""",
)
def fidelity_score(t: Tables) -> DataFrame:
    return rounded(X.score(X.metrics(t.arms, BUCKET_NS, LBS, 64)), 4)


STREAM_SQL = "st AS (SELECT cmd.*, CASE tid % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'device' ELSE 'capture' END stream FROM cmd)"


def _streams(t: Tables) -> DataFrame:
    side = F.col("tid") % 5
    name = F.when(side == 0, "file").when(side == 1, "device").otherwise("capture")
    return t.cmd.withColumn("stream", name)


@query(
    "replay_stream_referee",
    "A54",
    STREAM_SQL
    + """, a AS (SELECT stream, count(*) cmds, count(*) FILTER (op_name = 'write') writes, round(sum(bytes) / 1e6, 6) mb,
              round(sum(bytes) / count(*) / 1024, 6) avg_kb, round((max(ts_ns) - min(ts_ns)) / 1e9, 6) dur_s FROM st GROUP BY stream)
      SELECT *, round((cmds - (SELECT cmds FROM a WHERE stream = 'capture')) * 100 / (SELECT cmds FROM a WHERE stream = 'capture'), 6) inflation_pct FROM a""",
    "cmd",
)
def replay_stream_referee(t: Tables) -> DataFrame:
    return rounded(R.stream_referee(_streams(t), "stream", "capture"))


@query(
    "replay_common_sizes",
    "T7",
    STREAM_SQL
    + """, c AS (SELECT stream, bytes, count(*) n FROM st GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY n DESC, bytes) rank, sum(n) OVER (PARTITION BY stream) total FROM c)
      SELECT stream, rank, bytes, n, CAST(n * 100 // total AS BIGINT) pct FROM r WHERE rank <= 3""",
    "cmd",
)
def replay_common_sizes(t: Tables) -> DataFrame:
    rows = R.common_sizes(_streams(t), "stream")
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(
    "replay_log_lines",
    "K2",
    f"""r AS (SELECT *, (SELECT min(ts_ns) FROM cmd) t0, (SELECT max(ts_ns) FROM cmd) t1 FROM cmd)
      SELECT 1 part, ts_ns, op_name, slba, bytes, (ts_ns - t0) // 1000000 || ' /dev/x ' || op_name || ' ' || slba * 512 || ' ' || bytes AS value FROM r
      UNION ALL SELECT unnest([0, 0, 0, 2]), unnest([0, 1, 2, 0]), NULL, NULL, NULL, unnest(['fio version 3 iolog', '0 /dev/x add', '0 /dev/x open', (max(ts_ns) - min(ts_ns)) // 1000000 || ' /dev/x close']) FROM cmd""",
    "cmd",
)
def replay_log_lines(t: Tables) -> DataFrame:
    return replay_log(t.cmd, "/dev/x", ["op_name", "slba", "bytes"])
