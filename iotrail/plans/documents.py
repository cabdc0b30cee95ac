"""Whole documents: exports line by line, nested reports and all kinds of page monitor documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail import schemas, sinks
from iotrail.functions import scalar as S
from iotrail.operators import documents as D
from iotrail.operators import objects as O
from iotrail.operators import pages as G
from iotrail.plans.blocks import rounded
from iotrail.plans.objects import PAIR_SQL, nearest, paired
from iotrail.plans.parsing import capture_lines
from iotrail.plans.registry import VIEW_SQL, Tables, query
from iotrail.plans.syscalls import NR_SQL, REF_SQL, TREE_SQL, number
from iotrail.session import scratch
from iotrail.sources import records

#: How long after the start of the trace a fork takes place, for each step of its number.
STEP_NS = 3_600_000_000_000


def _comma(order: str, value: str) -> str:
    return f"CASE WHEN row_number() OVER (ORDER BY {order}) = 1 THEN '' ELSE ',' END || {value}"


@query(
    "io_path_export",
    "K5 M17 M18",
    "WITH RECURSIVE "
    + f"vma AS ({VIEW_SQL['vma']}), "
    + TREE_SQL.strip()
    + ", "
    + REF_SQL.strip()
    + f""",
    top AS (SELECT root FROM tr GROUP BY root ORDER BY count(*) DESC, root LIMIT 1),
    fam AS (SELECT pid, CASE WHEN birth_ns < 0 THEN -1 ELSE birth_ns * {STEP_NS} END born, root FROM tr),
    own AS (SELECT pid, born FROM fam WHERE root = (SELECT root FROM top)),
    ev AS (SELECT rv.*, (epoch_us(e.ts) - (SELECT min(epoch_us(ts)) FROM events)) * 1000 ts_ns, user_id % 16 fd, CAST(floor(value * 100) AS BIGINT) length FROM rv JOIN events e USING (event_id)),
    tk AS (SELECT ev.* FROM ev ASOF JOIN fam ON ev.pid = fam.pid AND ev.ts_ns >= fam.born WHERE fam.root = (SELECT root FROM top)),
    mp AS (SELECT tk.*, v.start_addr sa, v.end_addr ea, v.pathname mpath FROM tk LEFT JOIN (SELECT event_id, start_addr FROM best WHERE r = 1) b USING (event_id) LEFT JOIN vma v ON v.pid = tk.pid AND v.start_addr = b.start_addr),
    fk AS (SELECT pe.ts * {STEP_NS} ts, parent, child, CASE WHEN pe.born < 0 THEN -1 ELSE pe.born * {STEP_NS} END born FROM pe JOIN own ON own.pid = child AND own.born = pe.ts * {STEP_NS}),
    ch AS (SELECT parent, born, string_agg(child, ',' ORDER BY ts) c FROM fk GROUP BY ALL)
    SELECT 0 AS section, CAST(0 AS BIGINT) "at", CAST(0 AS BIGINT) tie,
           '{{"pid":' || root || ',"follow_forks":true,"event_count":' || (SELECT count(*) FROM tk) || ',"tracked_pids":[' AS value FROM top
    UNION ALL SELECT 1, pid, 0, {_comma("pid", "pid")} FROM (SELECT DISTINCT pid FROM own)
    UNION ALL SELECT 2, 0, 0, '],"process_tree":{{"root_pid":' || root || ',"root_comm":"p' || root || '","forks":[' FROM top
    UNION ALL SELECT 3, ts, child, {_comma("ts, child", f"'{{\"timestamp_ns\":' || ts || ',\"parent_pid\":' || parent || ',\"child_pid\":' || child || ',\"parent_comm\":\"p' || parent || '\",\"child_comm\":\"p' || child || '\"}}'")} FROM fk
    UNION ALL SELECT 4, 0, 0, '],"children":['
    UNION ALL SELECT 5, parent, born, {_comma("parent, born", f"'{{\"pid\":' || parent || ',\"birth_ns\":' || born || ',\"children\":[' || c || ']}}'")} FROM ch
    UNION ALL SELECT 6, 0, 0, ']}},"events":['
    UNION ALL SELECT 7, ts_ns, event_id, {_comma("ts_ns, event_id", f"'{{\"syscall\":{{\"type\":\"' || syscall || '\",\"pid\":' || pid || ',\"comm\":\"p' || pid || '\",\"fd\":' || fd || ',\"length\":' || length || ',\"offset\":' || event_id * 512 || ',\"timestamp_ns\":' || ts_ns || ',\"latency_us\":' || event_id % 1000 || ',\"filename\":\"' || filename || '\"}},\"fd_info\":\"' || path || '\",\"mapping\":' || CASE WHEN sa IS NULL THEN 'null' ELSE '{{\"start\":\"0x' || lower(to_hex(sa)) || '\",\"end\":\"0x' || lower(to_hex(ea)) || '\",\"size_kb\":' || (ea - sa) // 1024 || ',\"permissions\":\"r' || CASE WHEN sa // 1048576 % 3 = 0 THEN 'w' ELSE '-' END || '\",\"file\":\"' || mpath || '\"}}' END || ',\"page_events\":' || event_id % 4 || '}}'")} FROM mp
    UNION ALL SELECT 8, 0, 0, ']}}'""",
)
def io_path_export(t: Tables) -> DataFrame:
    """The lines of the export of the root with the largest family."""
    key = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("p"), c)
    forks = t.part.select((S.int_div(key, 3) % 150).alias("parent_pid"), (key % 150).alias("child_pid"), (key * STEP_NS).alias("ts_ns"))
    forks = forks.withColumns({"parent_comm": name(F.col("parent_pid")), "child_comm": name(F.col("child_pid"))})
    k, kind = F.col("event_id"), F.col("event_type")
    events = t.events.select(
        "event_id", (F.col("user_id") % 20).alias("pid"), ((F.unix_micros(F.col("ts").cast("timestamp")) - t.epoch_us) * 1000).alias("ts_ns"), (F.col("user_id") % 16).alias("fd"),
        F.floor(F.col("value") * 100).cast("long").alias("length"), (k * 512).alias("file_offset"), (k % 1000).alias("latency_us"), (k % 4).alias("page_events"),
        F.when(kind == "view", "mmap").when(kind == "signup", "openat").otherwise("pread64").alias("syscall"),
        F.when(kind == "view", k * 104729 % 2097152000).otherwise(0).alias("return_value"),
        F.when(kind == "view", k * 7919 % 2097152000).otherwise(0).alias("address"),
        F.when(kind == "click", F.concat(F.lit("/data/Brand#"), k % 40)).otherwise("").alias("path"),
        F.when(kind == "signup", F.concat(F.lit("and#"), k % 30)).otherwise("").alias("filename"),
    ).withColumn("comm", name(F.col("pid")))
    perms = F.when(S.int_div(F.col("start_addr"), 1048576) % 3 == 0, "rw").otherwise("r-")
    return sinks.json_document(*D.io_path_document(events, forks, t.vma.withColumn("perms", perms)))


@query(
    "syscall_summary_export",
    "K6 M15 M19",
    f"""ev AS (SELECT *, {NR_SQL} nr, 'p' || pid comm, CASE WHEN event_id % 9 = 1 THEN -(event_id % 30 + 1) ELSE size END ret,
              CASE WHEN syscall_name = 'openat' THEN '/data/f' || size % 37 ELSE '' END filename, CASE WHEN syscall_name = 'openat' THEN event_id % 4 END fl FROM sysev),
      cl AS (SELECT syscall_name, nr, count(*) n, CAST(sum(size) AS BIGINT) b, CAST(avg(size) AS DECIMAL(20,2)) a FROM ev GROUP BY ALL),
      cr AS (SELECT *, row_number() OVER (ORDER BY b DESC, syscall_name) r FROM cl),
      pc AS (SELECT pid, comm, syscall_name, count(*) n, CAST(sum(size) AS BIGINT) b FROM ev GROUP BY ALL),
      pr AS (SELECT pid, comm, CAST(sum(n) AS BIGINT) n, CAST(sum(b) AS BIGINT) b,
                    string_agg('{{"syscall_name":"' || syscall_name || '","count":' || n || ',"total_size":' || b || '}}', ',' ORDER BY syscall_name) s FROM pc GROUP BY pid, comm)
      SELECT 0 AS section, CAST(0 AS BIGINT) "at", CAST(0 AS BIGINT) tie, '{{"metadata":{{"total_events":' || count(*) || ',"monitoring_duration":' || CAST((max(ts_ns) - min(ts_ns)) / 1e9 AS DECIMAL(20,3))
             || ',"unique_syscalls":' || count(DISTINCT syscall_name) || ',"unique_processes":' || count(DISTINCT pid) || ',"workload_label":"trace","detailed_logging":true}},"summary":{{"total_io_bytes":'
             || CAST(sum(size) FILTER (syscall_name IN ('read', 'pread64', 'pwrite64')) AS BIGINT) || ',"most_active_process":"p' || (SELECT pid FROM pr ORDER BY n DESC, pid LIMIT 1)
             || '","most_active_process_pid":' || (SELECT pid FROM pr ORDER BY n DESC, pid LIMIT 1) || '}},"aggregated_stats":{{"all_syscalls":[' AS value FROM ev
      UNION ALL SELECT 1, r, 0, {_comma("r", f"'{{\"syscall_nr\":' || nr || ',\"syscall_name\":\"' || syscall_name || '\",\"total_size\":' || b || ',\"count\":' || n || ',\"avg_size\":' || a || '}}'")} FROM cr
      UNION ALL SELECT 2, 0, 0, ']}},"process_analysis":['
      UNION ALL SELECT 3, -n, pid, {_comma("-n, pid", f"'{{\"pid\":' || pid || ',\"process_name\":\"' || comm || '\",\"total_events\":' || n || ',\"total_size\":' || b || ',\"syscalls\":[' || s || ']}}'")} FROM pr
      UNION ALL SELECT 4, 0, 0, '],"raw_events":['
      UNION ALL SELECT 5, ts_ns, event_id, {_comma("ts_ns, event_id", f"'{{\"timestamp_ns\":' || ts_ns || ',\"timestamp_ms\":' || CAST(CAST(ts_ns AS DECIMAL(20,0)) / 1000000 AS DECIMAL(20,3)) || ',\"pid\":' || pid || ',\"process_name\":\"' || comm || '\",\"syscall_nr\":' || nr || ',\"syscall_name\":\"' || syscall_name || '\",\"fd\":' || fd || ',\"size\":' || size || ',\"offset\":' || file_offset || ',\"filename\":\"' || filename || '\",\"open_flags_hex\":' || coalesce(fl, 0) || ',\"open_flags_str\":\"' || CASE fl WHEN 0 THEN 'O_RDONLY' WHEN 1 THEN 'O_WRONLY' WHEN 2 THEN 'O_RDWR' WHEN 3 THEN 'O_ACCMODE' ELSE '' END || '\",\"io_direction\":\"' || CASE WHEN nr IN (0, 17) THEN 'READ' WHEN nr = 18 THEN 'WRITE' ELSE 'NONE' END || '\",\"ret\":' || ret || ',\"error_code\":' || greatest(-ret, 0) || '}}'")} FROM ev
      UNION ALL SELECT 6, 0, 0, ']}}'""",
    "sysev",
)
def syscall_summary_export(t: Tables) -> DataFrame:
    """The lines of the summary document of all calls."""
    k, opens = F.col("event_id"), F.col("syscall_name") == "openat"
    events = t.sysev.withColumns(
        {
            "syscall_nr": number(F.col("syscall_name")),
            "comm": F.concat(F.lit("p"), "pid"),
            "ret": F.when(k % 9 == 1, -(k % 30 + 1)).otherwise(F.col("size")),
            "filename": F.when(opens, F.concat(F.lit("/data/f"), F.col("size") % 37)).otherwise(""),
            "open_flags": F.when(opens, k % 4),
        }
    )
    return sinks.json_document(*D.syscall_document(events, "trace"))


@query(
    "label_report_documents",
    "K4 M10",
    PAIR_SQL
    + f""", fc AS (SELECT tid, min(ts_ns) fc FROM cmd GROUP BY tid),
       r AS (SELECT trace_id % 2 l, op, ts_ns - ts_start_ns span FROM obj WHERE error IS NULL)
       SELECT 'kv' || tid % 2 AS label, 'commands' report, op_name AS "key", count(*) n, CAST(sum(bytes) AS BIGINT) bytes, {nearest('dur_ns', 0.5)} p50, {nearest('dur_ns', 0.99)} p99
       FROM paired GROUP BY tid % 2, op_name
       UNION ALL SELECT 'kv' || l, 'objects', op, count(*), NULL, {nearest('span', 0.5)}, {nearest('span', 0.99)} FROM r GROUP BY l, op""",
    "cmd obj",
)
def label_report_documents(t: Tables) -> DataFrame:
    """A document per label, read back as rows."""
    of = lambda c: F.concat(F.lit("kv"), F.col(c) % 2)
    commands = O.command_report(paired(t).withColumn("label", of("tid")), ["label", "op_name"])
    objects = O.object_report(t.obj.withColumn("label", of("trace_id")), t.cmd, ["label", "op"])
    docs = sinks.label_documents({"commands": (commands, "op_name"), "objects": (objects, "op")})
    schema = "label string, commands map<string, struct<n:bigint,bytes:bigint,p50:bigint,p99:bigint>>, objects map<string, struct<n:bigint,span_p50:bigint,span_p99:bigint>>"
    read = docs.select(F.from_json("value", schema).alias("d")).select("d.*")
    first = read.select("label", F.lit("commands").alias("report"), F.explode("commands").alias("key", "m")).select("label", "report", "key", "m.*")
    second = read.select("label", F.lit("objects").alias("report"), F.explode("objects").alias("key", "m"))
    return first.unionByName(second.select("label", "report", "key", "m.n", F.lit(None).cast("long").alias("bytes"), F.col("m.span_p50").alias("p50"), F.col("m.span_p99").alias("p99")))


def _monitor_documents(t: Tables) -> DataFrame:
    """A page monitor document per part: six kinds, a mode that has no rows of its own, and a text that is cut off."""
    head = "'pid', p_partkey % 20, 'start', concat('0x', lower(hex(p_partkey * 1048576)))"
    twice = lambda x, v="i", n=1: f"transform(sequence(0, {n}), {v} -> named_struct({x}))"
    shots = twice("'iter', i, 'blocks', transform(sequence(0, 3), b -> (p_partkey + b * 3 + i) % 101)")
    soft = twice("'iter', i, 'ts_ms', 5, 'present', p_partkey % 40 + i, 'newly_dirty', p_partkey % 30, 'dirty_kb', p_partkey % 30 * 4, 'bitmap', '0101'")
    timed = twice("'iter', i, 'elapsed_ms', i * 250, 'present', p_partkey % 40, 'dirty', p_partkey % 30 + i, 'dirty_kb', (p_partkey % 30 + i) * 4")
    files = twice("'pathname', concat(p_brand, '/', j), 'total_pages', p_partkey % 50 + j, 'present', p_partkey % 40, 'dirty', p_partkey % 30, 'dirty_pct', p_partkey % 9 / 2", "j")
    tracked = twice("'iter', i, 'files', " + twice("'path', concat(p_brand, '/', j), 'dirty', p_partkey % 30 + i + j, 'dirty_kb', (p_partkey % 30 + i + j) * 4", "j"))
    unified = twice(f"'pathname', concat(p_brand, '/', j), 'snapshots', {shots}", "j")
    docs = [
        f"'mode', 'snapshot', {head}, 'total_pages', p_partkey % 50, 'present', p_partkey % 40, 'dirty', p_partkey % 30, 'dirty_pct', p_partkey % 100 / 2, 'pages', 'DPS.'",
        f"'mode', 'softdirty', {head}, 'snapshots', {soft}",
        f"'mode', 'heatmap', {head}, 'snapshots', {shots}",
        f"'mode', 'timeline', {head}, 'samples', {timed}",
        f"'mode', 'region_all', {head}, 'files', {files}, 'tracking', {tracked}",
        f"'mode', 'file_unified', {head}, 'files', {unified}",
        f"'mode', 'sub_page_diff', {head}",
    ]
    chain = "case p_partkey % 8 " + " ".join(f"when {i} then to_json(named_struct({d}))" for i, d in enumerate(docs)) + " else '{\"mode\":\"heatmap\",\"pid\":' end"
    return t.part.select("p_partkey", F.expr(chain).alias("value"))


@query(
    "page_monitor_kinds",
    "S22",
    """i AS (SELECT unnest([0, 1]) i), j AS (SELECT unnest([0, 1]) j), b AS (SELECT unnest([0, 1, 2, 3]) b),
      p AS (SELECT p_partkey, p_partkey % 20 pid, '0x' || lower(to_hex(p_partkey * 1048576)) item, p_brand || '/' f, p_partkey % 50 pages, p_partkey % 40 present, p_partkey % 30 dirty, p_partkey % 8 m FROM part)
      SELECT p_partkey, 'snapshot' kind, pid, item, CAST(NULL AS BIGINT) iter, CAST(NULL AS BIGINT) "position", pages, present, dirty, CAST(NULL AS BIGINT) dirty_kb, p_partkey % 100 / 2 dirty_pct, 'DPS.' detail FROM p WHERE m = 0
      UNION ALL SELECT p_partkey, 'softdirty', pid, item, i, NULL, NULL, present + i, dirty, dirty * 4, NULL, '0101' FROM p, i WHERE m = 1
      UNION ALL SELECT p_partkey, 'heatmap', pid, item, i, b, NULL, NULL, NULL, NULL, (p_partkey + b * 3 + i) % 101, NULL FROM p, i, b WHERE m = 2
      UNION ALL SELECT p_partkey, 'timeline', pid, item, i, NULL, NULL, present, dirty + i, (dirty + i) * 4, NULL, NULL FROM p, i WHERE m = 3
      UNION ALL SELECT p_partkey, 'region_all', pid, f || j, NULL, NULL, pages + j, present, dirty, NULL, p_partkey % 9 / 2, NULL FROM p, j WHERE m = 4
      UNION ALL SELECT p_partkey, 'region_all', pid, f || j, i, NULL, NULL, NULL, dirty + i + j, (dirty + i + j) * 4, NULL, NULL FROM p, i, j WHERE m = 4
      UNION ALL SELECT p_partkey, 'file_unified', pid, f || j, i, b, NULL, NULL, NULL, NULL, (p_partkey + b * 3 + i) % 101, NULL FROM p, i, j, b WHERE m = 5
      UNION ALL SELECT p_partkey, 'other', pid, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE m = 6
      UNION ALL SELECT p_partkey, 'bad', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE m = 7""",
)
def page_monitor_kinds(t: Tables) -> DataFrame:
    return records.monitor_rows(_monitor_documents(t))


@query(
    "monitor_method_comparison",
    "A77",
    """s AS (SELECT unnest([0, 1]) i),
      c AS (SELECT CASE WHEN p_partkey % 3 > 0 THEN 'sub_page_diff' WHEN i = 0 THEN 'page flags' ELSE 'memory diff' END "method", p_partkey % 100 / 4 + i wall_ms, (p_partkey + i) % 50 / 2 cpu_pct,
                   p_partkey % 1000 + i peak_rss_kb, p_partkey * 4096 bytes_read, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 64 + i END cb, CASE WHEN p_partkey % 3 > 0 THEN i END cp FROM part, s)
      SELECT "method", count(*) n, round(avg(wall_ms), 6) avg_wall_ms, round(max(wall_ms), 6) peak_wall_ms, round(avg(cpu_pct), 6) avg_cpu_pct, max(peak_rss_kb) peak_rss_kb,
             round(avg(bytes_read), 6) avg_bytes_read, CAST(sum(cb) AS BIGINT) changed_bytes, CAST(sum(cp) AS BIGINT) changed_pages FROM c GROUP BY "method\"""",
)
def monitor_method_comparison(t: Tables) -> DataFrame:
    """Diffs within pages next to runs that compare methods."""
    cost = "'wall_ms', p_partkey % 100 / 4 + i, 'cpu_pct', (p_partkey + i) % 50 / 2, 'peak_rss_kb', p_partkey % 1000 + i, 'bytes_read', p_partkey * 4096"
    runs = f"transform(sequence(0, 1), i -> named_struct('label', if(i = 0, 'page flags', 'memory diff'), {cost}))"
    diffs = f"transform(sequence(0, 1), i -> named_struct('iter', i, 'total_changed_bytes', p_partkey % 64 + i, 'total_changed_pages', i, 'overhead', named_struct('label', 'sub_page_diff', {cost})))"
    doc = f"if(p_partkey % 3 > 0, to_json(named_struct('mode', 'sub_page_diff', 'snapshots', {diffs})), to_json(named_struct('mode', 'overhead_bench', 'benchmarks', {runs})))"
    return rounded(G.method_comparison(records.monitor_costs(t.part.select(F.expr(doc).alias("value")))))


@query(
    "compressed_capture_families",
    "S6",
    """f AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN 'corrupt' WHEN l_orderkey % 10 = 9 THEN 'clock_anchor' WHEN l_orderkey % 10 = 8 THEN 'drops'
              WHEN l_orderkey % 10 = 7 THEN 'semantic' ELSE 'nvme_cmd' END family, l_orderkey, l_linenumber FROM lineitem)
      SELECT family, count(*) "rows", CAST(coalesce(sum(l_linenumber) FILTER (family = 'drops'), 0) AS BIGINT) dropped FROM f GROUP BY family""",
)
def compressed_capture_families(t: Tables) -> DataFrame:
    """The capture as gzip files, one per task, read by their suffix."""
    folder = scratch(t.spark, "capture")
    capture_lines(t).write.option("compression", "gzip").text(folder)
    rows = records.read_capture(t.spark, folder, schemas.DEVICE)
    whole = F.col(records.CORRUPT).isNull()
    return records.lost_events(rows.withColumn("dropped", F.when(whole, F.col("dropped"))))
