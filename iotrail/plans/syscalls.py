"""System call, descriptor, process and mapping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions import scalar as S

from iotrail.operators import syscalls as Y
from iotrail.operators.blocks import count_if
from iotrail.plans.blocks import r6, rounded
from iotrail.plans.registry import Tables, query
from iotrail.sinks import process_documents

# Numbers of the calls in the view.
NUMBERS = {"read": 0, "pread64": 17, "pwrite64": 18, "openat": 257, "lseek": 8}
NR_SQL = "CASE syscall_name WHEN 'read' THEN 0 WHEN 'pread64' THEN 17 WHEN 'pwrite64' THEN 18 WHEN 'openat' THEN 257 ELSE 8 END"


def number(name):
    chain = F
    for call, nr in NUMBERS.items():
        chain = chain.when(name == call, nr)
    return chain


@query(
    "syscall_enter_exit_pairs",
    "J5 P30 X11",
    f"""e AS (SELECT *, {NR_SQL} nr, event_id % 2 = 0 ent, CASE WHEN event_id % 9 = 1 THEN -(event_id % 30 + 1) ELSE size END ret FROM sysev),
      l AS (SELECT *, lag(ent) OVER w pe, lag(nr) OVER w pn, lag(fd) OVER w pf, lag(size) OVER w ps, lag(file_offset) OVER w po, lag(ts_ns) OVER w pt
            FROM e WINDOW w AS (PARTITION BY tid ORDER BY ts_ns, event_id))
      SELECT event_id, tid, nr syscall_nr, pf fd, ps requested, po file_offset, greatest(ret, 0) transferred,
             CASE WHEN ret < 0 THEN -ret END error_code, ts_ns - pt latency_ns FROM l WHERE NOT ent AND pe AND pn = nr""",
    "sysev",
)
def syscall_enter_exit_pairs(t: Tables) -> DataFrame:
    k = F.col("event_id")
    events = t.sysev.withColumns(
        {
            "syscall_nr": number(F.col("syscall_name")),
            "phase": F.when(k % 2 == 0, "enter").otherwise("exit"),
            "ret": F.when(k % 9 == 1, -(k % 30 + 1)).otherwise(F.col("size")),
        }
    )
    return Y.enter_exit_pairs(events)


def _opens(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/data/f"), F.col("size") % 37)
    return t.sysev.filter("syscall_name = 'openat'").select(
        "pid", "fd", F.col("ts_ns").alias("open_ns"), path.alias("path")
    )


PATH_SQL = """
op AS (SELECT pid, fd, ts_ns open_ns, '/data/f' || size % 37 path FROM sysev WHERE syscall_name = 'openat'),
wp AS (SELECT s.*, op.path FROM sysev s ASOF LEFT JOIN op ON s.pid = op.pid AND s.fd = op.fd AND s.ts_ns >= op.open_ns)
"""


@query("descriptor_paths", "J14 M16", PATH_SQL + "SELECT event_id, path FROM wp", "sysev")
def descriptor_paths(t: Tables) -> DataFrame:
    return Y.with_paths(t.sysev, _opens(t)).select("event_id", "path")


@query(
    "file_access_table",
    "A37 T3 F14",
    PATH_SQL
    + """, a AS (SELECT path, count(*) n, CAST(sum(size) AS BIGINT) bytes, count(DISTINCT pid) pids,
              array_to_string(list_sort(list(DISTINCT syscall_name)), ',') syscalls FROM wp WHERE path LIKE '%/data/%' GROUP BY path)
      SELECT *, row_number() OVER (ORDER BY n DESC, path) rank FROM a QUALIFY rank <= 15""",
    "sysev",
)
def file_access_table(t: Tables) -> DataFrame:
    best = Y.file_access(Y.with_paths(t.sysev, _opens(t)), "/data/", 15)
    return best.withColumns({"rank": F.col("rank").cast("long"), "syscalls": F.array_join("syscalls", ",")})


@query(
    "syscall_totals",
    "A28 T2",
    """SELECT syscall_name, count(*) "count", CAST(sum(size) AS BIGINT) bytes, round(avg(size), 6) avg_bytes,
       row_number() OVER (ORDER BY sum(size) DESC, syscall_name) rank FROM sysev GROUP BY syscall_name""",
    "sysev",
)
def syscall_totals(t: Tables) -> DataFrame:
    return rounded(Y.ranked_totals(t.sysev, "syscall_name")).withColumn("rank", F.col("rank").cast("long"))


BREAK_SQL = """
pb AS (SELECT pid, syscall_name, count(*) "count", CAST(sum(size) AS BIGINT) bytes, avg(size) avg_bytes,
              count(*) * 100 / sum(count(*)) OVER (PARTITION BY pid) pct_of_process FROM sysev GROUP BY pid, syscall_name)
"""


@query(
    "process_breakdown",
    "A29 M15",
    BREAK_SQL
    + """SELECT pid, syscall_name, "count", bytes, round(avg_bytes, 6) avg_bytes, round(pct_of_process, 6) pct_of_process FROM pb""",
    "sysev",
)
def process_breakdown(t: Tables) -> DataFrame:
    return rounded(Y.process_breakdown(t.sysev))


@query(
    "process_documents",
    "K6 K5 M19",
    BREAK_SQL
    + """SELECT pid, CAST(sum("count") AS BIGINT) events, CAST(sum(bytes) AS BIGINT) bytes,
         string_agg(syscall_name || ':' || "count" || ':' || bytes, ';' ORDER BY syscall_name) syscalls FROM pb GROUP BY pid""",
    "sysev",
)
def process_documents_query(t: Tables) -> DataFrame:
    docs = process_documents(Y.process_breakdown(t.sysev), ["pid"])
    text = F.transform("syscalls", lambda s: F.concat_ws(":", s.syscall_name, s["count"], s.bytes))
    return docs.withColumn("syscalls", F.array_join(text, ";"))


@query(
    "descriptor_usage",
    "A30 F8 T3",
    """SELECT fd, count(*) ops, CAST(sum(size) AS BIGINT) bytes, array_to_string(list_sort(list(DISTINCT syscall_name)), ',') syscalls
       FROM sysev WHERE fd IS NOT NULL AND fd <> 4294967295 GROUP BY fd ORDER BY ops DESC, fd LIMIT 20""",
    "sysev",
)
def descriptor_usage(t: Tables) -> DataFrame:
    rows = Y.fd_usage(t.sysev).orderBy(F.desc("ops"), "fd").limit(20)
    return rows.withColumn("syscalls", F.array_join("syscalls", ","))


@query(
    "descriptor_usage_by_process",
    "A30",
    """SELECT pid, fd, count(*) ops, CAST(sum(size) AS BIGINT) bytes, array_to_string(list_sort(list(DISTINCT syscall_name)), ',') syscalls
       FROM sysev WHERE fd IS NOT NULL AND fd <> 4294967295 GROUP BY pid, fd""",
    "sysev",
)
def descriptor_usage_by_process(t: Tables) -> DataFrame:
    rows = Y.fd_usage(t.sysev, ["pid"])
    return rows.withColumn("syscalls", F.array_join("syscalls", ","))


def bucket_sql(size: str) -> str:
    parts = [
        f"WHEN {size} {'<=' if bound <= 512 else '<'} {bound} THEN '{label}'"
        for label, bound in S.SIZE_BUCKETS[:-1]
    ]
    return f"CASE {' '.join(parts)} ELSE '{S.SIZE_BUCKETS[-1][0]}' END"


@query(
    "size_bucket_by_process",
    "A31 P11 T3",
    f"SELECT pid, {bucket_sql('size')} bucket, count(*) n FROM sysev GROUP BY ALL",
    "sysev",
)
def size_bucket_by_process(t: Tables) -> DataFrame:
    bucket = S.size_bucket(F.col("size")).alias("bucket")
    return t.sysev.groupBy("pid", bucket).agg(F.count(F.lit(1)).alias("n"))


@query(
    "size_bucket_by_syscall",
    "A31",
    f"SELECT syscall_name, {bucket_sql('size')} bucket, count(*) n FROM sysev WHERE size > 0 GROUP BY ALL",
    "sysev",
)
def size_bucket_by_syscall(t: Tables) -> DataFrame:
    bucket = S.size_bucket(F.col("size")).alias("bucket")
    used = t.sysev.filter("size > 0")
    return used.groupBy("syscall_name", bucket).agg(F.count(F.lit(1)).alias("n"))


@query(
    "syscall_timeline",
    "A32",
    """s AS (SELECT pid, min(ts_ns) t0, max(ts_ns) - min(ts_ns) dur FROM sysev GROUP BY pid),
      b AS (SELECT *, dur // 86400000000000 + 1 n FROM s),
      e AS (SELECT pid, syscall_name, least(CASE WHEN dur > 0 THEN CAST(floor((ts_ns - t0) / (dur / n)) AS BIGINT) ELSE 0 END, n - 1) bin FROM sysev JOIN b USING (pid))
      SELECT pid, syscall_name, bin, count(*) n FROM e GROUP BY ALL""",
    "sysev",
)
def syscall_timeline(t: Tables) -> DataFrame:
    """Bins of a day, as these events are minutes apart."""
    return Y.timeline(t.sysev, 86_400_000_000_000)


@query(
    "syscall_run_summary",
    "A33",
    """SELECT count(*) total, CAST(sum(size) FILTER (syscall_name IN ('read', 'pread64', 'pwrite64')) AS BIGINT) io_bytes,
       count(*) FILTER (syscall_name IN ('openat', 'lseek')) file_ops,
       round(count(*) / (max(ts_ns) / 1e9), 9) per_second,
       (SELECT pid FROM sysev GROUP BY pid ORDER BY count(*) DESC, pid LIMIT 1) busiest_pid FROM sysev""",
    "sysev",
)
def syscall_run_summary(t: Tables) -> DataFrame:
    return Y.run_summary(t.sysev).withColumn("per_second", r6(F.col("per_second"), 9))


@query(
    "offset_series",
    "A34 F9 P47",
    """u AS (SELECT *, ts_ns - min(ts_ns) OVER (PARTITION BY pid) rel FROM sysev),
      f AS (SELECT * FROM u WHERE syscall_name IN ('pread64', 'pwrite64', 'lseek') AND file_offset <> 0),
      c AS (SELECT pid, fd, row_number() OVER (PARTITION BY pid ORDER BY count(*) DESC, fd) r FROM f GROUP BY pid, fd)
      SELECT f.pid, f.fd, round(rel / 1e9, 6) t_s, file_offset FROM f JOIN c USING (pid, fd) WHERE r <= 5""",
    "sysev",
)
def offset_series(t: Tables) -> DataFrame:
    starts = t.sysev.groupBy("pid").agg(F.min("ts_ns").alias("_t0"))
    used = t.sysev.filter(F.col("syscall_name").isin("pread64", "pwrite64", "lseek", "preadv", "pwritev"))
    rows = Y.offset_series(used).join(starts, "pid")
    rel = r6((F.col("ts_ns") - F.col("_t0")) / 1e9)
    return rows.select("pid", "fd", rel.alias("t_s"), "file_offset")


@query(
    "process_io_stats",
    "A35",
    """SELECT pid, count(*) n, CAST(coalesce(sum(size) FILTER (syscall_name IN ('read', 'pread64')), 0) AS BIGINT) bytes_read,
       CAST(coalesce(sum(size) FILTER (syscall_name = 'pwrite64'), 0) AS BIGINT) bytes_written,
       count(*) FILTER (syscall_name = 'read') n_read, count(*) FILTER (syscall_name = 'pread64') n_pread64,
       count(*) FILTER (syscall_name = 'pwrite64') n_pwrite64, count(*) FILTER (syscall_name = 'openat') n_openat,
       CASE WHEN pid % 2 = 0 THEN 'parent' ELSE 'child' END AS role FROM sysev GROUP BY pid""",
    "sysev",
)
def process_io_stats(t: Tables) -> DataFrame:
    return Y.process_io(t.sysev, t.sysev.filter("pid % 2 = 1"), ["read", "pread64", "pwrite64", "openat"])


@query(
    "sync_latency",
    "A36",
    """SELECT pid, count(*) n, round(avg(size), 6) avg_us, min(size) min_us, max(size) max_us
       FROM sysev WHERE syscall_name = 'lseek' AND size > 0 GROUP BY pid""",
    "sysev",
)
def sync_latency(t: Tables) -> DataFrame:
    """Positive latencies of one kind of call, here with the size as latency."""
    return rounded(Y.call_latency(t.sysev, ["lseek"], "size"))


INTENT_SQL = """
iv AS (SELECT * REPLACE (CASE WHEN syscall_name = 'lseek' THEN 'mmap' WHEN syscall_name = 'read' AND event_id % 3 = 0 THEN 'readv' ELSE syscall_name END AS syscall_name, size - event_id % 5 * 300 AS size) FROM sysev)
"""


def _intents(t: Tables) -> DataFrame:
    """Events with vector and mapped calls among them, some without a length."""
    k, name = F.col("event_id"), F.col("syscall_name")
    other = F.when(name == "lseek", "mmap").when((name == "read") & (k % 3 == 0), "readv").otherwise(name)
    return t.sysev.withColumns({"syscall_name": other, "size": F.col("size") - k % 5 * 300})


@query(
    "intent_lengths",
    "A63",
    INTENT_SQL
    + """, x AS (SELECT CASE WHEN syscall_name IN ('read', 'pread64', 'readv') THEN 'read' WHEN syscall_name = 'mmap' THEN 'map' WHEN syscall_name IN ('pwrite64', 'write') THEN 'write' END direction,
              CASE syscall_name WHEN 'readv' THEN 'vector' WHEN 'mmap' THEN 'mapped' ELSE 'plain' END "length", size FROM iv)
      SELECT direction, "length", CASE WHEN size >= 1 THEN CAST(floor(log2(size)) AS BIGINT) ELSE -1 END bucket, count(*) calls, CAST(sum(size) AS BIGINT) bytes
      FROM x WHERE direction IS NOT NULL GROUP BY ALL""",
    "sysev",
)
def intent_lengths(t: Tables) -> DataFrame:
    return Y.intent_lengths(_intents(t))


@query(
    "intent_descriptor_bytes",
    "A63",
    INTENT_SQL
    + """, x AS (SELECT *, CAST(sum(CASE WHEN syscall_name IN ('openat', 'close') THEN 1 ELSE 0 END) OVER (PARTITION BY pid, fd ORDER BY ts_ns, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) opening FROM iv)
      SELECT pid, fd, opening, CAST(coalesce(sum(size) FILTER (syscall_name IN ('read', 'pread64', 'readv')), 0) AS BIGINT) read_bytes,
             CAST(coalesce(sum(size) FILTER (syscall_name IN ('write', 'pwrite64')), 0) AS BIGINT) written_bytes FROM x GROUP BY ALL""",
    "sysev",
)
def intent_descriptor_bytes(t: Tables) -> DataFrame:
    return Y.descriptor_bytes(_intents(t))


@query(
    "intent_summary",
    "A63",
    """o AS (SELECT *, sum(CASE WHEN syscall_name IN ('openat', 'close') THEN 1 ELSE 0 END) OVER (PARTITION BY pid, fd ORDER BY ts_ns, event_id ROWS UNBOUNDED PRECEDING) epoch FROM sq),
      d AS (SELECT *, CASE WHEN syscall_name IN ('read', 'pread64') THEN 'read' WHEN syscall_name = 'pwrite64' THEN 'write' END direction,
                   CASE WHEN syscall_name IN ('pread64', 'pwrite64') THEN file_offset + size END e FROM o),
      x AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY pid, fd, epoch, direction ORDER BY ts_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ex
            FROM d WHERE direction IS NOT NULL)
      SELECT direction, count(*) calls, CAST(sum(size) AS BIGINT) bytes, min(size) smallest, max(size) largest,
             count(*) FILTER (e IS NOT NULL AND ex > 0 AND file_offset = ex) sequential,
             count(*) FILTER (e IS NOT NULL AND ex > 0 AND file_offset <> ex) random FROM x GROUP BY direction""".replace(
        "o AS (", "sq AS (SELECT * REPLACE (event_id // 40 * 512 AS file_offset, event_id % 3 * 512 AS size) FROM sysev), o AS (", 1
    ),
    "sysev",
)
def intent_summary(t: Tables) -> DataFrame:
    """Offsets and sizes are set so that some accesses follow each other."""
    k = F.col("event_id")
    events = t.sysev.withColumns({"file_offset": S.int_div(k, 40) * 512, "size": k % 3 * 512})
    return Y.intent_summary(events)


@query(
    "busiest_processes",
    "T1 T5",
    """c AS (SELECT pid, count(*) n FROM sysev GROUP BY pid ORDER BY n DESC, pid LIMIT 10)
      SELECT 'busiest' kind, pid, n FROM c
      UNION ALL SELECT 'first', pid, event_id FROM (SELECT * FROM sysev ORDER BY ts_ns, event_id LIMIT 20)
      UNION ALL SELECT 'last', pid, event_id FROM (SELECT * FROM sysev ORDER BY ts_ns DESC, event_id DESC LIMIT 20)""",
    "sysev",
)
def busiest_processes(t: Tables) -> DataFrame:
    counts = t.sysev.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "pid").limit(10).withColumn("kind", F.lit("busiest"))
    out = best.select("kind", "pid", "n")
    ends = {"first": [F.asc("ts_ns"), F.asc("event_id")], "last": [F.desc("ts_ns"), F.desc("event_id")]}
    for kind, order in ends.items():
        rows = t.sysev.orderBy(*order).limit(20)
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), "pid", F.col("event_id").alias("n")))
    return out


@query(
    "sampled_events",
    "F13 T6",
    """n AS (SELECT *, row_number() OVER (ORDER BY ts_ns, event_id) r FROM sysev) SELECT event_id, pid FROM n WHERE r % 10 = 0""",
    "sysev",
)
def sampled_events(t: Tables) -> DataFrame:
    return Y.sampled(t.sysev, ["ts_ns", "event_id"], 10).select("event_id", "pid")


TREE_SQL = """
ed AS (SELECT p_partkey ts, p_partkey // 3 % 150 parent, p_partkey % 150 child FROM part),
pe AS MATERIALIZED (SELECT e.ts, e.parent, e.child, coalesce(b.ts, -1) born FROM ed e ASOF LEFT JOIN ed b ON b.child = e.parent AND e.ts > b.ts),
tr AS (SELECT DISTINCT parent pid, CAST(-1 AS BIGINT) birth_ns, parent root, CAST(0 AS BIGINT) depth FROM pe WHERE born = -1
       UNION ALL SELECT child, ts, root, depth + 1 FROM tr JOIN pe ON pe.parent = tr.pid AND pe.born = tr.birth_ns)
"""


def _edges(t: Tables) -> DataFrame:
    """Forks of 150 process ids that are used again and again."""
    key = F.col("p_partkey")
    return t.part.select((S.int_div(key, 3) % 150).alias("parent_pid"), (key % 150).alias("child_pid"), key.alias("ts_ns"))


@query("fork_tree", "J22 M17", "WITH RECURSIVE " + TREE_SQL + "SELECT pid, birth_ns, root, depth FROM tr")
def fork_tree(t: Tables) -> DataFrame:
    return Y.fork_tree(_edges(t))


@query(
    "tracked_by_fork",
    "F7 U3",
    "WITH RECURSIVE "
    + TREE_SQL
    + """, top AS (SELECT root FROM tr GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)
    SELECT pid, birth_ns, depth FROM tr WHERE root = (SELECT root FROM top)""",
)
def tracked_by_fork(t: Tables) -> DataFrame:
    """All descendants of the root with the largest family."""
    from iotrail.session import pin

    tree = pin(Y.fork_tree(_edges(t)))
    best = tree.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(1)
    return tree.join(F.broadcast(best), "root", "left_semi").select("pid", "birth_ns", "depth")


@query(
    "process_sets",
    "F15 U3",
    """live AS (SELECT DISTINCT p_partkey % 26 pid FROM part), act AS (SELECT DISTINCT user_id % 20 + 3 pid FROM events)
      SELECT 'both' kind, pid FROM (SELECT pid FROM live INTERSECT SELECT pid FROM act)
      UNION ALL SELECT 'live_only', pid FROM (SELECT pid FROM live EXCEPT SELECT pid FROM act)
      UNION ALL SELECT 'active_only', pid FROM (SELECT pid FROM act EXCEPT SELECT pid FROM live)""",
)
def process_sets(t: Tables) -> DataFrame:
    return Y.process_sets(t.part.select((F.col("p_partkey") % 26).alias("pid")), t.events.select((F.col("user_id") % 20 + 3).alias("pid")))


REF_SQL = """
rv AS (SELECT event_id, user_id % 20 pid, CASE WHEN event_type = 'view' THEN 'mmap' WHEN event_type = 'signup' THEN 'openat' ELSE 'pread64' END syscall,
              CASE WHEN event_type = 'view' THEN event_id * 104729 % 2097152000 ELSE 0 END return_value,
              CASE WHEN event_type = 'view' THEN event_id * 7919 % 2097152000 ELSE 0 END address,
              CASE WHEN event_type = 'click' THEN '/data/Brand#' || event_id % 40 ELSE '' END AS path,
              CASE WHEN event_type = 'signup' THEN 'and#' || event_id % 30 ELSE '' END filename FROM events),
hits AS (SELECT event_id, 1 priority, start_addr FROM rv JOIN vma v ON rv.pid = v.pid AND syscall = 'mmap' AND return_value > 0 AND return_value >= start_addr AND return_value < end_addr
         UNION ALL SELECT event_id, 2, start_addr FROM rv JOIN vma v ON rv.pid = v.pid AND syscall = 'mmap' AND address > 0 AND address >= start_addr AND address < end_addr
         UNION ALL SELECT event_id, 3, start_addr FROM rv JOIN vma v ON rv.pid = v.pid AND path <> '' AND split_part(path, '/', -1) = pathname
         UNION ALL SELECT event_id, 4, start_addr FROM rv JOIN vma v ON rv.pid = v.pid AND filename <> '' AND contains(pathname, filename)),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY priority, start_addr) r FROM hits)
"""


def _path_events(t: Tables) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    return t.events.select(
        "event_id",
        (F.col("user_id") % 20).alias("pid"),
        F.when(kind == "view", "mmap").when(kind == "signup", "openat").otherwise("pread64").alias("syscall"),
        F.when(kind == "view", k * 104729 % 2097152000).otherwise(0).alias("return_value"),
        F.when(kind == "view", k * 7919 % 2097152000).otherwise(0).alias("address"),
        F.when(kind == "click", F.concat(F.lit("/data/Brand#"), k % 40)).otherwise("").alias("path"),
        F.when(kind == "signup", F.concat(F.lit("and#"), k % 30)).otherwise("").alias("filename"),
    )


@query(
    "mapping_references",
    "J15 M18",
    REF_SQL + "SELECT event_id, priority, start_addr FROM best WHERE r = 1",
    "vma",
)
def mapping_references(t: Tables) -> DataFrame:
    return Y.mapping_references(_path_events(t), t.vma)


@query(
    "matched_regions",
    "A38 J23",
    REF_SQL
    + """, c AS (SELECT rv.pid, start_addr, syscall, count(*) n FROM best JOIN rv USING (event_id) WHERE r = 1 GROUP BY ALL)
      SELECT pid, start_addr, CAST(sum(n) AS BIGINT) n, string_agg(syscall || '=' || n, ',' ORDER BY syscall) calls FROM c GROUP BY ALL""",
    "vma",
)
def matched_regions(t: Tables) -> DataFrame:
    events = _path_events(t)
    hits = Y.mapping_references(events, t.vma).join(events, "event_id")
    counts = hits.groupBy("pid", "start_addr", "syscall").agg(F.count(F.lit(1)).alias("n"))
    # One map entry per system call and region.
    entry = F.sort_array(F.collect_list(F.concat_ws("=", "syscall", "n")))
    return counts.groupBy("pid", "start_addr").agg(
        F.sum("n").alias("n"), F.array_join(entry, ",").alias("calls")
    )


@query(
    "target_file_mappings",
    "J16 F10",
    """SELECT pid, start_addr, pathname FROM vma WHERE pathname IN (SELECT 'Brand#' || user_id FROM events WHERE event_type = 'signup')
       AND NOT regexp_matches(pathname, '^(/usr/lib|/lib|/usr/share|\\[)')""",
    "vma",
)
def target_file_mappings(t: Tables) -> DataFrame:
    """Mappings of the files that were opened, by base name."""
    opened = t.events.filter("event_type = 'signup'").select(F.concat(F.lit("/data/Brand#"), "user_id").alias("p"))
    names = opened.select(Y.basename(F.col("p")).alias("_base")).distinct()
    own = ~F.col("pathname").rlike(r"^(/usr/lib|/lib|/usr/share|\[)")
    maps = t.vma.filter(own).withColumn("_base", Y.basename(F.col("pathname")))
    return maps.join(names, "_base", "left_semi").select("pid", "start_addr", "pathname")


@query(
    "best_shared_mapping",
    "F12 T10",
    """s AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'rw-s' ELSE 'rw-p' END perms,
              CASE WHEN p_partkey % 7 = 0 THEN '[heap]' WHEN p_partkey % 5 = 0 THEN '/dev/shm' ELSE p_brand END AS path, p_partkey % 20 pid, p_size * 16384 size,
              p_partkey * 1048576 start_addr FROM part),
      r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY CASE WHEN path LIKE '%/dev/%' THEN 1 ELSE 0 END, size DESC, start_addr) r
            FROM s WHERE perms LIKE '%s%' AND path NOT LIKE '[%')
      SELECT pid, start_addr, start_addr + size end_addr, path pathname FROM r WHERE r = 1""",
)
def best_shared_mapping(t: Tables) -> DataFrame:
    k = S.int_div(F.col("start_addr"), 1048576)
    path = F.when(k % 7 == 0, "[heap]").when(k % 5 == 0, "/dev/shm").otherwise(F.col("pathname"))
    perms = F.when(k % 3 == 0, "rw-s").otherwise("rw-p")
    return Y.best_shared_mapping(t.vma.withColumns({"perms": perms, "pathname": path}))


@query(
    "process_mapping_inventory",
    "A78",
    """f AS (SELECT pid, count(DISTINCT fd) fds FROM sysev GROUP BY pid)
      SELECT v.pid, count(*) mappings, count(*) FILTER (pathname <> 'Brand#3') file_backed, count(*) FILTER (pathname = 'Brand#3') anonymous,
             CAST(sum(end_addr - start_addr) AS BIGINT) mapped_bytes, coalesce(any_value(fds), 0) open_fds
      FROM vma v LEFT JOIN f USING (pid) GROUP BY v.pid""",
    "vma sysev",
)
def process_mapping_inventory(t: Tables) -> DataFrame:
    """Counts per process; one brand stands for anonymous memory."""
    named = F.col("pathname") != "Brand#3"
    maps = t.vma.groupBy("pid").agg(
        F.count(F.lit(1)).alias("mappings"),
        count_if(named).alias("file_backed"),
        count_if(~named).alias("anonymous"),
        F.sum(F.col("end_addr") - F.col("start_addr")).alias("mapped_bytes"),
    )
    fds = t.sysev.groupBy("pid").agg(F.count_distinct("fd").alias("open_fds"))
    return maps.join(fds, "pid", "left").fillna(0, ["open_fds"])


@query(
    "open_flag_sets",
    "P29 P6",
    """f AS (SELECT o_orderkey, o_orderkey % 4096 + CASE WHEN o_orderkey % 2 = 0 THEN 16384 ELSE 0 END fl FROM orders)
      SELECT o_orderkey, array_to_string(list_filter(
        [CASE fl & 3 WHEN 0 THEN 'O_RDONLY' WHEN 1 THEN 'O_WRONLY' WHEN 2 THEN 'O_RDWR' ELSE 'O_ACCMODE' END,
         CASE WHEN fl & 64 > 0 THEN 'O_CREAT' END, CASE WHEN fl & 128 > 0 THEN 'O_EXCL' END, CASE WHEN fl & 256 > 0 THEN 'O_NOCTTY' END,
         CASE WHEN fl & 512 > 0 THEN 'O_TRUNC' END, CASE WHEN fl & 1024 > 0 THEN 'O_APPEND' END, CASE WHEN fl & 2048 > 0 THEN 'O_NONBLOCK' END,
         CASE WHEN fl & 16384 > 0 THEN 'O_DIRECT' END], lambda x: x IS NOT NULL), '|') flags FROM f""",
)
def open_flag_sets(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    flags = k % 4096 + F.when(k % 2 == 0, 16384).otherwise(0)
    return t.orders.select("o_orderkey", F.array_join(S.open_flags(flags), "|").alias("flags"))


@query(
    "operation_names",
    "P6 P30 P31",
    """n AS (SELECT o_orderkey % 26 code FROM orders)
      SELECT code, CASE code WHEN 0 THEN 'flush' WHEN 1 THEN 'write' WHEN 2 THEN 'read' ELSE 'other' END nvm,
             CASE code WHEN 1 THEN 'store' WHEN 2 THEN 'retrieve' WHEN 6 THEN 'list' WHEN 16 THEN 'delete' WHEN 20 THEN 'exist' ELSE 'other' END kv,
             CASE code WHEN 1 THEN 'READV' WHEN 2 THEN 'WRITEV' WHEN 4 THEN 'READ_FIXED' WHEN 5 THEN 'WRITE_FIXED' WHEN 22 THEN 'READ' WHEN 23 THEN 'WRITE' ELSE 'OTHER' END ring,
             CASE WHEN code IN (0, 17) THEN 'READ' WHEN code IN (1, 18) THEN 'WRITE' WHEN code = 19 THEN 'VREAD' WHEN code = 20 THEN 'VWRITE' ELSE 'NONE' END direction,
             CASE code WHEN 8 THEN 'position' WHEN 9 THEN 'length' WHEN 19 THEN 'vectors' WHEN 20 THEN 'vectors' ELSE 'bytes' END size_meaning, count(*) n
      FROM n GROUP BY code""",
)
def operation_names(t: Tables) -> DataFrame:
    code = F.col("code")
    # Calls whose size column does not hold a transfer size.
    meaning = {8: "position", 9: "length", 19: "vectors", 20: "vectors"}
    counts = t.orders.groupBy((F.col("o_orderkey") % 26).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "code",
        S.named(code, S.NVM_OPCODES).alias("nvm"),
        S.named(code, S.KV_OPCODES).alias("kv"),
        S.named(code, S.RING_OPCODES, "OTHER").alias("ring"),
        S.named(code, S.IO_DIRECTION, "NONE").alias("direction"),
        S.named(code, meaning, "bytes").alias("size_meaning"),
        "n",
    )


@query(
    "vectored_request_bytes",
    "P32",
    """v AS (SELECT o_orderkey, [o_orderkey % 7 * 512 + x * 100 for x in range(o_orderkey % 11 + 1)] iov FROM orders)
      SELECT o_orderkey, CASE WHEN len(iov) <= 8 THEN CAST(list_sum(iov) AS BIGINT) END requested_bytes,
             CAST(list_sum(iov[1:8]) AS BIGINT) requested_bytes_lower, len(iov) <= 8 requested_bytes_valid FROM v""",
)
def vectored_request_bytes(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    sizes = F.transform(F.sequence(F.lit(0).cast("long"), k % 11), lambda x: k % 7 * 512 + x * 100)
    columns = S.vector_bytes(F.col("iov"), 8)
    rows = t.orders.select("o_orderkey", sizes.alias("iov"))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in columns.items()])


@query(
    "command_key_hex",
    "P7",
    """w AS (SELECT o_orderkey, o_orderkey % 17 kl, md5(CAST(o_orderkey AS VARCHAR)) h FROM orders)
      SELECT o_orderkey, left(h, kl * 2) key_hex FROM w""",
)
def command_key_hex(t: Tables) -> DataFrame:
    """Keys packed into four little-endian words and unpacked again."""
    k = F.col("o_orderkey")
    digest = F.md5(k.cast("string").cast("binary"))
    words = []
    for i in range(4):
        hex4 = F.substring(digest, 8 * i + 1, 8)
        swapped = F.concat(*[F.substring(hex4, 7 - 2 * j, 2) for j in range(4)])
        words.append(F.conv(swapped, 16, 10).cast("long"))
    return t.orders.select("o_orderkey", S.key_hex(words, k % 17).alias("key_hex"))



