"""Source queries: the views are written out as text or JSON and parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail import schemas
from iotrail.functions import scalar as S
from iotrail.operators import counters as C
from iotrail.operators.blocks import count_if
from iotrail.operators.pairing import consuming_pairs
from iotrail.operators.scan import dealt
from iotrail.plans.blocks import r6, rounded
from iotrail.plans.registry import Tables, query
from iotrail.session import pin
from iotrail.sources import records, text


def seconds(ns: Column) -> Column:
    """Nanoseconds as decimal seconds with nine places."""
    return F.concat(
        S.int_div(ns, 1_000_000_000).cast("string"),
        F.lit("."),
        F.lpad((ns % 1_000_000_000).cast("string"), 9, "0"),
    )


def block_lines(t: Tables) -> DataFrame:
    """Event lines with headers, blank lines and broken lines in between."""
    k = F.col("seq")
    line = F.concat(
        F.lit("259,0 "), F.col("cpu"), F.lit(" "), k, F.lit(" "), seconds(F.col("ts_ns")), F.lit(" "), F.col("pid"),
        F.lit(" "), F.col("action"), F.lit(" "), F.col("rwbs"), F.lit(" "), F.col("sector"), F.lit(" + "), F.col("nblocks"),
        F.lit(" [fio]"),
    )
    noisy = (
        F.when(k % 101 == 0, "CPU0 (trace):")
        .when(k % 101 == 1, "Total (trace):")
        .when(k % 101 == 2, "  ")
        .when(k % 101 == 3, "259,0 broken line")
        .otherwise(line)
    )
    return t.blk.select(noisy.alias("value"))


@query(
    "block_text_scan",
    "S1 S2 X17",
    """SELECT seq, cpu, ts_ns, pid, action, rwbs, sector, nblocks, 'fio' process, rwbs LIKE '%R%' is_read, rwbs LIKE '%W%' is_write
       FROM blk WHERE seq % 101 > 3""",
    "blk",
)
def block_text_scan(t: Tables) -> DataFrame:
    rows = text.block_trace(block_lines(t)).filter("parsed")
    names = "seq cpu ts_ns pid action rwbs sector nblocks process is_read is_write"
    return rows.select(*names.split())


@query(
    "block_text_scan_errors",
    "S1 S2",
    "SELECT count(*) FILTER (seq % 101 > 2) lines, count(*) FILTER (seq % 101 = 3) unparsed, count(*) FILTER (seq % 101 = 3) unparsed_tolerant FROM blk",
    "blk",
)
def block_text_scan_errors(t: Tables) -> DataFrame:
    lines = block_lines(t)
    n, bad = F.count(F.lit(1)).alias("lines"), count_if(~F.col("parsed"))
    strict = text.block_trace(lines).agg(n, bad.alias("unparsed"))
    loose = text.block_trace(lines, tolerant=True).agg(bad.alias("unparsed_tolerant"))
    both = strict.unionByName(loose, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query(
    "ftrace_block_scan",
    "S3 A62 F6",
    """SELECT CASE action WHEN 'D' THEN 'issue' ELSE 'complete' END action, seq * 1000 ts_ns, rwbs, nblocks * 512 bytes, sector, nblocks sectors
       FROM blk WHERE action IN ('D', 'C')""",
    "blk",
)
def ftrace_block_scan(t: Tables) -> DataFrame:
    k = F.col("seq")
    head = F.concat(F.lit("  fio-1 [003] d..2 "), seconds(k * 1000), F.lit(": block_rq_"))
    size = F.when(k % 2 == 0, F.col("nblocks") * 512).otherwise(0)
    tail = F.concat(F.lit(" () "), F.col("sector"), F.lit(" + "), F.col("nblocks"), F.lit(" [fio]"))
    issue = F.concat(head, F.lit("issue: 259,5 "), F.col("rwbs"), F.lit(" "), size, tail)
    done = F.concat(head, F.lit("complete: 259,5 "), F.col("rwbs"), tail)
    line = F.when(F.col("action") == "D", issue).when(F.col("action") == "C", done).otherwise("# tracer: nop")
    rows = text.ftrace_block(t.blk.select(line.alias("value")))
    device = rows.filter("major = 259 AND minor = 5")
    return device.select("action", "ts_ns", "rwbs", "bytes", "sector", "sectors")


@query(
    "other_block_operations",
    "A62",
    """SELECT rwbs, CASE left(rwbs, 1) WHEN 'R' THEN 'read' WHEN 'W' THEN 'write' ELSE 'other' END op_class, count(*) n FROM blk WHERE action = 'C' GROUP BY ALL""",
    "blk",
)
def other_block_operations(t: Tables) -> DataFrame:
    done = t.blk.filter("action = 'C'")
    return done.groupBy("rwbs", S.op_class(F.col("rwbs")).alias("op_class")).agg(F.count(F.lit(1)).alias("n"))


def nvme_lines(t: Tables) -> DataFrame:
    """Set-up and completion lines; queue and command ids repeat."""
    k = F.col("event_id")
    op = F.when(k % 5 == 0, "Flush").when(k % 3 == 0, "nvme_cmd_read").otherwise("nvme_cmd_write")
    args = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" slba="), k * 3, F.lit(", len="), k % 8))
    head = F.concat(F.lit("  fio-1 [003] d..2 "), seconds(F.col("ts_ns")), F.lit(": "))
    ids = F.concat(F.lit(" qid="), k % 4, F.lit(", cmdid="), F.col("tid") % 16)
    disk = F.when(k % 7 == 0, "").otherwise(" nvme0n1")
    setup = F.concat(head, F.lit("nvme_setup_cmd: nvme0:"), disk, ids, F.lit(", nsid=1, flags=0x0, cmd=("), op, args, F.lit(")"))
    status = F.when(k % 50 == 1, "0x281").otherwise("0x0")
    done = F.concat(head, F.lit("nvme_complete_rq: nvme0:"), disk, ids, F.lit(", res=0, status="), status)
    # Cutting lines is what takes time, and a table may be few files.
    events = dealt(t.sysev, ["event_id", "ts_ns"])
    return events.select(F.when(S.int_div(k, 4) % 2 == 0, setup).otherwise(done).alias("value"), "event_id")


NVME_SQL = """
nv AS (SELECT event_id, ts_ns, event_id % 4 qid, tid % 16 cmdid, event_id // 4 % 2 = 0 su,
              CASE WHEN event_id % 5 = 0 THEN 'flush' WHEN event_id % 3 = 0 THEN 'read' ELSE 'write' END op,
              CASE WHEN event_id % 5 <> 0 THEN event_id * 3 END slba, CASE WHEN event_id % 5 <> 0 THEN event_id % 8 + 1 END nlb,
              CASE WHEN event_id % 50 = 1 THEN '0x281' ELSE '0x0' END status FROM sysev),
np AS (SELECT *, lag(su) OVER w psu, lag(ts_ns) OVER w pts, lag(op) OVER w pop, lag(slba) OVER w pslba, lag(nlb) OVER w pnlb FROM nv
       WINDOW w AS (PARTITION BY qid, cmdid ORDER BY ts_ns, event_id)),
pr AS (SELECT event_id, pop op, status, pslba slba, pnlb * 4096 bytes, pslba * 8 sector512, ts_ns - pts lat_ns FROM np WHERE NOT su AND psu AND ts_ns > pts)
"""


def nvme_pairs(t: Tables) -> DataFrame:
    """Lines are cut once: the pairs are looked for in what is written."""
    events = text.ftrace_nvme(nvme_lines(t))
    extent = S.nvme_extent(F.col("cmd"), 4096)
    events = pin(events.withColumns({"op": S.nvme_class(F.col("cmd")), **extent}).drop("cmd", "disk", "nsid"))
    starts = F.col("action") == "setup"
    carry = ["ts_ns", "op", "slba", "bytes", "sector512"]
    pairs = consuming_pairs(events, ["ctrl", "qid", "cmdid"], ["ts_ns", "event_id"], starts, carry)
    lat = F.col("ts_ns") - F.col("start_ts_ns")
    return pairs.withColumn("lat_ns", lat).filter("lat_ns > 0")


@query("nvme_command_pairs", "J4 S4 P4 P5 M8", NVME_SQL + "SELECT * FROM pr", "sysev")
def nvme_command_pairs(t: Tables) -> DataFrame:
    rows = nvme_pairs(t)
    names = ("op", "slba", "bytes", "sector512")
    return rows.select("event_id", "status", "lat_ns", *[F.col(f"start_{c}").alias(c) for c in names])


@query(
    "nvme_command_pairs_expired",
    "J4 R6",
    NVME_SQL
    + "SELECT count(*) FILTER (lat_ns <= 30000000000000) in_time, count(*) FILTER (lat_ns > 30000000000000) expired FROM pr",
    "sysev",
)
def nvme_command_pairs_expired(t: Tables) -> DataFrame:
    """The pending limit is 30,000 s here, as these events are minutes apart."""
    limit = 30_000 * 1_000_000_000
    late = F.col("lat_ns") > limit
    return nvme_pairs(t).agg(count_if(~late).alias("in_time"), count_if(late).alias("expired"))


@query(
    "nvme_command_mix",
    "A61",
    NVME_SQL + "SELECT op, status, count(*) n FROM pr GROUP BY ALL",
    "sysev",
)
def nvme_command_mix(t: Tables) -> DataFrame:
    return C.command_mix(nvme_pairs(t).withColumn("op", F.col("start_op")))


def capture_lines(t: Tables) -> DataFrame:
    """Commands, object records and sentinels as JSON lines; every 50th is cut off."""
    k = F.col("l_orderkey")
    fields = {
        "event_type": F.when(k % 10 == 9, "clock_anchor").when(k % 10 == 8, "drops").when(k % 10 < 7, "nvme_cmd"),
        "trace_id": F.when(k % 10 == 7, k),
        "op": F.when(k % 10 == 7, "store"),
        "dropped": F.when(k % 10 == 8, F.col("l_linenumber").cast("long")),
        "slba": F.when(k % 10 < 7, k * 8),
    }
    doc = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    cut = F.when(F.col("l_partkey") % 50 == 0, F.substring(doc, F.lit(1), F.length(doc) - 3)).otherwise(doc)
    return t.lineitem.select(cut.alias("value"))


@query(
    "capture_scan_families",
    "S5 S7 R11 M12",
    """f AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN 'corrupt' WHEN l_orderkey % 10 = 9 THEN 'clock_anchor' WHEN l_orderkey % 10 = 8 THEN 'drops'
              WHEN l_orderkey % 10 = 7 THEN 'semantic' ELSE 'nvme_cmd' END family, l_orderkey, l_linenumber FROM lineitem)
      SELECT family, count(*) "rows", CAST(coalesce(sum(l_linenumber) FILTER (family = 'drops'), 0) AS BIGINT) dropped FROM f GROUP BY family""",
)
def capture_scan_families(t: Tables) -> DataFrame:
    parsed = records.parse_lines(capture_lines(t), schemas.DEVICE)
    whole = F.col(records.CORRUPT).isNull()
    # A cut line may have had its count read before the cut.
    parsed = parsed.withColumn("dropped", F.when(whole, F.col("dropped")))
    return records.lost_events(parsed)


@query(
    "syscall_document_scan",
    "S8 M15",
    """SELECT event_id // 100 document, pid, syscall_name, count(*) n, CAST(sum(size) AS BIGINT) bytes FROM sysev GROUP BY ALL""",
    "sysev",
)
def syscall_document_scan(t: Tables) -> DataFrame:
    """Documents of a hundred events each."""
    event = F.struct(
        F.col("ts_ns").alias("timestamp_ns"), "pid", "syscall_name", "fd", "size", F.col("file_offset").alias("offset")
    )
    docs = t.sysev.groupBy(S.int_div(F.col("event_id"), 100).alias("document")).agg(
        F.to_json(F.struct(F.collect_list(event).alias("raw_events"))).alias("value")
    )
    events = records.syscall_events(docs)
    return events.groupBy("document", "pid", "syscall_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    )


@query(
    "strace_scan",
    "S9 M17",
    """SELECT pid, ts_ns // 1000 * 1000 ts_ns, CASE syscall_name WHEN 'lseek' THEN 'clone' WHEN 'openat' THEN 'mmap' ELSE syscall_name END syscall,
       CASE syscall_name WHEN 'lseek' THEN event_id + 5000 WHEN 'openat' THEN event_id * 4096 ELSE size END return_value,
       CASE WHEN syscall_name <> 'lseek' THEN fd END fd, CASE WHEN syscall_name <> 'lseek' THEN size END "length",
       CASE WHEN syscall_name IN ('pread64', 'pwrite64', 'openat') THEN file_offset END "offset",
       CASE WHEN syscall_name = 'openat' THEN CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END END address,
       CASE WHEN syscall_name = 'lseek' THEN event_id + 5000 END child_pid FROM sysev""",
    "sysev",
)
def strace_scan(t: Tables) -> DataFrame:
    name, k = F.col("syscall_name"), F.col("event_id")
    micro = F.concat(
        S.int_div(F.col("ts_ns"), 1_000_000_000).cast("string"),
        F.lit("."),
        F.lpad((S.int_div(F.col("ts_ns"), 1000) % 1_000_000).cast("string"), 6, "0"),
    )
    head = F.concat(F.lit("[pid "), F.col("pid"), F.lit("] "), micro, F.lit(" "))
    hint = F.when(k % 2 == 0, "NULL").otherwise(F.concat(F.lit("0x"), F.lower(F.hex(k))))
    place = F.concat(F.lit(", "), F.col("file_offset"))
    rw = F.concat(name, F.lit("("), F.col("fd"), F.lit(', "", '), F.col("size"), F.when(name == "read", "").otherwise(place), F.lit(") = "), F.col("size"))
    mmap = F.concat(
        F.lit("mmap("), hint, F.lit(", "), F.col("size"), F.lit(", PROT_READ, MAP_SHARED, "), F.col("fd"), place,
        F.lit(") = 0x"), F.lower(F.hex(k * 4096)),
    )
    clone = F.concat(F.lit("clone(child_stack=NULL) = "), k + 5000)
    body = F.when(name == "lseek", clone).when(name == "openat", mmap).otherwise(rw)
    rows = text.strace(t.sysev.select(F.concat(head, body).alias("value")))
    return rows.drop("filename")


@query(
    "maps_scan",
    "S10",
    """SELECT pid, start_addr, end_addr, 'rw-s' perms, file_offset, '00:27' device, pid + 7 inode, '/data/' || pathname pathname FROM vma""",
    "vma",
)
def maps_scan(t: Tables) -> DataFrame:
    def hexed(name: str) -> Column:
        return F.lower(F.hex(name))

    line = F.concat(
        hexed("start_addr"), F.lit("-"), hexed("end_addr"), F.lit(" rw-s "), F.lpad(hexed("file_offset"), 8, "0"),
        F.lit(" 00:27 "), F.col("pid") + 7, F.lit("    /data/"), F.col("pathname"),
    )
    return text.proc_maps(t.vma.select("pid", line.alias("value")))


def benchmark_documents(t: Tables) -> DataFrame:
    """One benchmark document per supplier; every third one has no writes."""
    k = F.col("s_suppkey")

    def side(scale: int, quiet: Column) -> Column:
        points = F.create_map(
            *[x for p, f in (("50.000000", 1), ("90.000000", 2), ("99.000000", 5), ("99.900000", 9)) for x in (F.lit(p), (k * 1000 * f * scale).cast("double"))]
        )
        lat = F.struct(
            (k * 1100.0 * scale).alias("mean"), (k * 10.0).alias("min"), (k * 9999.0).alias("max"), points.alias("percentile")
        )
        return F.struct(
            (k * 3.0 * scale).alias("iops"),
            (k * 1024.0 * scale).alias("bw"),
            F.when(quiet, 0).otherwise(k * 1048576 * scale + 1).alias("io_bytes"),
            lat.alias("lat_ns"),
        )

    job = F.struct(
        F.concat(F.lit("job"), k).alias("jobname"),
        (k % 32 + 1).cast("int").alias("iodepth"),
        F.struct(F.lit("4k").alias("bs")).alias("job options"),
        side(1, F.lit(False)).alias("read"),
        side(2, k % 3 == 0).alias("write"),
    )
    return t.supplier.select(F.to_json(F.struct(F.array(job).alias("jobs"))).alias("value"))


JOB_SQL = """
jb AS (SELECT s_suppkey k, unnest([1, 2]) s FROM supplier)
"""


@query(
    "benchmark_job_summary",
    "S13 A58 M26",
    JOB_SQL
    + """SELECT 'job' || k job, CASE s WHEN 1 THEN 'read' ELSE 'write' END rw, '4k' bs, CAST(k % 32 + 1 AS INTEGER) qd, CAST(k * 3 * s AS DOUBLE) iops, CAST(k * s AS DOUBLE) bw_mbs,
         round(k * 1100 * s * 1e-6, 6) lat_mean_ms, round(k * 1000 * s * 1e-6, 6) lat_p50_ms, round(k * 2000 * s * 1e-6, 6) lat_p90_ms, round(k * 5000 * s * 1e-6, 6) lat_p99_ms,
         round(k * 9000 * s * 1e-6, 6) lat_p999_ms, round(k * 10 * 1e-6, 6) lat_min_ms, round(k * 9999 * 1e-6, 6) lat_max_ms, round((k * 1048576 * s + 1) / 1073741824, 6) io_gib
         FROM jb WHERE NOT (s = 2 AND k % 3 = 0)""",
)
def benchmark_job_summary(t: Tables) -> DataFrame:
    return rounded(C.job_summary(records.benchmark_jobs(benchmark_documents(t))))


@query(
    "benchmark_percentiles",
    "S14",
    JOB_SQL
    + """SELECT 'job' || k job, CASE s WHEN 1 THEN 'read' ELSE 'write' END rw, CAST(unnest([50, 90, 99, 99.9]) AS DOUBLE) point,
         round(unnest([k * 1000 * s * 1e-6, k * 2000 * s * 1e-6, k * 5000 * s * 1e-6, k * 9000 * s * 1e-6]), 6) ms FROM jb""",
)
def benchmark_percentiles(t: Tables) -> DataFrame:
    return rounded(C.job_percentiles(records.benchmark_jobs(benchmark_documents(t))))


def health_texts(t: Tables) -> DataFrame:
    """Logs per customer, as text in two layouts or as JSON behind a preamble."""
    k = F.col("c_custkey")
    values = {
        "spare_thresh": F.lit(10), "percent_used": F.lit(3), "data_units_read": k * 12345, "data_units_written": k * 54321, "host_reads": k * 7, "host_writes": k * 11,
        "power_cycles": k % 50, "power_on_hours": k % 9000, "unsafe_shutdowns": k % 5, "media_errors": k % 3, "num_err_log_entries": k % 7,
    }

    def layout(form: int) -> Column:
        lines = [F.lit("\ncritical_warning : 0x"), F.lower(F.hex(k % 16)), F.lit("\ntemperature : "), k % 30 + 290, F.lit(" K")]
        names = text.HEALTH_FIELDS
        lines += [F.lit(f"\n{names['avail_spare'][-form]} : "), k % 101, F.lit("%")]
        for name, value in values.items():
            lines += [F.lit(f"\n{names[name][-form]} : "), F.format_number(value, 0)]
        return F.concat(*lines)

    machine, readable = layout(0), layout(1)
    doc = [F.lit('Smart log for device\n{"critical_warning": '), k % 16, F.lit(', "temperature": '), k % 30 + 290, F.lit(', "avail_spare": '), k % 101]
    for name, value in values.items():
        doc += [F.lit(f', "{text.HEALTH_FIELDS[name][0]}": '), value]
    doc = F.concat(*doc, F.lit("}"))
    form = F.when(k % 3 == 0, machine).when(k % 3 == 1, readable).otherwise(doc)
    return t.customer.select(k.alias("ts_ns"), (k % 97).alias("device"), form.alias("value"))


@query(
    "health_log_scan",
    "S15 P38 M27",
    """SELECT c_custkey ts_ns, c_custkey % 16 critical_warning, CAST(c_custkey % 30 + 290 - 273 AS DOUBLE) celsius, CAST(c_custkey % 101 AS DOUBLE) avail_spare,
       CAST(3 AS DOUBLE) percent_used, CAST(c_custkey * 12345 AS DOUBLE) data_units_read, round(c_custkey * 12345 * 512000 / 1073741824, 6) read_gib,
       CAST(10 AS DOUBLE) spare_thresh, CAST(c_custkey * 54321 AS DOUBLE) data_units_written, CAST(c_custkey * 7 AS DOUBLE) host_reads, CAST(c_custkey * 11 AS DOUBLE) host_writes,
       CAST(c_custkey % 50 AS DOUBLE) power_cycles, CAST(c_custkey % 9000 AS DOUBLE) power_on_hours, CAST(c_custkey % 5 AS DOUBLE) unsafe_shutdowns,
       CAST(c_custkey % 3 AS DOUBLE) media_errors, CAST(c_custkey % 7 AS DOUBLE) num_err_log_entries FROM customer""",
)
def health_log_scan(t: Tables) -> DataFrame:
    rows = text.health_logs(health_texts(t))
    return rows.select(
        "ts_ns",
        "critical_warning",
        S.celsius(F.col("temperature")).alias("celsius"),
        "avail_spare",
        "percent_used",
        "data_units_read",
        r6(S.units_gib(F.col("data_units_read"))).alias("read_gib"),
        "spare_thresh",
        "data_units_written",
        "host_reads",
        "host_writes",
        "power_cycles",
        "power_on_hours",
        "unsafe_shutdowns",
        "media_errors",
        "num_err_log_entries",
    )


@query(
    "device_health_summary",
    "A75 X14",
    """l AS (SELECT c_custkey % 97 device, max(c_custkey) k FROM customer GROUP BY ALL)
      SELECT device, k ts_ns, CAST(k % 101 AS DOUBLE) avail_spare, CAST(k % 30 + 17 AS DOUBLE) celsius, round(k * 12345 * 512000 / 1073741824, 6) read_gib FROM l""",
)
def device_health_summary(t: Tables) -> DataFrame:
    rows = C.health_summary(text.health_logs(health_texts(t)))
    return rounded(rows.select("device", "ts_ns", "avail_spare", "celsius", "read_gib"))


@query(
    "phase_marker_scan",
    "S17 M24",
    """SELECT CASE o_orderkey % 10 WHEN 0 THEN 'PHASE_START' WHEN 9 THEN 'PHASE_END' ELSE 'PROGRESS' END kind, o_orderkey * 1000 mono_ns,
       CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey * 7 END signal_bytes, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey * 11 END store_bytes,
       CASE WHEN o_orderkey % 10 = 9 THEN round(o_orderkey % 100 / 8, 3) END ra_signal FROM orders WHERE o_orderkey % 10 <> 5""",
)
def phase_marker_scan(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    start = F.concat(F.lit("PHASE_START access=seq mono_ns="), k * 1000)
    mark = F.concat(F.lit(" mono_ns="), k * 1000, F.lit(" signal_bytes="), k * 7, F.lit(" store_bytes="), k * 11)
    ratio = F.format_string("%.3f", (k % 100) / 8)
    end = F.concat(F.lit("PHASE_END"), mark, F.lit(" ra_signal="), ratio)
    line = F.when(k % 10 == 0, start).when(k % 10 == 9, end).when(k % 10 == 5, "loading").otherwise(F.concat(F.lit("PROGRESS"), mark))
    rows = text.phase_markers(t.orders.select(line.alias("value")))
    return rows.select("kind", "mono_ns", "signal_bytes", "store_bytes", "ra_signal")


@query(
    "geometry_scan",
    "S18 P27",
    """SELECT p_partkey, 512 lbs, p_size * 512 iu_size, (p_partkey % 8 + 1) * 512 npwg_bytes, CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 0 END awun FROM part""",
)
def geometry_scan(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    doc = F.to_json(
        F.struct(
            F.lit(512).alias("lbs"),
            (F.col("p_size") * 512).alias("iu_size"),
            (k % 8).alias("npwg"),
            F.when(k % 2 == 0, 8).alias("awun"),
            F.lit("x").alias("unknown_key"),
        )
    )
    rows = records.geometries(t.part.select("p_partkey", doc.alias("value")))
    raw = S.zero_based_bytes(F.col("npwg"), 512).alias("npwg_bytes")
    return rows.select("p_partkey", "lbs", "iu_size", raw, "awun")


@query(
    "manifest_scan",
    "S20 M28",
    """SELECT o_orderkey "index", CAST(floor(o_totalprice) AS BIGINT) payload_bytes, CASE WHEN o_orderkey % 2 = 0 THEN 65536 ELSE 131072 END mdts_bytes, 4096 header_bytes FROM orders""",
)
def manifest_scan(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    entry = F.struct(k.alias("index"), F.lit("kv").alias("part"), F.floor("o_totalprice").alias("payload_bytes"))
    shape = F.struct(F.when(k % 2 == 0, 65536).alias("mdts_bytes"), F.lit("posix").alias("engine"))
    doc = F.to_json(F.struct(shape.alias("device_geometry"), F.array(entry).alias("objects")))
    rows = records.manifest_objects(t.orders.select(doc.alias("value")))
    return rows.select("index", "payload_bytes", "mdts_bytes", "header_bytes")


@query(
    "page_monitor_scan",
    "S22",
    """s AS (SELECT pid, start_addr, unnest([0, 1]) iter, end_addr FROM vma), b AS (SELECT *, unnest(range(0, 8)) block FROM s)
      SELECT pid, '0x' || lower(to_hex(start_addr)) AS start, iter, CAST(block AS INTEGER) block, CAST((start_addr // 1048576 + block * 3 + iter) % 101 AS INTEGER) dirty_pct FROM b""",
    "vma",
)
def page_monitor_scan(t: Tables) -> DataFrame:
    base = S.int_div(F.col("start_addr"), 1048576)

    def shot(i: int) -> Column:
        blocks = F.array(*[((base + b * 3 + i) % 101).cast("int") for b in range(8)])
        return F.struct(F.lit(i).alias("iter"), F.lit(0).alias("ts_ms"), F.lit(1).alias("total_dirty"), blocks.alias("blocks"))

    start = F.concat(F.lit("0x"), F.lower(F.hex("start_addr")))
    doc = F.struct(F.lit("heatmap").alias("mode"), "pid", start.alias("start"), F.array(shot(0), shot(1)).alias("snapshots"))
    rows = records.page_monitor_blocks(t.vma.select(F.to_json(doc).alias("value")))
    return rows.select("pid", "start", "iter", "block", "dirty_pct")


@query(
    "device_names",
    "P39",
    """n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ng' || c_custkey || 'n1' WHEN 1 THEN 'nvme' || c_custkey || 'n1p2' ELSE 'sda' END d FROM customer)
      SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'nvme' || c_custkey || 'n1' WHEN 1 THEN d ELSE 'sda' END AS device,
             CASE c_custkey % 3 WHEN 0 THEN 'nvme' || c_custkey || 'n1,nvme' || c_custkey WHEN 1 THEN d || ',nvme' || c_custkey || 'n1,nvme' || c_custkey ELSE 'sda' END candidates FROM n""",
)
def device_names(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    raw = (
        F.when(k % 3 == 0, F.concat(F.lit("ng"), k, F.lit("n1")))
        .when(k % 3 == 1, F.concat(F.lit("nvme"), k, F.lit("n1p2")))
        .otherwise("sda")
    )
    rows = t.customer.select("c_custkey", S.namespace_name(raw).alias("device"))
    return rows.withColumn("candidates", F.array_join(S.device_candidates(F.col("device")), ","))
