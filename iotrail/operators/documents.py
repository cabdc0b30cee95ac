"""Analyses whose result is one JSON document: plain fields, and lists of any length (see ``sinks.json_document``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions import scalar as S
from iotrail.operators.asof import asof_join
from iotrail.operators.syscalls import IO_CALLS, fork_tree, mapping_references, process_breakdown, ranked_totals
from iotrail.session import pin
from iotrail.sinks import process_documents


def entries(rows: DataFrame, at: Column, tie: Column, entry: Column) -> DataFrame:
    """Rows as entries of a list, in the order of two numbers."""
    return rows.select(at.cast("long").alias("at"), tie.cast("long").alias("tie"), F.to_json(entry, {"ignoreNullFields": "false"}).alias("value"))


def syscall_document(events: DataFrame, label: str | None = None, detailed: bool = True) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Head and lists of the summary of a traced run: metadata, summary, totals per call, calls per process, raw events in order.

    ``events`` has ts_ns, event_id, pid, comm, syscall_nr, syscall_name, fd, size, file_offset, filename, open_flags and ret. Without
    ``detailed`` the list of raw events is empty. Calls come by falling bytes, processes by falling number of events.
    """
    n = F.count(F.lit(1))
    per_pid = events.groupBy("pid").agg(n.alias("n"), F.min("comm").alias("comm"))
    busiest = per_pid.agg(F.max_by(F.struct("pid", "comm"), F.struct("n", -F.col("pid"))).alias("b"), n.alias("processes"))
    whole = events.agg(
        n.alias("total_events"),
        ((F.max("ts_ns") - F.min("ts_ns")) / 1e9).cast("decimal(20,3)").alias("monitoring_duration"),
        F.count_distinct("syscall_name").alias("unique_syscalls"),
        F.coalesce(F.sum(F.when(F.col("syscall_name").isin(*IO_CALLS), F.col("size"))), F.lit(0)).alias("total_io_bytes"),
    )
    metadata = F.struct(
        "total_events", F.coalesce("monitoring_duration", F.lit(0).cast("decimal(20,3)")).alias("monitoring_duration"), "unique_syscalls",
        F.col("processes").alias("unique_processes"), F.lit(label).alias("workload_label"), F.lit(detailed).alias("detailed_logging"),
    )
    summary = F.struct("total_io_bytes", F.coalesce("b.comm", F.lit("N/A")).alias("most_active_process"), F.coalesce("b.pid", F.lit(0)).alias("most_active_process_pid"))
    # Two tables of one row each.
    head = whole.withColumn("_one", F.lit(1)).join(busiest.withColumn("_one", F.lit(1)), "_one").select(metadata.alias("metadata"), summary.alias("summary"))

    numbers = events.groupBy("syscall_name").agg(F.min("syscall_nr").alias("syscall_nr"))
    calls = ranked_totals(events, "syscall_name").join(numbers, "syscall_name")
    call = F.struct("syscall_nr", "syscall_name", F.col("bytes").alias("total_size"), "count", F.col("avg_bytes").cast("decimal(20,2)").alias("avg_size"))

    processes = process_documents(process_breakdown(events), ["pid"]).join(per_pid.select("pid", "comm"), "pid")
    used = F.transform("syscalls", lambda s: F.struct(s["syscall_name"].alias("syscall_name"), s["count"].alias("count"), s["bytes"].alias("total_size")))
    process = F.struct("pid", F.col("comm").alias("process_name"), F.col("events").alias("total_events"), F.col("bytes").alias("total_size"), used.alias("syscalls"))

    flags = F.when(F.col("open_flags").isNull(), "").otherwise(F.array_join(S.open_flags(F.col("open_flags")), "|"))
    event = F.struct(
        F.col("ts_ns").alias("timestamp_ns"), (F.col("ts_ns").cast("decimal(20,0)") / 1_000_000).cast("decimal(20,3)").alias("timestamp_ms"), "pid", F.col("comm").alias("process_name"),
        "syscall_nr", "syscall_name", "fd", "size", F.col("file_offset").alias("offset"), "filename", F.coalesce("open_flags", F.lit(0)).alias("open_flags_hex"),
        flags.alias("open_flags_str"), S.named(F.col("syscall_nr"), S.IO_DIRECTION, "NONE").alias("io_direction"), "ret", F.greatest(-F.col("ret"), F.lit(0)).alias("error_code"),
    )
    raw = events if detailed else events.limit(0)
    return head, {
        "aggregated_stats.all_syscalls": entries(calls, F.col("rank"), F.lit(0), call),
        "process_analysis": entries(processes, -F.col("events"), F.col("pid"), process),
        "raw_events": entries(raw, F.col("ts_ns"), F.col("event_id"), event),
    }


def processes_at(events: DataFrame, processes: DataFrame, take: Sequence[str]) -> DataFrame:
    """``events`` (pid, ts_ns) with columns of the process that had their pid then; pids are used again."""
    return asof_join(events, processes, ["pid"], "ts_ns", "birth_ns", {c: c for c in take})


def io_path_document(events: DataFrame, forks: DataFrame, vma: DataFrame, root: int | None = None, tree: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Head and lists of the I/O path of a process and all that descend from it: pids, forks, children, events with their mapping.

    ``events``: event_id, ts_ns, pid, comm, syscall, fd, length, file_offset, latency_us, filename, path (behind the descriptor),
    return_value, address and page_events. ``forks``: parent_pid, child_pid, ts_ns, parent_comm, child_comm. ``vma``: pid, start_addr,
    end_addr, pathname, perms. ``root`` is a process that ran before the trace, by default the one with most descendants (ties: the
    smallest pid). As pids are used again, an entry of ``children`` names a process by its pid and birth. A call refers to one mapping at
    most (see ``mapping_references``).
    """
    tree = pin(fork_tree(forks) if tree is None else tree)
    if root is None:
        sizes = tree.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        root = sizes.agg(F.max_by("root", F.struct(F.col("n"), -F.col("root")))).first()[0]
    family = tree.filter(F.col("root") == F.lit(root)).select("pid", "birth_ns")
    kept = ["parent_pid", "parent_comm", "child_comm"]
    born = forks.groupBy(F.col("child_pid").alias("pid"), F.col("ts_ns").alias("birth_ns")).agg(F.min(F.struct(*kept)).alias("f")).select("pid", "birth_ns", "f.*")
    born = pin(born.join(family, ["pid", "birth_ns"], "left_semi").withColumn("before_ns", F.col("birth_ns") - 1))
    fork = F.struct(F.col("birth_ns").alias("timestamp_ns"), "parent_pid", F.col("pid").alias("child_pid"), "parent_comm", "child_comm")
    # A parent belongs to the family, and is the latest of its pid that was born before.
    parents = asof_join(born, family.select(F.col("pid").alias("parent_pid"), F.col("birth_ns").alias("up_ns")), ["parent_pid"], "before_ns", "up_ns", {"up_ns": "up_ns"})
    # A process has at most as many living children as there are process ids.
    nodes = parents.groupBy("parent_pid", "up_ns").agg(F.sort_array(F.collect_list(F.struct("birth_ns", "pid"))).alias("c"))
    node = F.struct(F.col("parent_pid").alias("pid"), F.col("up_ns").alias("birth_ns"), F.col("c.pid").alias("children"))

    own = pin(processes_at(events, tree, ["root"]).filter(F.col("root") == F.lit(root)))
    found = mapping_references(own, vma).select("event_id", "start_addr").join(own.select("event_id", "pid"), "event_id")
    found = found.join(vma.select("pid", "start_addr", "end_addr", "pathname", "perms"), ["pid", "start_addr"])
    at = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    mapping = F.struct(
        at("start_addr").alias("start"), at("end_addr").alias("end"), S.int_div(F.col("end_addr") - F.col("start_addr"), 1024).alias("size_kb"),
        F.col("perms").alias("permissions"), F.col("pathname").alias("file"),
    )
    whole = own.join(found.select("event_id", mapping.alias("mapping")), "event_id", "left")
    call = F.struct(F.col("syscall").alias("type"), "pid", "comm", "fd", "length", F.col("file_offset").alias("offset"), F.col("ts_ns").alias("timestamp_ns"), "latency_us", "filename")
    event = F.struct(call.alias("syscall"), F.col("path").alias("fd_info"), "mapping", "page_events")

    names = events.filter(F.col("pid") == F.lit(root)).select(F.col("comm").alias("c")).unionByName(forks.filter(F.col("parent_pid") == F.lit(root)).select(F.col("parent_comm").alias("c")))
    comm = F.lit(names.agg(F.coalesce(F.min("c"), F.lit(""))).first()[0])
    pid = F.lit(root).cast("long")
    head = own.agg(F.count(F.lit(1)).alias("event_count")).select(
        pid.alias("pid"), F.lit(True).alias("follow_forks"), "event_count", F.struct(pid.alias("root_pid"), comm.alias("root_comm")).alias("process_tree")
    )
    pids = family.select("pid").distinct()
    return head, {
        "tracked_pids": pids.select(F.col("pid").cast("long").alias("at"), F.lit(0).cast("long").alias("tie"), F.col("pid").cast("string").alias("value")),
        "process_tree.forks": entries(born, F.col("birth_ns"), F.col("pid"), fork),
        "process_tree.children": entries(nodes, F.col("parent_pid"), F.col("up_ns"), node),
        # Lists are read for their first entry, too.
        "events": pin(entries(whole, F.col("ts_ns"), F.col("event_id"), event)),
    }
