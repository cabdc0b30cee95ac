"""System call and I/O path analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotrail.functions.scalar import floor_log2, int_div
from iotrail.operators.asof import asof_join, range_join
from iotrail.operators.automaton import lowest_holder
from iotrail.operators.blocks import count_if
from iotrail.operators.series import top_ranked
from iotrail.operators.scan import LastSeen, Previous, RunningSum, Scan
from iotrail.session import pin

NO_FD = 4294967295
# Calls that transfer bytes, and calls that work on files.
IO_CALLS = ("read", "write", "pread64", "pwrite64")
FILE_CALLS = ("openat", "close", "lseek")


def enter_exit_pairs(events: DataFrame, order: Sequence[str] = ("ts_ns", "event_id")) -> DataFrame:
    """Exits joined to the call of the same number their thread entered last.

    ``phase`` is enter or exit. A negative result is an error number.
    """
    entering = F.col("phase") == "enter"
    stash = F.struct(
        entering.alias("is"), "syscall_nr", "fd", "size", "file_offset", F.col("ts_ns").alias("enter_ns")
    )
    rows = Scan(events, ["tid"], order).add(Previous("_in", stash)).df
    fits = ~entering & F.col("_in.is") & (F.col("_in.syscall_nr") == F.col("syscall_nr"))
    ret = F.col("ret")
    return rows.filter(fits).select(
        "event_id",
        "tid",
        "syscall_nr",
        F.col("_in.fd").alias("fd"),
        F.col("_in.size").alias("requested"),
        F.col("_in.file_offset").alias("file_offset"),
        F.greatest(ret, F.lit(0)).alias("transferred"),
        F.when(ret < 0, -ret).alias("error_code"),
        (F.col("ts_ns") - F.col("_in.enter_ns")).alias("latency_ns"),
    )


def with_paths(events: DataFrame, opens: DataFrame) -> DataFrame:
    """Add the path the descriptor was last opened with in the same process."""
    return asof_join(events, opens, ["pid", "fd"], "ts_ns", "open_ns", {"path": "path"}, tie=["path"])


def totals(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("size").alias("bytes"),
        F.avg("size").alias("avg_bytes"),
    )


def ranked_totals(events: DataFrame, by: str) -> DataFrame:
    """Totals with their rank by bytes, however many there are."""
    rows = totals(events, [by]).withColumn("_less", -F.col("bytes"))
    return Scan(rows, [], ["_less", by]).add(RunningSum("rank", F.lit(1))).df.drop("_less")


def process_breakdown(events: DataFrame) -> DataFrame:
    """Per process and syscall: count, bytes, mean and share of the process's calls."""
    per = totals(events, ["pid", "syscall_name"])
    all_calls = per.groupBy("pid").agg(F.sum("count").alias("_all"))
    rows = per.join(all_calls, "pid")
    return rows.withColumn("pct_of_process", F.col("count") * 100 / F.col("_all")).drop("_all")


def run_summary(events: DataFrame) -> DataFrame:
    """One row: calls, bytes, calls on files, calls a second and the busiest process (ties: the smallest pid)."""
    name, n = F.col("syscall_name"), F.count(F.lit(1))
    per_pid = events.groupBy("pid").agg(
        n.alias("n"),
        F.sum(F.when(name.isin(*IO_CALLS), F.col("size"))).alias("b"),
        count_if(name.isin(*FILE_CALLS)).alias("f"),
        F.max("ts_ns").alias("t"),
    )
    return per_pid.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.sum("b").alias("io_bytes"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("file_ops"),
        (F.sum("n") / (F.max("t") / 1e9)).alias("per_second"),
        F.max_by("pid", F.struct(F.col("n"), -F.col("pid"))).alias("busiest_pid"),
    )


def process_io(events: DataFrame, children: DataFrame, calls: Sequence[str]) -> DataFrame:
    """Per process: events, bytes read and written, the number of each of ``calls``, and whether it is one of ``children`` (pid)."""
    name, size = F.col("syscall_name"), F.col("size")
    stats = events.groupBy("pid").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(name.isin("read", "pread64"), size)), F.lit(0)).alias("bytes_read"),
        F.coalesce(F.sum(F.when(name.isin("write", "pwrite64"), size)), F.lit(0)).alias("bytes_written"),
        *[count_if(name == c).alias(f"n_{c}") for c in calls],
    )
    known = children.select("pid").distinct().withColumn("role", F.lit("child"))
    return stats.join(known, "pid", "left").withColumn("role", F.coalesce("role", F.lit("parent")))


def file_access(events: DataFrame, marker: str, top: int) -> DataFrame:
    """The ``top`` files by accesses among those whose path holds ``marker``, with bytes, processes and calls; ``events`` have paths."""
    table = events.filter(F.col("path").contains(marker)).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("bytes"),
        F.count_distinct("pid").alias("pids"),
        F.array_sort(F.collect_set("syscall_name")).alias("syscalls"),
    )
    return top_ranked(table, [F.desc("n"), F.asc("path")], top)


def process_sets(live: DataFrame, active: DataFrame) -> DataFrame:
    """(``kind``, ``pid``): processes in both tables, only in ``live``, or only in ``active``; each pid once."""
    seen = live.select("pid", F.lit(1).alias("l"), F.lit(0).alias("a")).unionByName(active.select("pid", F.lit(0).alias("l"), F.lit(1).alias("a")))
    sides = seen.groupBy("pid").agg(F.max("l").alias("l"), F.max("a").alias("a"))
    kind = F.when((F.col("l") == 1) & (F.col("a") == 1), "both").when(F.col("l") == 1, "live_only").otherwise("active_only")
    return sides.select(kind.alias("kind"), "pid")


def fd_usage(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Operations, bytes and the set of calls per descriptor."""
    valid = events.filter(F.col("fd").isNotNull() & (F.col("fd") != NO_FD))
    return valid.groupBy(*by, "fd").agg(
        F.count(F.lit(1)).alias("ops"),
        F.sum("size").alias("bytes"),
        F.array_sort(F.collect_set("syscall_name")).alias("syscalls"),
    )


def timeline(events: DataFrame, bin_ns: int = 100_000_000, max_bins: int | None = None) -> DataFrame:
    """Calls per process, syscall and bin; every process has its own bins.

    A process gets one bin per ``bin_ns`` of its span; with ``max_bins`` its bins get wider instead of more. The event at the very end
    belongs to the last bin.
    """
    spans = events.groupBy("pid").agg(
        F.min("ts_ns").alias("_t0"), (F.max("ts_ns") - F.min("ts_ns")).alias("_dur")
    )
    bins = int_div(F.col("_dur"), bin_ns) + 1
    bins = F.least(bins, F.lit(max_bins)) if max_bins else bins
    rows = events.join(spans.withColumn("_n", bins), "pid")
    width = F.col("_dur") / F.col("_n")
    at = F.when(F.col("_dur") > 0, F.floor((F.col("ts_ns") - F.col("_t0")) / width)).otherwise(0)
    rows = rows.withColumn("bin", F.least(at.cast("long"), F.col("_n") - 1))
    return rows.groupBy("pid", "syscall_name", "bin").agg(F.count(F.lit(1)).alias("n"))


def offset_series(events: DataFrame, top: int = 5) -> DataFrame:
    """Positioned I/O of the busiest descriptors of each process."""
    used = events.filter(F.col("file_offset") != 0)
    counts = used.groupBy("pid", "fd").agg(F.count(F.lit(1)).alias("n"))
    # A process has at most as many rows here as it has descriptors.
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("n"), "fd"))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= top).select("pid", "fd")
    return used.join(best, ["pid", "fd"], "left_semi")


def intent_summary(events: DataFrame, order: Sequence[str] = ("ts_ns", "event_id")) -> DataFrame:
    """Per direction: calls, bytes, extremes and sequential against random accesses.

    An access is judged by the end of the access before it on the same
    descriptor since it was opened; an end of 0 does not count.
    """
    opens = F.col("syscall_name").isin("openat", "close")
    scan = Scan(events, ["pid", "fd"], order)
    rows = scan.add(RunningSum("epoch", F.when(opens, 1).otherwise(0))).df
    name = F.col("syscall_name")
    way = F.when(name.isin("read", "pread64"), "read").when(name.isin("write", "pwrite64"), "write")
    rows = rows.withColumn("direction", way).filter("direction IS NOT NULL")
    placed = name.isin("pread64", "pwrite64")
    end = F.when(placed, F.col("file_offset") + F.col("size"))
    second = Scan(rows, ["pid", "fd", "epoch", "direction"], order, scan.chunked)
    rows = second.add(LastSeen("expected", end, exclusive=True)).df
    known = placed & (F.col("expected") > 0)
    return rows.groupBy("direction").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("size").alias("bytes"),
        F.min("size").alias("smallest"),
        F.max("size").alias("largest"),
        count_if(known & (F.col("file_offset") == F.col("expected"))).alias("sequential"),
        count_if(known & (F.col("file_offset") != F.col("expected"))).alias("random"),
    )


# Calls that carry intents, by direction and by how they name their length.
INTENT_CALLS = {
    "read": ("read", "plain"), "pread64": ("read", "plain"), "write": ("write", "plain"), "pwrite64": ("write", "plain"), "readv": ("read", "vector"), "preadv": ("read", "vector"),
    "preadv2": ("read", "vector"), "writev": ("write", "vector"), "pwritev": ("write", "vector"), "pwritev2": ("write", "vector"), "mmap": ("map", "mapped"),
}


def intent_lengths(events: DataFrame) -> DataFrame:
    """Calls and bytes by direction, kind of length (plain, vector, mapped) and log2 bucket; lengths below one have the bucket -1."""
    known = F.create_map(*[F.lit(x) for name, (way, kind) in INTENT_CALLS.items() for x in (name, f"{way} {kind}")])
    sort = F.split(F.element_at(known, F.col("syscall_name")), " ")
    rows = events.select(sort.alias("sort"), "size").filter("sort IS NOT NULL")
    bucket = F.when(F.col("size") >= 1, floor_log2(F.col("size"), 62)).otherwise(-1).cast("long")
    rows = rows.groupBy(F.col("sort")[0].alias("direction"), F.col("sort")[1].alias("length"), bucket.alias("bucket"))
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.sum("size").alias("bytes"))


def descriptor_bytes(events: DataFrame, order: Sequence[str] = ("ts_ns", "event_id")) -> DataFrame:
    """Bytes read and written through every opening of a descriptor; they begin anew at an open or close."""
    starts = F.col("syscall_name").isin("openat", "open", "close")
    rows = Scan(events, ["pid", "fd"], order).add(RunningSum("opening", F.when(starts, 1).otherwise(0))).df
    known = F.create_map(*[F.lit(x) for name, (way, _) in INTENT_CALLS.items() for x in (name, way)])
    way = F.element_at(known, F.col("syscall_name"))
    side = lambda w: F.coalesce(F.sum(F.when(way == w, F.col("size"))), F.lit(0))
    return rows.groupBy("pid", "fd", "opening").agg(side("read").alias("read_bytes"), side("write").alias("written_bytes"))


def call_latency(events: DataFrame, calls: Sequence[str], latency: str, by: Sequence[str] = ("pid",)) -> DataFrame:
    """Number, mean and extremes of the positive latencies of some calls, such as fsync and fdatasync."""
    used = events.filter(F.col("syscall_name").isin(*calls) & (F.col(latency) > 0))
    return used.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("avg_us"), F.min(latency).alias("min_us"), F.max(latency).alias("max_us"))


def fork_tree(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Root and depth of every process from (parent_pid, child_pid, ts_ns) fork records.

    Process ids are used again, so a process is a pid and its birth: the parent of a fork is the latest process of the parent's pid that
    was born before it, or one that was running before the trace (``birth_ns`` -1, a root) if there is none. Parents are older than their
    children, so there are no cycles. Records that repeat a birth count once (the smallest parent). Every open process points at an
    ancestor; each round replaces it by what that ancestor points at, so a tree of depth d takes about log2(d) joins.

    ``known`` are processes of earlier records (pid, birth_ns, root, depth), all born before these; only what is new is returned.
    """
    born = edges.groupBy(F.col("child_pid").alias("pid"), F.col("ts_ns").alias("birth_ns")).agg(F.min("parent_pid").alias("up"))
    born = pin(born.withColumn("before_ns", F.col("birth_ns") - 1))
    births = born.select(F.col("pid").alias("up"), F.col("birth_ns").alias("up_birth"))
    if known is not None:
        births = births.unionByName(known.filter("birth_ns >= 0").select(F.col("pid").alias("up"), F.col("birth_ns").alias("up_birth")))
    placed = asof_join(born, births, ["up"], "before_ns", "up_birth", {"up_birth": "up_birth"})
    todo = pin(placed.select("pid", "birth_ns", "up", F.coalesce("up_birth", F.lit(-1)).cast("long").alias("up_birth"), F.lit(1).cast("long").alias("depth")))
    roots = todo.filter("up_birth = -1").select(F.col("up").alias("pid"), F.lit(-1).cast("long").alias("birth_ns")).distinct()
    if known is not None:
        roots = roots.join(known, ["pid", "birth_ns"], "left_anti")
    done = pin(roots.select("pid", "birth_ns", F.col("pid").alias("root"), F.lit(0).cast("long").alias("depth")))
    while not todo.isEmpty():
        ended = done if known is None else done.unionByName(known.select(*done.columns))
        ends = ended.select(
            F.col("pid").alias("up"), F.col("birth_ns").alias("up_birth"), F.col("root").alias("_up"), F.lit(None).cast("long").alias("_birth"), F.col("depth").alias("_d"), F.lit(True).alias("_end")
        )
        ways = todo.select(
            F.col("pid").alias("up"), F.col("birth_ns").alias("up_birth"), F.col("up").alias("_up"), F.col("up_birth").alias("_birth"), F.col("depth").alias("_d"), F.lit(False).alias("_end")
        )
        joined = todo.join(ends.unionByName(ways), ["up", "up_birth"])
        step = pin(joined.select("pid", "birth_ns", "_up", "_birth", (F.col("depth") + F.col("_d")).alias("depth"), "_end"))
        done = done.unionByName(step.filter("_end").select("pid", "birth_ns", F.col("_up").alias("root"), "depth"))
        todo = step.filter("NOT _end").select("pid", "birth_ns", F.col("_up").alias("up"), F.col("_birth").alias("up_birth"), "depth")
    return done


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def mapping_references(events: DataFrame, vma: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """The mapping each call refers to, by decreasing certainty.

    1 the address mmap returned, 2 the hint address, 3 the path or base name
    behind the descriptor, 4 a file name that is part of a mapped path. Among
    equals the lowest mapping wins. Steps 1 to 3 are equi-joins, step 4 is one automaton over all names.
    """
    maps = vma.select("pid", "start_addr", "end_addr", "pathname")
    in_file = maps.filter((F.col("pathname") != "") & ~F.col("pathname").startswith("["))
    ids = events.select("event_id", "pid", "syscall", "return_value", "address", "path", "filename")
    mmaps = ids.filter("syscall = 'mmap'")

    def by_address(column: str, priority: int) -> DataFrame:
        points = mmaps.filter(F.col(column) > 0).select("event_id", "pid", F.col(column).alias("_a"))
        hit = range_join(points, maps, ["pid"], "_a", "start_addr", "end_addr", cell)
        return hit.select("event_id", F.lit(priority).alias("priority"), "start_addr")

    first = in_file.groupBy("pid", basename(F.col("pathname")).alias("_base")).agg(
        F.min("start_addr").alias("start_addr")
    )
    named = ids.filter((F.col("path") != "") & ~F.col("path").startswith("<"))
    by_path = named.withColumn("_base", basename(F.col("path"))).join(first, ["pid", "_base"])
    by_path = by_path.select("event_id", F.lit(3).alias("priority"), "start_addr")
    parts = lowest_holder(ids, in_file, ["pid"], "filename", "pathname", "start_addr")
    by_name = ids.join(parts, ["pid", "filename"]).select(
        "event_id", F.lit(4).alias("priority"), "start_addr"
    )
    found = by_address("return_value", 1).unionByName(by_address("address", 2))
    found = found.unionByName(by_path).unionByName(by_name)
    best = found.groupBy("event_id").agg(F.min(F.struct("priority", "start_addr")).alias("m"))
    return best.select("event_id", "m.priority", "m.start_addr")


def best_shared_mapping(vma: DataFrame) -> DataFrame:
    """Per process the largest shared mapping: of a plain file if there is one,
    else of anything without brackets."""
    path = F.coalesce(F.col("pathname"), F.lit(""))
    odd = path.contains("/dev/") | path.contains("(deleted)") | path.contains("SYSV") | (path == "")
    shared = vma.filter(F.col("perms").contains("s") & ~path.startswith("["))
    size = F.col("end_addr") - F.col("start_addr")
    ranked = F.struct(F.when(odd, 0).otherwise(1), size, -F.col("start_addr"))
    return shared.filter(size > 0).groupBy("pid").agg(
        F.max_by(F.struct("start_addr", "end_addr", "pathname"), ranked).alias("m")
    ).select("pid", "m.*")


def sampled(events: DataFrame, order: Sequence[str], every: int) -> DataFrame:
    """Every n-th event in order."""
    rows = Scan(events, [], order).add(RunningSum("_n", F.lit(1))).df
    return rows.filter(F.col("_n") % every == 0).drop("_n")
