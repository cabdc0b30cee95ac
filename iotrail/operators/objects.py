"""Attribution of device commands to application objects, and object reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import command_role, int_div, project_object, round_up
from iotrail.functions.stats import quantiles
from iotrail.operators.asof import asof_join
from iotrail.operators.blocks import count_if
from iotrail.operators.scan import Following, LastSeen, NextSeen, Previous, RunningSum, Scan
from iotrail.operators.sweep import best_open
from iotrail.session import pin

SLACK_NS = 5_000_000


def by_tag(cmd: DataFrame, obj: DataFrame) -> DataFrame:
    """Commands with the record of their tag; untagged and unknown ones get nulls."""
    records = obj.select([F.col(c).alias(f"obj_{c}") for c in obj.columns])
    return cmd.join(records, cmd["tid"] == records["obj_trace_id"], "left")


def by_key(obj: DataFrame, cmd: DataFrame, ts: str = "ts_ns") -> DataFrame:
    """Commands with a dense id of their key in first-seen order; 0 if unclaimed.

    Records carry ``key_hex`` or a text ``key``; commands carry ``key_hex``.
    """
    own = F.lower(F.coalesce(F.col("key_hex"), F.hex(F.encode(F.col("key"), "UTF-8"))))
    keys = obj.groupBy(own.alias("_key")).agg(F.min(ts).alias("_first"))
    ids = Scan(keys, [], ["_first", "_key"]).add(RunningSum("object_id", F.lit(1))).df
    named = cmd.withColumn("_key", F.lower("key_hex"))
    joined = named.join(ids.drop("_first"), "_key", "left").drop("_key")
    return joined.withColumn("object_id", F.coalesce("object_id", F.lit(0)))


def by_extent(
    obj: DataFrame,
    cmd: DataFrame,
    record: Sequence[str],
    block_bytes: int,
    header_bytes: int = 4096,
    align: int = 4096,
    slack_ns: int = SLACK_NS,
    chunked: bool | None = None,
) -> DataFrame:
    """Commands attributed by byte range and time window.

    The only slot a command can belong to is the one with the greatest base at
    or below its offset. It must lie fully inside the slot; then the operations
    of the slot whose window holds its time are candidates, one whose direction
    matches wins, and the first in record order among equals. ``match`` tells
    unique, cross_object, gap_spill and unmatched commands apart. Repeated
    commands stay; every command comes out once.

    Slots and commands go by offset, then windows and commands of a slot by time, each in one stream.
    """
    ops = obj.filter("slot_offset IS NOT NULL").select(
        F.col("slot_offset").alias("lo"),
        (F.col("slot_offset") + header_bytes + round_up(F.col("bytes"), align)).alias("hi"),
        (F.col("ts_start_ns") - slack_ns).alias("t0"),
        (F.col("ts_ns") + slack_ns + 1).alias("t1"),
        *[F.col(c).alias(f"rec_{i}") for i, c in enumerate(record)],
        F.when(F.col("op") == "store", "write").when(F.col("op") == "load", "read").alias("way"),
        F.col("trace_id").alias("obj_id"),
    )
    order = [f"rec_{i}" for i in range(len(record))]
    slots = ops.groupBy("lo").agg(F.min_by("hi", F.struct(*order)).alias("hi"))
    base = slots.select(F.col("lo").alias("off"), F.lit(0).alias("_side"), F.struct("lo", "hi").alias("_slot"))
    placed = cmd.select(
        (F.col("slba") * block_bytes).alias("off"), F.lit(1).alias("_side"), F.struct(*cmd.columns).alias("_row")
    ).withColumn("_mix", F.xxhash64("_row"))
    both = base.unionByName(placed, allowMissingColumns=True)
    scan = Scan(both, [], ["off", "_side", "_mix"])
    scan.add(LastSeen("_at", F.col("_slot")), NextSeen("_next", F.col("_slot.lo")))
    end = F.col("off") + F.col("_row.bytes")
    place = (
        F.when(F.col("_at.lo").isNull() | (F.col("off") >= F.col("_at.hi")), "unmatched")
        .when((end > F.col("_at.hi")) & (F.col("_next") < end), "cross_object")
        .when(end > F.col("_at.hi"), "gap_spill")
        .otherwise("inside")
    )
    at = pin(scan.df.filter("_side = 1").select("_row.*", "off", F.col("_at.lo").alias("lo"), place.alias("match")))
    inside = best_open(at.filter("match = 'inside'"), ops, "lo", "ts_ns", "op_name", "t0", "t1", order, "way", "obj_id", chunked)
    found = F.when(F.col("obj_id").isNotNull(), "unique").otherwise("unmatched")
    return inside.withColumn("match", found).unionByName(at.filter("match <> 'inside'"), allowMissingColumns=True)


def parity(attributed: DataFrame) -> DataFrame:
    """How extent attribution agrees with the tags the commands also carry."""
    unique, tagged = F.col("match") == "unique", F.col("tid") != 0
    classes = ("unique", "cross_object", "gap_spill", "unmatched")
    return attributed.agg(
        *[count_if(F.col("match") == c).alias(c) for c in classes],
        count_if(tagged).alias("tagged"),
        count_if(unique & tagged).alias("ground_truth"),
        count_if(unique & tagged & (F.col("obj_id") == F.col("tid"))).alias("agree"),
        count_if(unique & ~tagged).alias("extent_only"),
    )


def occurrences(obj: DataFrame, key: str, end: str = "ts_ns", tie: Sequence[str] = ()) -> DataFrame:
    """Number the operations on one key by their end."""
    scan = Scan(obj, [key], [end, *tie]).add(RunningSum("occ", F.lit(1)))
    return scan.df.withColumn("occ", F.col("occ") - 1)


def to_occurrence(cmd: DataFrame, occ: DataFrame, key: str, ts: str = "ts_ns") -> DataFrame:
    """Each command with the first operation that ends at or after it, else the last one."""
    ends = occ.select(key, F.col(ts).alias("end_ns"), "occ", (-F.col("occ")).alias("later"))
    hit = asof_join(cmd, ends, [key], ts, "end_ns", {"occ": "occ"}, tie=["later"], forward=True)
    last = occ.groupBy(key).agg(F.max("occ").alias("last_occ"))
    both = hit.join(last, key, "left")
    return both.withColumn("occ", F.coalesce("occ", "last_occ")).drop("last_occ")


def object_spans(occ: DataFrame, cmd: DataFrame, key: str, cmd_order: Sequence[str]) -> DataFrame:
    """Span of each operation, widened to its commands, with its first and last command.

    ``late`` marks operations that end before their last command. An operation
    without commands and without duration is an instant.
    """
    first, last = F.struct(*cmd_order), F.struct(*cmd_order)
    per_op = cmd.groupBy(key, "occ").agg(
        F.count(F.lit(1)).alias("n_cmds"),
        F.sum("bytes").alias("cmd_bytes"),
        F.min("ts_ns").alias("first_cmd_ns"),
        F.max("ts_ns").alias("last_cmd_ns"),
        F.min_by("slba", first).alias("first_slba"),
        F.max_by("slba", last).alias("last_slba"),
    )
    rows = occ.join(per_op, [key, "occ"], "left")
    begin = F.least("ts_start_ns", "first_cmd_ns")
    end = F.greatest("ts_ns", "last_cmd_ns")
    return rows.withColumns(
        {
            "begin_ns": begin,
            "end_ns": end,
            "late": F.coalesce(F.col("last_cmd_ns") > F.col("ts_ns"), F.lit(False)),
            "is_span": F.col("n_cmds").isNotNull() | (end > begin),
        }
    )


def issuers(cmd: DataFrame, by: str, pid: str = "pid", thread: str = "thread", label: str = "tid") -> DataFrame:
    """Who issues commands: distinct processes, threads and objects for each value of ``by``, and in all.

    Distinct (process, thread, object) triples come first, which is where the rows shrink.
    """
    seen = cmd.groupBy(F.col(by).alias("by"), F.col(pid).alias("pid"), F.col(thread).alias("thread"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    sets = seen.rollup("by").agg(
        F.grouping("by").alias("whole"),
        F.sum("n").alias("cmds"),
        F.count_distinct("pid").alias("pids"),
        F.count_distinct("thread").alias("threads"),
        F.count_distinct("label").alias("objects"),
    )
    return sets.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("by").cast("string")).alias(by), "cmds", "pids", "threads", "objects")


def timeline(spans: DataFrame, counters: DataFrame, key: str = "obj_key", label: str = "trace_id") -> DataFrame:
    """One table of all that happens, in the order in which it is to be drawn: (position, ts_ns, ord, kind, name, id, value).

    Of ``object_spans`` come ``begin`` and ``end`` of every span (value: its bytes
    and its commands), ``instant`` for operations that are none, ``late`` marks
    where an operation ends before its commands, and ``flow_out`` and ``flow_in``
    at the first and last command (value: their addresses). ``counters`` has
    (ts_ns, name, value). At one time counters come first, then begins, flows and
    instants, and ends last; ids settle the rest, so that the order is the same in
    every run. Positions start at 1 without gaps.
    """

    def mark(when: Column, ts: str, order: int, kind: str, value: str) -> Column:
        return F.when(
            when,
            F.struct(F.col(ts).alias("ts_ns"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), F.col(value).cast("long").alias("value")),
        )

    span = F.col("is_span")
    linked = F.col("n_cmds").isNotNull()
    marks = F.array(
        mark(span, "begin_ns", 2, "begin", "cmd_bytes"),
        mark(~span, "begin_ns", 3, "instant", "bytes"),
        mark(linked, "first_cmd_ns", 3, "flow_out", "first_slba"),
        mark(linked, "last_cmd_ns", 3, "flow_in", "last_slba"),
        mark(F.col("late"), "ts_ns", 3, "late", "n_cmds"),
        mark(span, "end_ns", 4, "end", "n_cmds"),
    )
    events = spans.select(F.col(key).cast("string").alias("name"), F.col(label).cast("long").alias("id"), F.explode(F.array_compact(marks)).alias("e"))
    drawn = counters.select("ts_ns", F.lit(1).alias("ord"), F.lit("counter").alias("kind"), "name", F.lit(None).cast("long").alias("id"), F.col("value").cast("long").alias("value"))
    rows = drawn.unionByName(events.select("e.ts_ns", "e.ord", "e.kind", "name", "id", "e.value"))
    order = ["ts_ns", "ord", "kind", "id", "name", "value"]
    return Scan(rows, [], order).add(RunningSum("position", F.lit(1))).df.select("position", "ts_ns", "ord", "kind", "name", "id", "value")


def durations(
    cmd: DataFrame, order: Sequence[str], nominal_ns: int, gap_share: float = 0.9
) -> DataFrame:
    """Duration shown for a command: the real one, or a nominal one that ends
    before the next command of the same role."""
    roles = cmd.withColumn("role", command_role(F.col("tid"), F.col("op_name")))
    scan = Scan(roles, ["role"], ["ts_ns", *order], chunked=True)
    rows = scan.add(Following("_next", F.col("ts_ns"))).df
    gap = F.floor((F.col("_next") - F.col("ts_ns")) * F.lit(gap_share)).cast("long")
    room = F.coalesce(F.least(F.lit(nominal_ns), gap), F.lit(nominal_ns))
    shown = F.greatest(F.lit(1), F.coalesce("dur_ns", room))
    return rows.withColumns({"is_real": F.col("dur_ns").isNotNull(), "shown_ns": shown}).drop("_next")


def inferred_block_bytes(
    obj: DataFrame, cmd: DataFrame, candidates: Sequence[int]
) -> DataFrame:
    """Score candidate block sizes by stores whose header command they explain.

    All stores that have commands vote; the flagged size (first candidate) wins
    ties. No size is chosen if none explains anything.
    """
    stores = obj.filter("op = 'store'").select("trace_id", "slot_offset")
    rows = cmd.join(stores, cmd["tid"] == stores["trace_id"])
    hits = [
        F.max(F.when(F.col("slba") * v == F.col("slot_offset"), 1).otherwise(0)).alias(f"c{i}")
        for i, v in enumerate(candidates)
    ]
    votes = rows.groupBy("trace_id").agg(*hits)
    entries = F.array(
        *[
            F.struct(F.lit(v).alias("block_bytes"), F.lit(i).alias("prio"), F.col(f"c{i}").alias("hit"))
            for i, v in enumerate(candidates)
        ]
    )
    long = votes.select(F.explode(entries).alias("e")).select("e.*")
    scores = long.groupBy("block_bytes", "prio").agg(F.sum("hit").alias("score"))
    top = scores.filter("score > 0").agg(F.max_by("block_bytes", F.struct(F.col("score"), -F.col("prio"))).alias("best"))
    best = top.first()["best"]
    return scores.select(
        "block_bytes",
        "score",
        F.coalesce(F.col("block_bytes") == F.lit(best).cast("long"), F.lit(False)).alias("chosen"),
    )


def device_totals(cmd: DataFrame) -> DataFrame:
    """Commands, bytes, distinct sizes and time range per object."""
    return cmd.groupBy("tid").agg(
        F.count(F.lit(1)).alias("cmds"),
        F.sum("bytes").alias("bytes"),
        F.count_distinct("bytes").alias("sizes"),
        F.min("ts_ns").alias("first_ns"),
        F.max("ts_ns").alias("last_ns"),
    )


def command_report(paired: DataFrame, by: Sequence[str] = ("op_name",)) -> DataFrame:
    """Commands per group: number, how many have a completion, bytes, wall time, share of real latencies, quantiles and bytes a ns."""
    by = list(by)
    wall = F.max(F.col("ts_ns") + F.coalesce("dur_ns", F.lit(0))) - F.min("ts_ns")
    n = F.count(F.lit(1))
    head = paired.groupBy(*by).agg(
        n.alias("n"),
        F.count("dur_ns").alias("n_real"),
        F.sum("bytes").alias("bytes"),
        wall.alias("wall_ns"),
        (F.count("dur_ns") / n).alias("real_cover"),
        F.max("dur_ns").alias("max_ns"),
        (F.sum("bytes") / wall).alias("gbs"),
    )
    lat = quantiles(paired, by, "dur_ns", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, nearest=True)
    return head.join(lat.drop("n"), by, "left")


def object_report(obj: DataFrame, cmd: DataFrame, by: Sequence[str] = ("op",)) -> DataFrame:
    """Span, efficiency and pre-submission quantiles of the successful operations."""
    by = list(by)
    first = cmd.groupBy("tid").agg(F.min("ts_ns").alias("first_cmd"))
    span = F.col("ts_ns") - F.col("ts_start_ns")
    ok = obj.filter("error IS NULL").join(first, obj["trace_id"] == first["tid"], "left")
    rows = ok.withColumns(
        {
            "span_ns": span,
            "mbps": F.when(span > 0, F.col("bytes") / (span / 1e9) / 1e6),
            "pre_ns": F.col("first_cmd") - F.col("ts_start_ns"),
        }
    )
    speed = quantiles(rows, by, "mbps", {"mbps_p50": 0.5}, nearest=True).drop("n")
    # Both integer measures share one pass.
    pairs = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("span_ns", "pre_ns")]
    long = rows.select(*by, F.explode(F.array(*pairs)).alias("p")).select(*by, "p.*")
    both = quantiles(long, [*by, "kind"], "v", {"p50": 0.5, "p99": 0.99}, nearest=True)

    def of(kind: str, column: str, name: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column))).alias(name)

    times = both.groupBy(*by).agg(
        of("span_ns", "n", "n"),
        of("span_ns", "p50", "span_p50"),
        of("span_ns", "p99", "span_p99"),
        of("pre_ns", "p50", "presubmit_p50"),
    )
    return times.join(speed, by, "left")


def submission_gaps(cmd: DataFrame, order: Sequence[str], min_cmds: int = 4) -> DataFrame:
    """Gaps between the commands of an object, for objects with enough commands.

    ``kind`` is load if the first command of the object is a read.
    """
    first = F.min_by("op_name", F.struct("ts_ns", *order))
    sizes = cmd.groupBy("tid").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    kinds = sizes.filter(F.col("_n") >= min_cmds).select(
        "tid", F.when(F.col("_first") == "read", "load").otherwise("store").alias("kind")
    )
    slim = cmd.select(*dict.fromkeys(["tid", "ts_ns", *order]))
    scan = Scan(slim, ["tid"], ["ts_ns", *order]).add(Previous("_prev", F.col("ts_ns")))
    rows = scan.df.join(kinds, "tid").filter("_prev IS NOT NULL")
    return rows.select("tid", "kind", (F.col("ts_ns") - F.col("_prev")).alias("gap_ns"))


def serialization(gaps: DataFrame, latency: DataFrame) -> DataFrame:
    """Whether the gaps look like one command at a time.

    ``latency`` holds real durations (``dur_ns``) with ``op_name``. A median gap
    of at least half the lower-quartile service time of the same direction
    counts as serialized; without latencies 40 us is the limit.
    """
    g = quantiles(gaps, ["kind"], "gap_ns", {"gap_p50": 0.5, "gap_p95": 0.95}, nearest=True)
    kind = F.when(F.col("op_name") == "read", "load").otherwise("store")
    svc = latency.filter("dur_ns IS NOT NULL").withColumn("kind", kind)
    s = quantiles(svc, ["kind"], "dur_ns", {"service_p25": 0.25}, nearest=True).drop("n")
    rows = g.join(s, "kind", "left")
    slow = F.when(F.col("service_p25") > 0, F.col("gap_p50") >= 0.5 * F.col("service_p25"))
    slow = slow.otherwise(F.col("gap_p50") >= 40_000)
    return rows.withColumn("verdict", F.when(slow, "serialized").otherwise("pipelined"))


def batches(cmd: DataFrame, order: Sequence[str], gap_ns: int, keys: Sequence[str] = ()) -> DataFrame:
    """Size of each run of submissions without a gap above ``gap_ns``."""
    slim = cmd.select(*dict.fromkeys([*keys, "ts_ns", *order]))
    scan = Scan(slim, keys, ["ts_ns", *order]).add(Previous("_prev", F.col("ts_ns")))
    opens = F.col("_prev").isNull() | (F.col("ts_ns") - F.col("_prev") > gap_ns)
    scan.add(RunningSum("batch", F.when(opens, 1).otherwise(0)))
    return scan.df.groupBy(*keys, "batch").agg(
        F.count(F.lit(1)).alias("size"), F.min("ts_ns").alias("start_ns")
    )


def write_locality(cmd: DataFrame, order: Sequence[str], block_bytes: int) -> DataFrame:
    """Reuse of write addresses and share of sequential writes."""
    writes = cmd.filter("op_name = 'write'")
    writes = writes.select(*dict.fromkeys(["ts_ns", *order, "slba", "bytes"]))
    last = F.struct("slba", "bytes")
    rows = Scan(writes, [], ["ts_ns", *order]).add(Previous("_p", last)).df
    seq = F.col("slba") == F.col("_p.slba") + int_div(F.col("_p.bytes"), block_bytes)
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("writes"),
        (n - F.count_distinct("slba")).alias("reused"),
        (count_if(seq) / F.greatest(n - 1, F.lit(1))).alias("seq_share"),
    )


def interleaving(cmd: DataFrame, order: Sequence[str]) -> DataFrame:
    """How often consecutive reads belong to different objects."""
    reads = cmd.filter("op_name = 'read'").select(*dict.fromkeys(["ts_ns", *order, "tid"]))
    rows = Scan(reads, [], ["ts_ns", *order]).add(Previous("_p", F.col("tid"))).df
    same = count_if(F.col("_p") == F.col("tid"))
    other = count_if(F.col("_p") != F.col("tid"))
    return rows.agg(
        same.alias("same_object"),
        other.alias("other_object"),
        F.try_divide(other, same + other).alias("interleave_rate"),
    )


def ab_deltas(obj: DataFrame, label: str, base: Column, order: Sequence[str]) -> DataFrame:
    """Durations of matching operations in two captures: same key, op and occurrence."""
    used = obj.filter("op IN ('store', 'load')").withColumn("_base", base)
    scan = Scan(used, [label, "key", "op"], ["ts_start_ns", *order])
    rows = scan.add(RunningSum("_k", F.lit(1))).df
    rows = rows.withColumn("_dur", F.col("ts_ns") - F.col("ts_start_ns"))
    a = rows.filter("_base").select("key", "op", "_k", F.col("_dur").alias("_a"))
    b = rows.filter("NOT _base").select("key", "op", "_k", F.col("_dur").alias("_b"))
    both = a.join(b, ["key", "op", "_k"])
    return both.select("key", "op", F.col("_k").alias("occurrence"), (F.col("_b") - F.col("_a")).alias("delta_ns"))


def barrier_gaps(obj: DataFrame, by: Sequence[str], shards: int) -> DataFrame:
    """Time between the first and the last shard of a chunk that all shards finished."""
    ok = obj.filter("error IS NULL AND op IN ('store', 'load')")
    ends = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.max("ts_ns") - F.min("ts_ns")).alias("gap_ns")
    )
    return ends.filter(F.col("n") == shards).drop("n")


def manifest(obj: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Objects to replay: largest payload, operations and index in first-seen order."""
    used = obj.filter("op IN ('store', 'load') AND error IS NULL")
    first_of = {op: F.min(F.when(F.col("op") == op, F.struct(*order))) for op in ("store", "load")}
    objects = used.groupBy(key).agg(
        F.max("bytes").alias("payload_bytes"),
        F.min(F.struct(*order)).alias("_first"),
        first_of["store"].alias("_s"),
        first_of["load"].alias("_l"),
    )
    ops = (
        F.when(F.col("_l").isNull(), F.array(F.lit("store")))
        .when(F.col("_s").isNull(), F.array(F.lit("load")))
        .when(F.col("_s") < F.col("_l"), F.array(F.lit("store"), F.lit("load")))
        .otherwise(F.array(F.lit("load"), F.lit("store")))
    )
    scan = Scan(objects.withColumn("ops", ops), [], ["_first", key]).add(RunningSum("index", F.lit(1)))
    rows = scan.df.withColumn("index", F.col("index") - 1)
    return rows.select("index", key, F.lit("kv").alias("part"), "payload_bytes", "ops")


def projected_totals(obj: DataFrame, **geometry: int) -> DataFrame:
    """Projected command count and bytes for the successful stores and loads."""
    used = obj.filter("op IN ('store', 'load') AND error IS NULL")
    return used.withColumns(project_object(F.col("bytes"), F.col("op"), **geometry))


def projected_sizes(
    obj: DataFrame, mdts_bytes: int, header_bytes: int = 4096, block_bytes: int = 512
) -> DataFrame:
    """Projected command sizes as (trace_id, op, size, n); headers fit one command."""
    if header_bytes > mdts_bytes:
        raise ValueError("header_bytes must not exceed mdts_bytes")
    rows = projected_totals(
        obj, mdts_bytes=mdts_bytes, header_bytes=header_bytes, block_bytes=block_bytes
    )
    stored = F.when(F.col("op") == "store", 1).otherwise(0)
    payload_cmds = F.col("n_commands") - stored
    full = F.lit(-(-mdts_bytes // block_bytes) * block_bytes).cast("long")
    head = F.lit(-(-header_bytes // block_bytes) * block_bytes).cast("long")
    entries = F.array(
        F.struct(full.alias("size"), (payload_cmds - 1).cast("long").alias("n")),
        F.struct(
            F.col("tail_bytes").cast("long").alias("size"),
            F.least(payload_cmds, F.lit(1)).cast("long").alias("n"),
        ),
        F.struct(head.alias("size"), stored.cast("long").alias("n")),
    )
    long = rows.select("trace_id", "op", F.explode(entries).alias("e")).select("trace_id", "op", "e.*")
    return long.filter("n > 0").groupBy("trace_id", "op", "size").agg(F.sum("n").alias("n"))


def projection_score(obj: DataFrame, cmd: DataFrame, **geometry: int) -> DataFrame:
    """Exactness of the projection: counts, bytes, both, sizes, and the byte error."""
    proj = projected_totals(obj, **geometry).select("trace_id", "n_commands", "total_bytes")
    meas = cmd.groupBy(F.col("tid").alias("trace_id")).agg(
        F.count(F.lit(1)).alias("cmds"), F.sum("bytes").alias("meas_bytes")
    )
    rows = proj.join(meas, "trace_id", "left").fillna(0, ["cmds", "meas_bytes"])
    sizes = projected_sizes(obj, **geometry).drop("op")
    known = proj.select("trace_id")
    seen = cmd.groupBy(F.col("tid").alias("trace_id"), F.col("bytes").alias("size")).agg(
        F.count(F.lit(1)).alias("n")
    )
    seen = seen.join(known, "trace_id", "left_semi")
    signed = sizes.unionByName(seen.withColumn("n", -F.col("n")))
    off = signed.groupBy("trace_id", "size").agg(F.sum("n").alias("n")).filter("n <> 0")
    off = off.select("trace_id").distinct().withColumn("off", F.lit(True))
    rows = rows.join(off, "trace_id", "left")
    cmds_ok = F.col("cmds") == F.col("n_commands")
    bytes_ok = F.col("meas_bytes") == F.col("total_bytes")
    miss = F.sum(F.abs(F.col("meas_bytes") - F.col("total_bytes")))
    return rows.agg(
        F.count(F.lit(1)).alias("objects"),
        count_if(cmds_ok & bytes_ok).alias("exact"),
        count_if(cmds_ok).alias("cmds_exact"),
        count_if(bytes_ok).alias("bytes_exact"),
        count_if(F.col("off").isNull()).alias("sizes_exact"),
        F.coalesce(F.try_divide(miss, F.sum("meas_bytes")), F.lit(0.0)).alias("wape"),
    )


def size_variation(obj: DataFrame, cmd: DataFrame, by: Sequence[str] = ("op",), **geometry: int) -> DataFrame:
    """Per operation (or other columns of ``obj``): projected and measured size ranges and log2 total variation."""
    from iotrail.functions.scalar import floor_log2

    by = list(by)
    ops = obj.filter("op IN ('store', 'load') AND error IS NULL").select("trace_id", *by)
    sizes = projected_sizes(obj, **geometry).select("trace_id", "size", "n").join(ops, "trace_id").withColumn("side", F.lit("p"))
    seen = cmd.groupBy(F.col("tid").alias("trace_id"), F.col("bytes").alias("size")).agg(
        F.count(F.lit(1)).alias("n")
    )
    seen = seen.join(ops, "trace_id").withColumn("side", F.lit("m"))
    both = sizes.unionByName(seen)
    proj, meas = (F.when(F.col("side") == s, F.col("n")).otherwise(0) for s in ("p", "m"))
    bins = both.groupBy(*by, floor_log2(F.col("size")).alias("bin")).agg(
        F.sum(proj).alias("p"), F.sum(meas).alias("m")
    )
    totals = both.groupBy(*by).agg(
        F.sum(proj).alias("proj_n"),
        F.min(F.when(F.col("side") == "p", F.col("size"))).alias("proj_min"),
        F.max(F.when(F.col("side") == "p", F.col("size"))).alias("proj_max"),
        F.sum(meas).alias("meas_n"),
        F.min(F.when(F.col("side") == "m", F.col("size"))).alias("meas_min"),
        F.max(F.when(F.col("side") == "m", F.col("size"))).alias("meas_max"),
    )
    share = F.abs(F.try_divide("p", "proj_n") - F.try_divide("m", "meas_n"))
    tv = bins.join(totals, by).groupBy(*by).agg((F.sum(share) / 2).alias("tv"))
    return totals.join(tv, by)
