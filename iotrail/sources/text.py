"""Parsers of text traces: a ``value`` column of lines in, typed rows out.

Lines are cut at their own punctuation: blanks between words, ``key=value`` fields, brackets around names and arguments. Other columns of
the input (such as a file name) are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail.functions.scalar import field_value, is_discard, is_read, is_write


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def behind(text: Column, mark: str) -> Column:
    """What follows the first ``mark`` of a text, whatever its case; null without it."""
    at = F.instr(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), mark)
    return F.when(at > 0, F.substr(text, at + len(mark)))


def ahead(text: Column, mark: str) -> Column:
    """What stands in front of the first ``mark`` of a text, whatever its case; all of it without one."""
    at = F.instr(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), mark)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)


def digits(*texts: Column) -> Column:
    """Whether all texts are there and consist of digits."""
    return F.forall(F.array(*texts), lambda x: F.coalesce(x.rlike("^[0-9]+$"), F.lit(False)))


def matched(lines: DataFrame, keep_others: bool = False, **found: Column) -> DataFrame:
    """Add the groups; drop the lines without any, unless ``keep_others``.

    The groups are exploded rather than filtered, because a filter would be
    pushed below the projection and match every line a second time.
    """
    whole = F.struct(*[c.alias(n) for n, c in found.items()])
    some = F.filter(F.array(whole), lambda x: F.coalesce(*[x[n] for n in found]).isNotNull())
    spread = F.explode_outer(some) if keep_others else F.explode(some)
    return lines.withColumn("_m", spread).select(
        *lines.columns, *[F.col(f"_m.{n}").alias(n) for n in found]
    )


def number(text: Column, kind: str = "bigint") -> Column:
    return F.when(text != "", text).try_cast(kind)


def integer(text: Column) -> Column:
    """Decimal or 0x-prefixed integer with an optional sign."""
    bare = F.regexp_replace(text, "^-", "")
    value = F.when(
        bare.startswith("0x"), F.conv(F.substring(bare, 3, 32), 16, 10).try_cast("bigint")
    ).otherwise(number(bare))
    return F.when(text.startswith("-"), -value).otherwise(value)


def seconds_to_ns(text: Column) -> Column:
    """Decimal seconds as integer nanoseconds, without rounding through a double."""
    return (text.try_cast("decimal(28,9)") * 1_000_000_000).cast("bigint")


def block_fields(text: Column, tolerant: bool) -> Column:
    """Major, minor, cpu, seq, time, pid, action, rwbs, sector, blocks and process of an event line; null if it is none.

    ``major,minor cpu seq time pid action rwbs sector + blocks [process]``; rwbs may be missing, unless ``tolerant``, which in turn allows
    longer actions and digits in rwbs.
    """
    name = F.when(~F.lit(tolerant), F.substring_index(behind(text, "["), "]", 1))

    def cut(w: Column) -> Column:
        plus = F.array_position(w, "+")
        device = F.split(w[0], ",")
        rwbs = F.when(plus == 9, w[6]).when((plus == 8) & ~F.lit(tolerant), "")
        number_words = [F.get(device, F.lit(0)), F.get(device, F.lit(1)), F.get(w, F.lit(1)), F.get(w, F.lit(2)), F.get(w, F.lit(4))]
        place = [F.get(w, F.greatest(plus, F.lit(2)).cast("int") - 2), F.get(w, plus.cast("int"))]
        action, at = F.get(w, F.lit(5)), F.get(w, F.lit(3))
        letters = action.rlike("^[A-Z]+$") & rwbs.rlike("^[A-Z0-9]+$") if tolerant else action.rlike("^[A-Z]$") & rwbs.rlike("^[A-Z]*$")
        fits = (F.size(device) == 2) & digits(*number_words, *place) & at.rlike(r"^[0-9.]+$") & letters
        return F.when(fits, F.array(*number_words[:4], at, number_words[4], action, rwbs, *place, F.coalesce(name, F.lit(""))))

    return let(words(F.replace(ahead(text, "["), F.lit("+"), F.lit(" + "))), cut)


def block_trace(lines: DataFrame, tolerant: bool = False) -> DataFrame:
    """Block-layer events; ``parsed`` is false on lines that are none.

    Blank lines, per-CPU and total headers and separator lines are dropped.
    """
    text = F.trim("value")
    noise = (text == "") | text.rlike("^(CPU|Total)") | text.contains("==")
    rows = matched(lines.filter(~noise), keep_others=True, _g=block_fields(text, tolerant))
    at = F.col("_g")
    rwbs, action = at[7], at[6]
    return rows.select(
        *[c for c in lines.columns if c != "value"],
        at.isNotNull().alias("parsed"),
        number(at[0]).alias("major"),
        number(at[1]).alias("minor"),
        number(at[2]).alias("cpu"),
        number(at[3]).alias("seq"),
        seconds_to_ns(at[4]).alias("ts_ns"),
        number(at[5]).alias("pid"),
        action.alias("action"),
        rwbs.alias("rwbs"),
        number(at[8]).alias("sector"),
        number(at[9]).alias("nblocks"),
        at[10].alias("process"),
        is_read(rwbs).alias("is_read"),
        is_write(rwbs).alias("is_write"),
        is_discard(rwbs, action).alias("is_discard"),
    )


def event_time(line: Column, mark: str) -> Column:
    """The time of a trace line: the last word in front of the event's name, which ends in a colon."""
    last = F.element_at(words(ahead(line, mark)), -1)
    return F.when(last.endswith(":"), F.rtrim(last, F.lit(":")))


def request_fields(line: Column, event: str) -> Column:
    """Time, major, minor, rwbs, bytes ("" if not given), sector and sectors of a block request event; null on other lines.

    ``... time: event: major,minor rwbs bytes (command) sector + sectors [process]``; completions have no bytes.
    """

    def cut(parts: Column) -> Column:
        left, right = words(parts[1]), words(F.replace(parts[2], F.lit("+"), F.lit(" + ")))
        device = F.split(left[0], ",")
        sector, plus, count = (F.get(right, F.lit(i)) for i in range(3))
        size = F.coalesce(F.get(left, F.lit(2)), F.lit(""))
        numbers = [F.get(device, F.lit(0)), F.get(device, F.lit(1)), sector, count]
        fits = digits(*numbers) & (plus == "+") & F.get(left, F.lit(1)).rlike("^[A-Z]+$") & size.rlike("^[0-9]*$") & parts[0].isNotNull()
        return F.when(fits, F.array(parts[0], *numbers[:2], left[1], size, sector, count))

    tail = behind(line, event + ":")
    return let(F.array(event_time(line, event + ":"), F.substring_index(tail, "(", 1), behind(tail, ")")), cut)


def ftrace_block(lines: DataFrame) -> DataFrame:
    """Issue and complete events; a zero byte count falls back to the sectors."""
    line = F.col("value")
    rows = matched(lines, _i=request_fields(line, "block_rq_issue"), _c=request_fields(line, "block_rq_complete"))
    issue = F.col("_i").isNotNull()
    at = F.coalesce("_i", "_c")
    sectors = number(at[6])
    size = F.when(issue, F.nullif(number(at[4]), F.lit(0)))
    return rows.select(
        *[x for x in lines.columns if x != "value"],
        F.when(issue, "issue").otherwise("complete").alias("action"),
        seconds_to_ns(at[0]).alias("ts_ns"),
        number(at[1]).alias("major"),
        number(at[2]).alias("minor"),
        at[3].alias("rwbs"),
        F.coalesce(size, sectors * 512).alias("bytes"),
        number(at[5]).alias("sector"),
        sectors.alias("sectors"),
    )


def command_fields(line: Column, event: str) -> Column:
    """Time, controller, disk, qid, cmdid, nsid, command and status of a controller event ("" for what isn't given); null on other lines.

    ``... time: event: controller: [disk] key=value, key=value, ..., cmd=(command)``
    """
    tail = behind(line, event + ":")
    command = F.coalesce(F.substring_index(behind(tail, "cmd=("), ")", 1), F.lit(""))

    def cut(parts: Column) -> Column:
        w, at = parts["w"], parts["at"]
        controller, second = F.rtrim(w[0], F.lit(":")), F.coalesce(F.get(w, F.lit(1)), F.lit(""))
        disk = F.when(second.contains("=") | ~F.lower(second).startswith("nvme"), field_value(w, "disk")).otherwise(second)
        qid, cmdid = field_value(w, "qid"), field_value(w, "cmdid")
        fits = w[0].endswith(":") & F.lower(controller).startswith("nvme") & digits(F.substr(controller, F.lit(5)), qid, cmdid) & at.isNotNull()
        given = [F.substr(controller, F.lit(5)), disk, qid, cmdid, field_value(w, "nsid"), command, field_value(w, "status")]
        return F.when(fits, F.array(at, *[F.coalesce(x, F.lit("")) for x in given]))

    given = words(F.replace(ahead(tail, "cmd=("), F.lit(","), F.lit(" ")))
    # Lines of other events are not cut at all.
    return F.when(tail.isNotNull(), let(F.struct(given.alias("w"), event_time(line, event + ":").alias("at")), cut))


def ftrace_nvme(lines: DataFrame) -> DataFrame:
    """Command set-up and completion events, whatever the case of the text."""
    line = F.col("value")
    rows = matched(lines, _s=command_fields(line, "nvme_setup_cmd"), _f=command_fields(line, "nvme_complete_rq"))
    setup = F.col("_s").isNotNull()
    at = F.coalesce("_s", "_f")
    return rows.select(
        *[x for x in lines.columns if x != "value"],
        F.when(setup, "setup").otherwise("complete").alias("action"),
        seconds_to_ns(at[0]).alias("ts_ns"),
        number(at[1]).alias("ctrl"),
        F.nullif(at[2], F.lit("")).alias("disk"),
        number(at[3]).alias("qid"),
        number(at[4]).alias("cmdid"),
        F.when(setup, number(at[5])).alias("nsid"),
        F.when(setup, at[6]).alias("cmd"),
        F.when(~setup, F.coalesce(F.nullif(at[7], F.lit("")), F.lit("unknown"))).alias("status"),
    )


def call_fields(text: Column) -> Column:
    """Pid, time, name, arguments and result of a system call line; null on other lines.

    ``[pid N] time name(arguments) = result``; the arguments end at the first closing bracket.
    """
    inner = F.when(text.startswith("[pid"), F.trim(F.substring_index(behind(text, "[pid"), "]", 1)))
    call = F.when(text.startswith("["), F.trim(behind(text, "]"))).otherwise(text)

    def cut(c: Column) -> Column:
        front, rest = words(F.substring_index(c, "(", 1)), words(behind(c, ")"))
        time, name, result = F.get(front, F.lit(0)), F.get(front, F.lit(1)), F.get(rest, F.lit(1))
        fits = (F.size(front) == 2) & time.rlike(r"^[0-9]+[.][0-9]+$") & name.rlike(r"^\w+$") & (F.get(rest, F.lit(0)) == "=") & integer(result).isNotNull()
        return F.when(fits, F.array(F.coalesce(inner, F.lit("")), time, name, F.substring_index(behind(c, "("), ")", 1), result))

    return let(call, cut)


def strace(lines: DataFrame, default_pid: int = 0) -> DataFrame:
    """System calls; a call that made a child has ``child_pid`` and counts as a fork."""
    rows = matched(lines, _g=call_fields(F.trim("value")))
    g = F.col("_g")
    name, ret = g[2], integer(g[4])
    args = F.transform(F.split(g[3], ","), lambda a: F.trim(a))

    def arg(i: int) -> Column:
        return F.get(args, F.lit(i))

    is_rw = name.isin("read", "write", "pread64", "pwrite64")
    path = F.get(F.filter(F.transform(args, lambda a: F.trim(a, F.lit('"'))), lambda a: a.rlike("[/.]")), F.lit(0))
    fork = name.isin("clone", "clone3", "fork", "vfork") & (ret > 0)
    mapped = name == "mmap"
    fd = F.when(is_rw | name.isin("fsync", "fdatasync"), integer(arg(0))).when(mapped, integer(arg(4)))
    length = F.when(is_rw, integer(arg(2))).when(mapped | (name == "msync"), integer(arg(1)))
    offset = F.when(name.isin("pread64", "pwrite64"), integer(arg(3))).when(mapped, integer(arg(5)))
    hint = F.when(mapped & (arg(0) == "NULL"), 0).when(mapped | (name == "msync"), integer(arg(0)))
    return rows.select(
        *[x for x in lines.columns if x != "value"],
        F.coalesce(number(g[0]), F.lit(default_pid)).alias("pid"),
        seconds_to_ns(g[1]).alias("ts_ns"),
        name.alias("syscall"),
        ret.alias("return_value"),
        fd.alias("fd"),
        length.alias("length"),
        offset.alias("offset"),
        hint.alias("address"),
        F.when(name.isin("open", "openat"), path).alias("filename"),
        F.when(fork, ret).alias("child_pid"),
    )


def proc_maps(lines: DataFrame) -> DataFrame:
    """Memory mappings, ``start-end perms offset device inode path``; addresses above 2^63 do not occur in user space."""

    def cut(w: Column) -> Column:
        span = F.split(w[0], "-")
        hexes = F.array(F.get(span, F.lit(0)), F.get(span, F.lit(1)), F.get(w, F.lit(2)))
        fits = F.forall(hexes, lambda x: F.coalesce(x.rlike("^[0-9a-f]+$"), F.lit(False))) & digits(F.get(w, F.lit(4)))
        return F.when(fits, F.concat(hexes, F.array(w[1], w[3], w[4], F.coalesce(F.get(w, F.lit(5)), F.lit("")))))

    rows = matched(lines, _g=let(F.split(F.trim("value"), r"\s+", 6), cut))
    g = F.col("_g")

    def hexed(i: int) -> Column:
        return F.conv(g[i], 16, 10).cast("bigint")

    return rows.select(
        *[x for x in lines.columns if x != "value"],
        hexed(0).alias("start_addr"),
        hexed(1).alias("end_addr"),
        g[3].alias("perms"),
        hexed(2).alias("file_offset"),
        g[4].alias("device"),
        number(g[5]).alias("inode"),
        F.trim(g[6]).alias("pathname"),
    )


# Positions in a disk counter line.
DISK_FIELDS = {
    "rd_ios": 3, "rd_sect": 5, "rd_ms": 6, "wr_ios": 7, "wr_sect": 9, "wr_ms": 10, "io_ticks": 12,
}


def disk_counters(lines: DataFrame) -> DataFrame:
    """Counters of each device; lines with fewer than 14 fields are skipped."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("_f", fields).filter(F.size("_f") >= 14)
    return rows.select(
        *[x for x in lines.columns if x != "value"],
        F.col("_f")[2].alias("device"),
        *[number(F.col("_f")[i]).alias(n) for n, i in DISK_FIELDS.items()],
    )


def phase_markers(lines: DataFrame) -> DataFrame:
    """Phase markers with their key=value fields."""
    text = F.trim("value")
    kind = F.regexp_extract(text, r"^(PHASE_START|PROGRESS|PHASE_END)\b", 1)
    pairs = F.str_to_map(F.regexp_replace(text, r"^\S+\s+", ""), F.lit(" "), F.lit("="))
    rows = lines.withColumns({"kind": kind, "_m": pairs}).filter("kind <> ''")
    whole = ("mono_ns", "signal_bytes", "store_bytes", "store_pages", "read_ops", "nodes_per_page", "feat_bytes")
    return rows.select(
        *[x for x in lines.columns if x != "value"],
        "kind",
        *[number(F.col("_m")[k]).alias(k) for k in whole],
        *[number(F.col("_m")[k], "double").alias(k) for k in ("ra_signal", "ra_fetch")],
    )


# Field names of health logs, machine form first, then the readable form.
HEALTH_FIELDS = {
    "temperature": ("temperature",),
    "avail_spare": ("avail_spare", "Available Spare"),
    "spare_thresh": ("spare_thresh", "Available Spare Threshold"),
    "percent_used": ("percent_used", "Percentage Used"),
    "data_units_read": ("data_units_read", "Data Units Read"),
    "data_units_written": ("data_units_written", "Data Units Written"),
    "host_reads": ("host_read_commands",),
    "host_writes": ("host_write_commands",),
    "power_cycles": ("power_cycles", "Power Cycles"),
    "power_on_hours": ("power_on_hours", "Power On Hours"),
    "unsafe_shutdowns": ("unsafe_shutdowns",),
    "media_errors": ("media_errors",),
    "num_err_log_entries": ("num_err_log_entries",),
}

_HEALTH_JSON = ", ".join(f"{forms[0]} double" for forms in HEALTH_FIELDS.values())


def health_logs(logs: DataFrame) -> DataFrame:
    """One row per log, from JSON (with any preamble) or from the text form."""
    body = F.regexp_extract("value", r"(?s)(\{.*\})", 1)
    doc = F.from_json(body, _HEALTH_JSON)

    def from_text(names: tuple[str, ...]) -> Column:
        found = [F.regexp_extract("value", rf"(?i){n}\"?\s*:\s*([\d.,]+)", 1) for n in names]
        return F.coalesce(*[number(F.replace(x, F.lit(","), F.lit("")), "double") for x in found])

    rows = logs.withColumn("_d", F.when(body != "", doc))
    code = F.regexp_extract("value", r"(?i)critical_warning\W+(0x[0-9a-f]+|\d+)", 1)
    return rows.select(
        *[x for x in logs.columns if x != "value"],
        integer(F.lower(code)).alias("critical_warning"),
        *[F.coalesce(F.col(f"_d.{forms[0]}"), from_text(forms)).alias(n) for n, forms in HEALTH_FIELDS.items()],
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or compressed text files."""
    return spark.read.text(path)


def read_block_trace(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    events = block_trace(read_lines(spark, path), tolerant)
    return events.filter("parsed").drop("parsed")
