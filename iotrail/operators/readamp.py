"""Read amplification from the application's pages down to the device."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import (
    charged_bytes,
    fault_kept,
    fault_major,
    int_div,
    sector_log_bucket,
)
from iotrail.operators.asof import asof_join
from iotrail.operators.blocks import count_if
from iotrail.operators.scan import Previous, RunningMax, RunningSum, Scan
from iotrail.session import pin

PAGE = 4096

# Fault flags.
FAULT_WRITE, FAULT_TRIED, FAULT_USER, FAULT_INSTRUCTION = 0x01, 0x20, 0x40, 0x100
FAULT_RETRY = 0x400


def entered_faults(enters: DataFrame) -> DataFrame:
    """Faults that are followed: from user space, no instruction fetch, no retry."""
    flags = F.col("flags")
    user = flags.bitwiseAND(F.lit(FAULT_USER)) != 0
    skip = flags.bitwiseAND(F.lit(FAULT_INSTRUCTION | FAULT_TRIED)) != 0
    return enters.filter(user & ~skip).withColumn("write", flags.bitwiseAND(F.lit(FAULT_WRITE)) != 0)


def completed_faults(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Fault exits with the attempt they end.

    Per thread and page the first entry is kept until an exit; ``phase`` is
    enter or exit. Exits with an error end the attempt uncounted.
    """
    enters = entered_faults(events.filter("phase = 'enter'"))
    exits = events.filter("phase = 'exit'").withColumn("write", F.lit(None).cast("boolean"))
    both = enters.unionByName(exits)
    entering = F.col("phase") == "enter"
    keys = ["tid", "page"]
    prev = Scan(both, keys, order).add(Previous("_p", F.col("phase")))
    opens = entering & (F.col("_p").isNull() | (F.col("_p") == "exit"))
    kept = prev.df.filter(opens | ~entering)
    data = F.struct("phase", "dev", "ino", "pgoff", "write")
    rows = Scan(kept, keys, order, prev.chunked).add(Previous("_in", data)).df
    ends = rows.filter((F.col("phase") == "exit") & (F.col("_in.phase") == "enter"))
    good = ends.filter(fault_kept(F.col("flags"), F.col("ret")))
    return good.select(
        "tgid",
        "_in.dev",
        "_in.ino",
        "_in.pgoff",
        "_in.write",
        fault_major(F.col("ret")).alias("major"),
        (F.col("ret").bitwiseAND(F.lit(FAULT_RETRY)) != 0).alias("retried"),
    )


def fault_stats(faults: DataFrame) -> DataFrame:
    n, major = F.count(F.lit(1)), count_if(F.col("major"))
    return faults.groupBy("tgid", "dev", "ino").agg(
        n.alias("faults"),
        major.alias("major"),
        (n - major).alias("minor"),
        count_if(F.col("write")).alias("writes"),
        count_if(F.col("retried")).alias("retries"),
        (n * PAGE).alias("fault_bytes"),
        (major * PAGE).alias("major_bytes"),
    )


def cache_fills(inserts: DataFrame) -> DataFrame:
    pages = F.sum(F.pow(F.lit(2), F.col("order")).cast("long"))
    return inserts.groupBy("dev", "ino").agg(
        pages.alias("fill_pages"), (pages * PAGE).alias("fill_bytes")
    )


def call_intent(calls: DataFrame) -> DataFrame:
    n, b = F.count(F.lit(1)), F.sum("bytes")
    return calls.groupBy("dev", "ino", "is_write").agg(
        n.alias("calls"),
        b.alias("bytes"),
        F.min("bytes").alias("min_bytes"),
        int_div(b, n).alias("avg_bytes"),
        F.max("bytes").alias("max_bytes"),
    )


def direct_io(calls: DataFrame) -> DataFrame:
    done = calls.filter("ret > 0")
    return done.groupBy("dev", "ino").agg(
        F.count(F.lit(1)).alias("dio_calls"),
        F.sum("ret").alias("dio_bytes"),
        F.avg("ret").alias("avg_bytes"),
    )


def device_io(requests: DataFrame, geometry: DataFrame) -> DataFrame:
    """Requests per device and direction with their indirection-unit amplification.

    ``geometry`` has one row per device (``dev``, ``iu``).
    """
    first = F.substring("rwbs", 1, 1)
    rows = requests.filter(first.isin("R", "W")).withColumn("is_write", first == "W")
    rows = rows.join(geometry.select("dev", "iu"), "dev", "left")
    rows = rows.withColumn("_iu", F.when(F.col("iu") > 0, charged_bytes(F.col("sector"), F.col("bytes"), F.col("iu"))))
    ios, b = F.count(F.lit(1)), F.sum("bytes")
    sub = count_if(F.col("bytes") < F.col("iu"))
    return rows.groupBy("dev", "is_write").agg(
        ios.alias("ios"),
        b.alias("bytes"),
        F.min("bytes").alias("min_bytes"),
        int_div(b, ios).alias("avg_bytes"),
        F.max("bytes").alias("max_bytes"),
        (F.coalesce(F.sum("_iu"), F.lit(0)) / b).alias("iu_amplification"),
        (sub * 100 / ios).alias("sub_iu_pct"),
    )


def device_io_histogram(requests: DataFrame) -> DataFrame:
    first = F.substring("rwbs", 1, 1)
    used = requests.filter(first.isin("R", "W"))
    spot = sector_log_bucket(F.col("bytes")).alias("bucket")
    return used.groupBy("dev", (first == "W").alias("is_write"), spot).agg(
        F.count(F.lit(1)).alias("n")
    )


def readahead(calls: DataFrame) -> DataFrame:
    return calls.groupBy("dev", "ino").agg(
        F.sum(F.greatest("nr_pages", F.lit(0))).alias("prepared_pages"),
        F.count(F.lit(1)).alias("ra_calls"),
    )


def footprint(faults: DataFrame, direct: DataFrame, cap_pages: int | None = None) -> DataFrame:
    """Distinct pages per file that faults and direct I/O touch.

    Direct I/O covers [pos, pos + count); ``cap_pages`` limits a single call the
    way an in-kernel collector has to, and is off by default.
    """
    start = F.shiftright("pos", 12)
    end = F.shiftright(F.col("pos") + F.col("count") + (PAGE - 1), 12)
    if cap_pages is not None:
        end = F.least(end, start + cap_pages)
    ranges = direct.select("dev", "ino", start.alias("_s"), end.alias("_e")).filter("_e > _s")
    single = faults.select("dev", "ino", F.col("pgoff").alias("_s"), (F.col("pgoff") + 1).alias("_e"))
    # A range adds the pages behind all earlier ends; ranges don't become pages.
    spans = single.unionByName(ranges).groupBy("dev", "ino", "_s").agg(F.max("_e").alias("_e"))
    reached = Scan(pin(spans), ["dev", "ino"], ["_s"]).add(RunningMax("_reach", F.col("_e"), exclusive=True)).df
    # A page without number is one page.
    fresh = F.when(F.col("_s").isNull(), 1).otherwise(F.greatest(F.col("_e") - F.greatest("_s", "_reach"), F.lit(0)))
    distinct = reached.groupBy("dev", "ino").agg(F.sum(fresh).alias("unique_pages"))
    return distinct.withColumn("footprint_bytes", F.col("unique_pages") * PAGE)


def amplification_ladder(
    faults: DataFrame, fills: DataFrame, pages: DataFrame, prepared: DataFrame, useful: DataFrame
) -> DataFrame:
    """Per file: read bytes over useful bytes and over touched pages, and over-fetch.

    ``useful`` gives (dev, ino, useful_bytes).
    """
    by = ["dev", "ino"]
    demand = faults.groupBy(*by).agg(F.sum("fault_bytes").alias("fault_bytes"))
    rows = fills.join(demand, by, "full").join(pages, by, "full").join(prepared, by, "full")
    rows = rows.join(useful, by, "left").fillna(0, ["fill_bytes", "fault_bytes", "footprint_bytes", "prepared_pages"])
    fill, foot = F.col("fill_bytes"), F.col("footprint_bytes")
    return rows.select(
        *by,
        F.try_divide(fill, F.col("useful_bytes")).alias("ra_signal"),
        F.try_divide(fill, foot).alias("actual_over_footprint"),
        F.try_divide(foot, F.col("useful_bytes")).alias("footprint_over_useful"),
        (fill - F.col("fault_bytes")).alias("overfetch_bytes"),
        (F.col("prepared_pages") * PAGE - F.col("fault_bytes")).alias("prepared_overfetch_bytes"),
    )


def intent_against_device(
    reads: DataFrame, markers: DataFrame, order: Sequence[str]
) -> DataFrame:
    """Running device bytes at each read and the useful bytes interpolated to its time.

    Reads outside the first and last marker are left out. ``markers`` have
    (mono_ns, signal_bytes).
    """
    lo, hi = markers.agg(F.min("mono_ns"), F.max("mono_ns")).first()
    inside = reads.filter(F.col("ts_ns").between(lo, hi))
    scan = Scan(inside, [], ["ts_ns", *order]).add(RunningSum("device_bytes", F.col("bytes")))
    rows = scan.df
    before = asof_join(rows, markers, [], "ts_ns", "mono_ns", {"mono_ns": "m0", "signal_bytes": "s0"}, tie=["signal_bytes"])
    both = asof_join(before, markers, [], "ts_ns", "mono_ns", {"mono_ns": "m1", "signal_bytes": "s1"}, tie=["signal_bytes"], forward=True)
    part = F.try_divide(F.col("ts_ns") - F.col("m0"), F.col("m1") - F.col("m0"))
    rise = (F.col("s1") - F.col("s0")) * F.coalesce(part, F.lit(0.0))
    return both.withColumn("useful_bytes", F.col("s0") + rise).drop("m0", "m1", "s0", "s1")


def running_amplification(markers: DataFrame) -> DataFrame:
    """Device over useful bytes at each progress marker that has useful bytes."""
    ratio = F.try_divide("store_bytes", "signal_bytes")
    return markers.filter("signal_bytes > 0").withColumn("amplification", ratio)
