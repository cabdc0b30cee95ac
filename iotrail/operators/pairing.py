"""Pairing of start and end events with ordered scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.operators.scan import ClampedBefore, Following, Previous, RunningSum, Scan

US = 1000.0


def lifecycles(
    blk: DataFrame,
    keys: Sequence[str] = ("major", "minor", "sector", "nblocks"),
    order: Sequence[str] = ("ts_ns", "cpu", "seq"),
    chunked: bool | None = None,
) -> DataFrame:
    """Queue, dispatch and complete times of each block request.

    Per key the open requests form a FIFO: Q adds one; D stamps the oldest one
    (again, if it was stamped before) or adds one if there is none; C takes the
    oldest one. The number of open requests is a clamped counter; numbering the
    additions and the removals then tells which request an event belongs to.
    """
    keys, order = list(keys), list(order)
    action = F.col("action")
    used = blk.filter(action.isin("Q", "D", "C"))
    slim = used.select(*dict.fromkeys([*keys, *order, "action", "rwbs", "ts_ns"]))
    step = F.when(action == "Q", 1).when(action == "C", -1).otherwise(0)
    floor = F.when(action == "C", 0).otherwise(1)
    scan = Scan(slim, keys, order, chunked).add(ClampedBefore("_before", step, floor))
    before = F.col("_before")
    pushes = (action == "Q") | ((action == "D") & (before == 0))
    pops = (action == "C") & (before > 0)
    scan.add(
        RunningSum("_pushed", F.when(pushes, 1).otherwise(0)),
        RunningSum("_popped", F.when(pops, 1).otherwise(0)),
    )
    item = (
        F.when(action == "Q", F.col("_pushed"))
        .when(action == "D", F.col("_popped") + 1)
        .when(before > 0, F.col("_popped"))
    )

    def at(letter: str) -> Column:
        return F.max(F.when(action == letter, F.col("ts_ns")))

    events = scan.df.withColumn("_item", item).withColumn("_push", pushes)
    events = events.filter("_item IS NOT NULL")
    done = events.groupBy(*keys, "_item").agg(
        at("Q").alias("queue_ns"),
        at("D").alias("issue_ns"),
        at("C").alias("complete_ns"),
        F.max(F.when(F.col("_push"), F.col("rwbs"))).alias("rwbs"),
    )
    q, d, c = F.col("queue_ns"), F.col("issue_ns"), F.col("complete_ns")
    return done.filter(c.isNotNull()).select(
        *keys,
        F.col("_item").alias("item"),
        F.col("rwbs").contains("R").alias("is_read"),
        q,
        d,
        c,
        ((c - q) / US).alias("q2c_us"),
        ((c - d) / US).alias("d2c_us"),
        ((d - q) / US).alias("q2d_us"),
    )


def latency_long(life: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per positive latency: the columns to keep, kind (q2c, d2c, q2d), direction and value."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_us").alias("us")) for k in ("q2c", "d2c", "q2d")]
    )
    rows = life.select(*keep, "is_read", F.explode(pairs).alias("p")).select(*keep, "is_read", "p.*")
    return rows.filter("us > 0")


def consuming_pairs(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts: Column,
    carry: Sequence[str],
    prefix: str = "start_",
    chunked: bool | None = None,
) -> DataFrame:
    """Each end event with the start that directly precedes it under its key.

    A later start under the same key replaces an unanswered one, and a start is
    used once, so an end pairs exactly if the event before it is a start. The
    result holds the end rows with the ``carry`` columns of their start.
    """
    opening = F.struct(starts.alias("_is"), *[F.col(c) for c in carry])
    scan = Scan(events.filter(starts.isNotNull()), keys, order, chunked)
    rows = scan.add(Previous("_start", opening)).df
    paired = rows.filter(~starts & F.coalesce(F.col("_start._is"), F.lit(False)))
    return paired.withColumns({f"{prefix}{c}": F.col(f"_start.{c}") for c in carry}).drop("_start")


def sequence_then_address(
    blk: DataFrame,
    order: Sequence[str] = ("ts_ns", "cpu", "seq"),
    seq: str = "seq",
    address: str = "sector",
    chunked: bool | None = None,
) -> DataFrame:
    """Completions paired with queue events by sequence number, else by address.

    A completion matched by number also clears the address its queue event had,
    so the address pass sees three kinds of events: queue events, those clearing
    marks, and the completions that are still open.
    """
    order, action = list(order), F.col("action")
    used = blk.filter(action.isin("Q", "C")).select(
        *dict.fromkeys([*order, seq, address, "action", "rwbs"])
    )
    opening = F.struct((action == "Q").alias("is"), "ts_ns", "rwbs", address)
    rows = Scan(used, [seq], order, chunked).add(Previous("_start", opening)).df
    hit = (action == "C") & F.coalesce(F.col("_start.is"), F.lit(False))
    rows = rows.withColumn("_hit", hit)
    mark = F.when(F.col("_hit"), F.col(f"_start.{address}")).otherwise(F.col(address))
    second = Scan(rows.withColumn("_at", mark), ["_at"], order, chunked)
    opening = F.struct((action == "Q").alias("is"), "ts_ns", "rwbs")
    rows = second.add(Previous("_open", opening)).df.filter(action == "C")
    by_address = ~F.col("_hit") & F.coalesce(F.col("_open.is"), F.lit(False))
    start = F.when(F.col("_hit"), F.struct("_start.ts_ns", "_start.rwbs")).when(
        by_address, F.struct("_open.ts_ns", "_open.rwbs")
    )
    rows = rows.withColumn("_from", start)
    return rows.select(
        *dict.fromkeys([*order, seq, address]),
        F.coalesce(F.col("_from.rwbs"), F.col("rwbs")).alias("rwbs"),
        F.when(F.col("_hit"), "seq").when(by_address, "address").otherwise("none").alias("matched"),
        ((F.col("ts_ns") - F.col("_from.ts_ns")) / 1e6).alias("lat_ms"),
    )


def latest_pairs(
    commands: DataFrame,
    completions: DataFrame,
    key: str,
    ts: str,
    tie: Sequence[str] = (),
    chunked: bool | None = None,
) -> DataFrame:
    """Commands with ``dur_ns``: each completion goes to the latest open command.

    Commands open brackets and completions close them; the bracket level is a
    clamped counter, and inside a level every completion follows the command it
    closes. A completion at the time of a command comes after it.
    """
    tie = list(tie)
    opened = commands.select(
        key, ts, F.lit(0).alias("_side"), *tie, F.struct(*commands.columns).alias("_row")
    )
    closed = completions.select(key, ts, F.lit(1).alias("_side"))
    both = opened.unionByName(closed, allowMissingColumns=True)
    order = [ts, "_side", *tie]
    opens = F.col("_side") == 0
    scan = Scan(both, [key], order, chunked)
    scan.add(ClampedBefore("_was", F.when(opens, 1).otherwise(-1), F.lit(0)))
    level = F.when(opens, F.col("_was") + 1).otherwise(F.col("_was"))
    leveled = scan.df.withColumn("_level", level).filter("_level > 0")
    # A level is part of a key, so it needs no measuring of its own.
    pairs = Scan(leveled, [key, "_level"], order, scan.chunked)
    closing = F.when(F.col("_side") == 1, F.col(ts))
    rows = pairs.add(Following("_closed", closing)).df.filter("_side = 0")
    return rows.select("_row.*", (F.col("_closed") - F.col(ts)).alias("dur_ns"))
