"""Device counters, benchmark jobs, command mixes and health logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotrail.functions.scalar import celsius, int_div, units_gib
from iotrail.operators.scan import Following, Previous, RunningMax, RunningSum, Scan
from iotrail.session import pin

COUNTERS = ("rd_ios", "rd_sect", "rd_ms", "wr_ios", "wr_sect", "wr_ms", "io_ticks")


def counter_rates(snapshots: DataFrame, order: Sequence[str] = ("ts_ns",)) -> DataFrame:
    """Rates between consecutive snapshots of each device; no I/O gives latency 0."""
    last = F.struct("ts_ns", *COUNTERS)
    rows = Scan(snapshots, ["device"], order).add(Previous("_p", last)).df.filter("_p IS NOT NULL")
    dt = (F.col("ts_ns") - F.col("_p.ts_ns")) / 1e9
    rows = rows.withColumns({"_dt": dt, **{f"_d_{c}": F.col(c) - F.col(f"_p.{c}") for c in COUNTERS}})

    def latency(way: str) -> Column:
        per = F.try_divide(F.col(f"_d_{way}_ms"), F.col(f"_d_{way}_ios"))
        return F.when(F.col(f"_d_{way}_ios") > 0, per).otherwise(0.0)

    busy = F.try_divide(F.col("_d_io_ticks") * 100, F.col("_dt") * 1000)
    return rows.select(
        "device",
        "ts_ns",
        *[F.try_divide(F.col(f"_d_{w}_ios"), F.col("_dt")).alias(f"{w}_iops") for w in ("rd", "wr")],
        *[
            F.try_divide(F.col(f"_d_{w}_sect") * 512, F.col("_dt") * 1048576).alias(f"{w}_mbs")
            for w in ("rd", "wr")
        ],
        *[latency(w).alias(f"{w}_lat_ms") for w in ("rd", "wr")],
        F.least(F.lit(100.0), F.coalesce(busy, F.lit(0.0))).alias("util_pct"),
    )


def live_summary(rates: DataFrame) -> DataFrame:
    """Peaks, means and the read share of the bandwidth per device."""
    rd, wr = F.sum("rd_mbs"), F.sum("wr_mbs")
    share = F.coalesce(F.try_divide(rd * 100, rd + wr), F.lit(50.0))
    return rates.groupBy("device").agg(
        *[F.max(c).alias(f"peak_{c}") for c in ("rd_iops", "wr_iops", "rd_mbs", "wr_mbs", "util_pct")],
        *[F.avg(c).alias(f"avg_{c}") for c in ("rd_lat_ms", "wr_lat_ms")],
        share.alias("read_share_pct"),
    )


def rolling(
    series: DataFrame, key: str, order: Sequence[str], value: str, window: int, stretch: int = 100_000
) -> DataFrame:
    """Mean, maximum and minimum over the last ``window`` samples of a device.

    The samples of a device are numbered and cut into stretches. The last
    samples of a stretch are repeated at the head of the next one, so that each
    stretch is a window partition of its own and no task holds a whole series.
    """
    numbered = Scan(series, [key], order).add(RunningSum("_rn", F.lit(1))).df
    number = F.col("_rn") - 1
    home = F.floor(number / stretch)
    tail = number % stretch >= stretch - (window - 1)
    places = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    rows = numbered.withColumns({"_home": home, "_at": F.explode(places)})
    near = Window.partitionBy(key, "_at").orderBy("_rn").rowsBetween(-(window - 1), 0)
    fns = {"mean": F.avg, "max": F.max, "min": F.min}
    out = rows.select("*", *[f(value).over(near).alias(f"roll_{n}") for n, f in fns.items()])
    return out.filter(F.col("_at") == F.col("_home")).drop("_rn", "_home", "_at")


def rolling_share(series: DataFrame, key: str, order: Sequence[str], value: str, share: int = 20) -> DataFrame:
    """Mean, maximum and minimum over the last ``max(1, n // share)`` samples of a device with ``n`` samples.

    The window is known only after counting, and may be long, so no row carries a
    frame: a device's samples are cut into blocks of the window's length, and a
    window is the end of one block and the beginning of the next. Running values
    from both sides of every block therefore give each window by one join. Null
    values count for nothing; sums never span more than one window.
    """
    counted = Scan(series, [key], order).add(RunningSum("_rn", F.lit(1))).df
    sizes = counted.groupBy(F.col(key).alias("_key")).agg(F.max("_rn").alias("_n"))
    rows = counted.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    window, at = F.greatest(int_div(F.col("_n"), share), F.lit(1)), F.col("_rn") - 1
    rows = rows.withColumns({"_w": window, "_at": at}).withColumns({"_block": int_div(F.col("_at"), F.col("_w")), "_back": -F.col("_at")})
    rows = pin(rows.drop("_rn", "_n"))

    def running(side: str, along: str) -> DataFrame:
        held = F.col(value)
        return (
            Scan(rows, [key, "_block"], [along])
            .add(
                RunningSum(f"{side}_sum", held),
                RunningSum(f"{side}_n", held.isNotNull().cast("long")),
                RunningMax(f"{side}_max", held),
                RunningMax(f"{side}_min", -held),
            )
            .df
        )

    parts = ("sum", "n", "max", "min")
    # A window that is a whole block needs nothing of the one before.
    tails = running("_t", "_back").filter("_at % _w <> 0")
    tails = tails.select(F.col(key).alias("_key"), (F.col("_at") + F.col("_w") - 1).alias("_for"), *[f"_t_{p}" for p in parts])
    out = running("_h", "_at").join(tails, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_for")), "left")
    total, n = [F.col(f"_h_{p}") + F.coalesce(F.col(f"_t_{p}"), F.lit(0)) for p in ("sum", "n")]
    results = {
        "window": F.col("_w"),
        "roll_mean": F.try_divide(total, n),
        "roll_max": F.greatest("_h_max", "_t_max"),
        "roll_min": -F.greatest("_h_min", "_t_min"),
    }
    return out.select(*series.columns, *[c.alias(name) for name, c in results.items()])


def decimated(series: DataFrame, keys: Sequence[str], order: Sequence[str], step: int) -> DataFrame:
    """Every ``step``-th point of each series, and its last one."""
    scan = Scan(series, keys, order).add(RunningSum("_n", F.lit(1)), Following("_more", F.lit(True)))
    return scan.df.filter(((F.col("_n") - 1) % step == 0) | F.col("_more").isNull()).drop("_n", "_more")


def halved_runs(count: int, most: int) -> tuple[int, list[tuple[int, int, int]]]:
    """What is left of points 1 to ``count`` if a list that fills up to ``most`` drops every other point and takes half as many from then on.

    Returns the last stride and the points as (first, step, how many) runs in
    order, at most one per halving: the runs follow from the count alone.
    """
    stride, last, held, runs = 1, 0, 0, []
    while True:
        first = (last // stride + 1) * stride
        more = min(most - held, (count - first) // stride + 1) if first <= count else 0
        if more > 0:
            runs.append((first, stride, more))
            held, last = held + more, first + (more - 1) * stride
        if held < most:
            return stride, runs
        halved, place = [], 0
        for begin, step, n in runs:
            skip = place % 2
            if n > skip:
                halved.append((begin + skip * step, 2 * step, (n - skip + 1) // 2))
            place += n
        runs, held, stride = halved, (most + 1) // 2, 2 * stride


def thinned(series: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` points of a series of any length, and its last one, with the ``stride`` that was reached.

    The points are those that a list of bounded size keeps which halves itself and
    doubles its stride when full. Which ones they are follows from the number of
    points, so the result is the same for any partitioning, and the series is
    numbered, not replayed.
    """
    if most < 2:
        raise ValueError("a list that halves itself holds at least two points")
    numbered = Scan(series, [], order).add(RunningSum("_n", F.lit(1))).df
    count = series.count()
    stride, runs = halved_runs(count, most)
    kept = F.col("_n") == count
    for first, step, n in runs:
        kept = kept | (F.col("_n").between(first, first + (n - 1) * step) & ((F.col("_n") - first) % step == 0))
    return numbered.filter(kept).select(*series.columns, F.col("_n").alias("point"), F.lit(stride).cast("long").alias("stride"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """Benchmark jobs by direction: rates and latencies; directions without I/O are dropped."""
    sides = F.array(
        *[F.struct(F.lit(rw).alias("rw"), F.col(rw).alias("d")) for rw in ("read", "write")]
    )
    rows = jobs.select("jobname", "iodepth", "bs", F.explode(sides).alias("s"))
    rows = rows.select("jobname", "iodepth", "bs", "s.rw", "s.d.*").filter("io_bytes > 0")
    ms = 1e-6

    def point(key: str) -> Column:
        return F.coalesce(F.col("lat_ns.percentile")[key], F.lit(0)) * ms

    return rows.select(
        F.col("jobname").alias("job"),
        "rw",
        "bs",
        F.col("iodepth").alias("qd"),
        "iops",
        (F.col("bw") / 1024).alias("bw_mbs"),
        (F.col("lat_ns.mean") * ms).alias("lat_mean_ms"),
        point("50.000000").alias("lat_p50_ms"),
        point("90.000000").alias("lat_p90_ms"),
        point("99.000000").alias("lat_p99_ms"),
        point("99.900000").alias("lat_p999_ms"),
        (F.col("lat_ns.min") * ms).alias("lat_min_ms"),
        (F.col("lat_ns.max") * ms).alias("lat_max_ms"),
        (F.col("io_bytes") / 2**30).alias("io_gib"),
    )


def job_percentiles(jobs: DataFrame) -> DataFrame:
    """One row per job, direction and latency percentile, in ms."""
    sides = F.array(
        *[F.struct(F.lit(rw).alias("rw"), F.col(f"{rw}.lat_ns.percentile").alias("p")) for rw in ("read", "write")]
    )
    rows = jobs.select("jobname", F.explode(sides).alias("s"))
    points = rows.select("jobname", "s.rw", F.explode("s.p").alias("point", "ns"))
    return points.select(
        F.col("jobname").alias("job"), "rw", F.col("point").cast("double").alias("point"), (F.col("ns") * 1e-6).alias("ms")
    )


def command_mix(pairs: DataFrame) -> DataFrame:
    """Commands by operation and completion status."""
    return pairs.groupBy("op", "status").agg(F.count(F.lit(1)).alias("n"))


def health_summary(logs: DataFrame) -> DataFrame:
    """Latest log of each device with temperature in °C and traffic in GiB."""
    latest = logs.groupBy("device").agg(F.max_by(F.struct(*logs.columns), "ts_ns").alias("l"))
    rows = latest.select("l.*")
    return rows.withColumns(
        {
            "celsius": celsius(F.col("temperature")),
            "read_gib": units_gib(F.col("data_units_read")),
            "written_gib": units_gib(F.col("data_units_written")),
        }
    )
