"""Bucketed series, address heat, sweep lines and run detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from iotrail.functions.scalar import ceil_div, int_div, time_bucket
from iotrail.operators.scan import Clamped, Following, RunningSum, Scan


def bucket_count(duration: int, width: int) -> int:
    return max(1, -(-duration // width))


def spine(spark: SparkSession, buckets: int, name: str = "bucket") -> DataFrame:
    return spark.range(buckets).select(F.col("id").alias(name))


def bucketed(
    df: DataFrame, ts: str, start: int, duration: int, width: int, by: Sequence[str] = (), **aggs: Column
) -> DataFrame:
    """Aggregates per time bucket; only buckets that hold rows."""
    at = time_bucket(F.col(ts), start, width, bucket_count(duration, width))
    return df.groupBy(*by, at.alias("bucket")).agg(*[c.alias(n) for n, c in aggs.items()])


def dense(series: DataFrame, buckets: int, fill: dict[str, float], name: str = "bucket") -> DataFrame:
    """Add the buckets without rows, with the ``fill`` values."""
    full = spine(series.sparkSession, buckets, name).join(series, name, "left")
    return full.fillna(fill)


def queue_depth(
    blk: DataFrame,
    keys: Sequence[str] = (),
    order: Sequence[str] = ("ts_ns", "delta", "is_read", "cpu", "seq"),
) -> DataFrame:
    """Dispatched and not completed requests after each D or C event.

    Completions precede dispatches, and writes precede reads, at the same time.
    """
    action = F.col("action")
    events = blk.filter(action.isin("D", "C")).withColumns(
        {
            "delta": F.when(action == "D", 1).otherwise(-1),
            "is_read": F.col("rwbs").contains("R"),
        }
    )
    delta, reads = F.col("delta"), F.col("is_read")
    scan = Scan(events.select(*dict.fromkeys([*keys, *order])), keys, order).add(
        Clamped("qd", delta),
        Clamped("qd_read", F.when(reads, delta).otherwise(0)),
        Clamped("qd_write", F.when(reads, 0).otherwise(delta)),
    )
    return scan.df


def inflight(
    spans: DataFrame, begin: str, end: str, keys: Sequence[str] = (), ends_first: bool = True
) -> DataFrame:
    """Open spans after each begin and end; the rows of one instant are summed up first."""
    marks = F.array(
        F.struct(F.col(begin).alias("ts"), F.lit(1).alias("delta")),
        F.struct(F.col(end).alias("ts"), F.lit(-1).alias("delta")),
    )
    steps = spans.select(*keys, F.explode(marks).alias("m")).select(*keys, "m.*")
    side = F.when(F.col("delta") == (-1 if ends_first else 1), 0).otherwise(1)
    merged = steps.groupBy(*keys, "ts", side.alias("side")).agg(F.sum("delta").alias("delta"))
    scan = Scan(merged, keys, ["ts", "side"], chunked=True)
    return scan.add(RunningSum("open", F.col("delta"))).df


def time_weighted(levels: DataFrame, ts: str, level: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean level over time, its maximum, and the share of time at a level of at most 1."""
    scan = Scan(levels, keys, [ts, "side"], chunked=True).add(Following("_until", F.col(ts)))
    rows = scan.df.withColumn("_dt", F.coalesce(F.col("_until") - F.col(ts), F.lit(0)))
    span = F.sum("_dt")
    return rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(level) * F.col("_dt")), span).alias("mean_level"),
        F.max(level).alias("max_level"),
        F.try_divide(F.sum(F.when(F.col(level) <= 1, F.col("_dt")).otherwise(0)), span).alias(
            "share_le1"
        ),
        span.alias("span_ns"),
    )


def runs(df: DataFrame, keys: Sequence[str], index: str, chunked: bool | None = None) -> DataFrame:
    """Number the runs of consecutive integers of ``index`` (distinct within keys)."""
    scan = Scan(df, keys, [index], chunked).add(RunningSum("_rank", F.lit(1)))
    return scan.df.withColumn("run", F.col(index) - F.col("_rank")).drop("_rank")


def zero_filled(
    series: DataFrame, bucket: str, value: str, keys: Sequence[str] = (), chunked: bool | None = True
) -> DataFrame:
    """Add a zero right after each bucket that is not followed by its neighbour."""
    scan = Scan(series.select(*keys, bucket, value), keys, [bucket], chunked)
    rows = scan.add(Following("_next", F.col(bucket))).df
    gap = F.col("_next").isNull() | (F.col("_next") > F.col(bucket) + 1)
    here = F.struct(F.col(bucket).alias("b"), F.col(value).alias("v"))
    zero = F.struct((F.col(bucket) + 1).alias("b"), F.lit(0).cast(series.schema[value].dataType).alias("v"))
    points = F.when(gap, F.array(here, zero)).otherwise(F.array(here))
    out = rows.select(*keys, F.explode(points).alias("p"))
    return out.select(*keys, F.col("p.b").alias(bucket), F.col("p.v").alias(value))


def extent_bins(req: DataFrame, bins: int, block_bytes: int, limit: float) -> DataFrame:
    """Spread each request over the address bins it overlaps.

    ``limit`` is the end of the binned range; what lies beyond goes to the last
    bin if the request starts there, and is reported as ``lost`` otherwise.
    Returns one row per request and bin with the bytes that fall into it.
    """
    width = limit / bins
    start, end = F.col("sector"), F.col("sector") + F.col("nblocks")

    def clip(at: Column) -> Column:
        return F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("long")

    first = clip(F.floor(start / width))
    last = clip(F.ceil(end / width) - 1)
    placed = req.withColumns({"_first": first, "_last": last})
    placed = placed.withColumn("bin", F.explode(F.sequence("_first", "_last")))
    at = F.col("bin")
    upper, lower = (at + 1) * width, at * width
    overlap = F.least(end.cast("double"), upper) - F.greatest(start.cast("double"), lower)
    single = F.col("_first") == F.col("_last")
    size = F.when(single, F.col("nblocks").cast("double")).otherwise(overlap) * block_bytes
    kept = placed.withColumn("bin_bytes", size).filter(single | (overlap > 0))
    return kept.drop("_first", "_last")


def robust_limit(req: DataFrame) -> float:
    """End of the binned address range: the largest end within 8 times the median."""
    from iotrail.functions.stats import quantiles

    ends = req.select((F.col("sector") + F.col("nblocks")).alias("end"))
    median = quantiles(ends, [], "end", {"p50": 0.5}).first()["p50"]
    capped = F.max(F.when(F.col("end") <= median * 8, F.col("end")))
    inner, outer = ends.agg(capped, F.max("end")).first()
    return float(inner if inner and inner > 0 else outer)


def top_ranked(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of ``order`` (which must end in a key), with their rank."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


__all__ = [
    "bucket_count", "bucketed", "ceil_div", "dense", "extent_bins", "inflight", "int_div",
    "queue_depth", "robust_limit", "runs", "spine", "time_weighted", "top_ranked", "zero_filled",
]
