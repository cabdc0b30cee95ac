"""Block-layer analyses: lifecycles, alignment, address heat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import (
    coarse_bin,
    floor_log2,
    int_div,
    is_read,
    is_write,
    quant_bin,
    unit_metrics,
)
from iotrail.operators.scan import RunningSum, Scan


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def alignment(req: DataFrame, unit: int, granularity: int, atomic: int) -> DataFrame:
    """Per-request columns for indirection unit, write granularity and atomic unit.

    All three are in blocks. ``sub_iu`` and the atomic columns apply to writes.
    """
    sector, n = F.col("sector"), F.col("nblocks")
    iu, npwg, awun = (unit_metrics(sector, n, u) for u in (unit, granularity, atomic))
    write = ~F.col("is_read")
    return req.withColumns(
        {
            "iu_crossings": iu["crossings"],
            "iu_touched": iu["touched"],
            "iu_ideal": iu["ideal"],
            "iu_aligned": iu["aligned"],
            "waf": iu["waf"],
            "sub_iu": write & iu["sub_unit"],
            "npwg_size_aligned": (n % granularity == 0) & (n >= granularity),
            "npwg_start_aligned": sector % granularity == 0,
            "npwg_units": npwg["touched"],
            "awun_crossings": F.when(write, awun["crossings"]).otherwise(0),
            "awun_safe": ~write | (awun["crossings"] == 0),
            "iu_bin": quant_bin(n, unit),
        }
    )


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """One row of counts and shares; a write is whatever is not a read."""
    write, read = ~F.col("is_read"), F.col("is_read")
    misaligned = write & ~F.col("iu_aligned")
    writes = F.greatest(count_if(write), F.lit(1))
    both = F.col("npwg_size_aligned") & F.col("npwg_start_aligned")
    size_only = F.col("npwg_size_aligned") & ~F.col("npwg_start_aligned")
    return aligned.agg(
        count_if(write).alias("writes"),
        count_if(read).alias("reads"),
        count_if(F.col("sub_iu")).alias("sub_iu"),
        (count_if(F.col("sub_iu")) * 100 / writes).alias("sub_iu_pct"),
        count_if(write & F.col("iu_aligned")).alias("aligned_writes"),
        count_if(read & F.col("iu_aligned")).alias("aligned_reads"),
        count_if(write & (F.col("iu_crossings") > 0)).alias("crossing_writes"),
        F.avg(F.when(write, F.col("waf"))).alias("mean_waf"),
        F.max(F.when(write, F.col("waf"))).alias("max_waf"),
        count_if(misaligned).alias("misaligned_writes"),
        F.avg(F.when(misaligned, F.col("waf"))).alias("misaligned_mean_waf"),
        count_if(write & both).alias("npwg_full"),
        count_if(write & size_only).alias("npwg_size_only"),
        count_if(write & ~F.col("npwg_size_aligned")).alias("npwg_unaligned"),
        count_if(write & F.col("awun_safe")).alias("atomic_safe"),
        count_if(write & ~F.col("awun_safe")).alias("atomic_unsafe"),
        F.max("awun_crossings").alias("awun_max_crossings"),
    )


def size_histogram(req: DataFrame, block_bytes: int) -> DataFrame:
    """Requests, MiB and mean size per coarse size bin and direction."""
    size = F.col("nblocks") * block_bytes
    rows = req.withColumns({"size": size, "size_bin": coarse_bin(size)})
    return rows.groupBy("size_bin", "is_read").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("size") / 1048576).alias("mib"),
        F.avg("size").alias("mean_size"),
    )


def log2_histogram(df: DataFrame, value: str, by: str, cap: int = 31) -> DataFrame:
    """Rows and cumulative share per log2 bucket; at most ``cap`` + 1 rows per group.

    ``approx_bytes`` is null where ``n`` times the bucket's size passes 64 bits.
    """
    counts = df.groupBy(by, floor_log2(F.col(value), cap).alias("bucket"))
    counts = counts.agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    upto = Scan(counts, [by], ["bucket"], chunked=False).add(RunningSum("upto", F.col("n"))).df
    shifted = F.pow(F.lit(2), F.col("bucket")).cast("long")
    return upto.join(totals, by).select(
        by,
        "bucket",
        "n",
        F.try_multiply("n", shifted).alias("approx_bytes"),
        (F.col("upto") * 100 / F.col("total")).alias("cumulative_pct"),
    )


def heat_cells(
    events: DataFrame, span_ns: int, max_sector: int, time_bins: int, address_bins: int
) -> DataFrame:
    """Sparse address x time counts: all, read-flagged and write-flagged events."""
    ti = F.least(F.floor(F.col("ts_ns") / span_ns * time_bins), F.lit(time_bins - 1))
    si = F.least(
        F.floor(F.col("sector") / (max_sector + 1) * address_bins), F.lit(address_bins - 1)
    )
    reads = is_read(F.col("rwbs"))
    return events.groupBy(si.cast("long").alias("si"), ti.cast("long").alias("ti")).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(reads).alias("n_read"),
        count_if(~reads & is_write(F.col("rwbs"))).alias("n_write"),
    )


def address_bins(placed: DataFrame) -> DataFrame:
    """Touches and bytes per address bin, from the rows of ``series.extent_bins``."""
    w = F.col("is_write")
    total, write = F.sum("bin_bytes"), F.sum(F.when(w, F.col("bin_bytes")).otherwise(0.0))
    return placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("io_count"),
        total.alias("total_bytes"),
        write.alias("write_bytes"),
        F.sum(F.when(w, 0.0).otherwise(F.col("bin_bytes"))).alias("read_bytes"),
        count_if(w).alias("write_count"),
        count_if(~w).alias("read_count"),
        F.try_divide(write, total).alias("write_fraction"),
    )


def hot_views(bins: DataFrame, k: int) -> DataFrame:
    """Three rankings of address bins: by touches, by bytes, and the hot-by-touch
    bins ranked again by written bytes."""
    from iotrail.operators.series import top_ranked

    by_count = top_ranked(bins, [F.desc("io_count"), F.asc("bin")], k)
    by_bytes = top_ranked(bins, [F.desc("total_bytes"), F.asc("bin")], k)
    both = top_ranked(by_count.drop("rank"), [F.desc("write_bytes"), F.asc("bin")], k)
    views = {"count": by_count, "bytes": by_bytes, "count_by_write_bytes": both}
    out = None
    for name, rows in views.items():
        rows = rows.withColumn("view", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    read_pct = F.col("read_bytes") * 100 / F.greatest(F.col("total_bytes"), F.lit(1.0))
    return out.withColumns({"read_pct": read_pct, "write_pct": F.lit(100.0) - read_pct})


def zones(df: DataFrame, sector: Column, by: str) -> DataFrame:
    at = F.least(int_div(sector, 1_048_576), F.lit(4095).cast("long"))
    return df.groupBy(at.alias("zone"), by).agg(F.count(F.lit(1)).alias("n"))
