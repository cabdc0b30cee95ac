"""Quantiles and distribution distances that never gather a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import closed_bin, floor_log2
from iotrail.operators.scan import RunningSum, Scan


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    points: dict[str, float],
    nearest: bool = False,
) -> DataFrame:
    """Exact quantiles of ``value`` per group, one column per point, plus ``n``.

    Equal values are counted first; a two-level scan over the counts then gives
    the rank range of each value. No task holds a whole group. ``nearest`` takes
    the element at min(n-1, floor(q*n)); otherwise the two neighbours of q*(n-1)
    are interpolated.
    """
    groups = list(groups)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value)
    counts = counts.agg(F.count(F.lit(1)).alias("_n"))
    scan = Scan(counts, groups, [value], chunked=True)
    sizes = scan.df.groupBy(*groups).agg(F.sum("_n").alias("n"))
    ranked = scan.add(RunningSum("_hi", F.col("_n"))).df
    rows = _with_group(ranked, sizes, groups).withColumn("_lo", F.col("_hi") - F.col("_n"))
    n = F.col("n")

    def at(rank: Column) -> Column:
        inside = (F.col("_lo") <= rank) & (rank < F.col("_hi"))
        return F.max(F.when(inside, F.col(value)))

    columns = []
    for name, q in points.items():
        if nearest:
            rank = F.least(n - 1, F.floor(F.lit(float(q)) * n))
            columns.append(at(rank).alias(name))
        else:
            pos = F.lit(float(q)) * (n - 1)
            low, high = at(F.floor(pos)), at(F.ceil(pos))
            part = F.max(pos - F.floor(pos))
            columns.append((low + (high - low) * part).alias(name))
    return rows.groupBy(*groups).agg(F.max("n").alias("n"), *columns)


def _with_group(rows: DataFrame, sizes: DataFrame, groups: list[str]) -> DataFrame:
    if groups:
        return rows.join(sizes, groups)
    n = sizes.first()[0]
    return rows.withColumn("n", F.lit(n).cast("long"))


def cdf(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Empirical distribution: for each distinct value the share of rows up to it."""
    groups = list(groups)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value)
    counts = counts.agg(F.count(F.lit(1)).alias("n_here"))
    scan = Scan(counts, groups, [value], chunked=True)
    sizes = scan.df.groupBy(*groups).agg(F.sum("n_here").alias("n"))
    ranked = scan.add(RunningSum("n_upto", F.col("n_here"))).df
    return _with_group(ranked, sizes, groups).withColumn("share", F.col("n_upto") / F.col("n"))


def histogram(
    df: DataFrame, value: Column, low: float, high: float, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Counts in equal bins over [low, high]; values above are put in the last bin."""
    at = closed_bin(F.least(value, F.lit(float(high))), float(low), float(high), bins)
    counts = df.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts


def ks_distance(df: DataFrame, by: Sequence[str], arm: str, value: str, arms: tuple) -> DataFrame:
    """Largest gap between the two arms' distribution functions; 1 if one is empty."""
    by = list(by)
    a, b = (F.count(F.when(F.col(arm) == x, 1)) for x in arms)
    counts = df.groupBy(*by, value).agg(a.alias("_a"), b.alias("_b"))
    scan = Scan(counts, by, [value], chunked=True)
    sizes = scan.df.groupBy(*by).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    rows = scan.add(RunningSum("_ca", F.col("_a")), RunningSum("_cb", F.col("_b"))).df
    if by:
        rows = rows.join(sizes, by)
    else:
        na, nb = sizes.first() or (0, 0)
        rows = rows.withColumns({"_na": F.lit(na or 0), "_nb": F.lit(nb or 0)})
    gap = F.abs(F.col("_ca") / F.col("_na") - F.col("_cb") / F.col("_nb"))
    safe = F.when((F.col("_na") > 0) & (F.col("_nb") > 0), gap).otherwise(1.0)
    return rows.groupBy(*by).agg(F.max(safe).alias("ks"))


def js_divergence(
    df: DataFrame, by: Sequence[str], arm: str, value: str, arms: tuple, bins: int = 100
) -> DataFrame:
    """Jensen-Shannon divergence over equal bins of the range both arms share.

    ``by`` must have few distinct values (metric names): the ranges are joined
    back per group. An empty arm gives 0.693, a single value gives 0.
    """
    by = list(by)
    ends = df.groupBy(*by).agg(
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
        F.count(F.when(F.col(arm) == arms[0], 1)).alias("_na"),
        F.count(F.when(F.col(arm) == arms[1], 1)).alias("_nb"),
    )
    if by:
        rows = df.join(ends, by)
    else:
        lo, hi, na, nb = ends.first()
        rows = df.withColumns(
            {"_lo": F.lit(lo), "_hi": F.lit(hi), "_na": F.lit(na), "_nb": F.lit(nb)}
        )
    span = F.col("_hi") - F.col("_lo")
    spot = F.least(F.floor((F.col(value) - F.col("_lo")) / span * bins), F.lit(bins - 1))
    at = F.when(span == 0, 0).otherwise(spot)
    shares = (
        rows.withColumn("_bin", at)
        .groupBy(*by, "_bin")
        .agg(
            F.max("_na").alias("_na"),
            F.max("_nb").alias("_nb"),
            F.count(F.when(F.col(arm) == arms[0], 1)).alias("_a"),
            F.count(F.when(F.col(arm) == arms[1], 1)).alias("_b"),
            F.max(span).alias("_span"),
        )
    )
    p = F.col("_a") / F.greatest(F.col("_na"), F.lit(1))
    q = F.col("_b") / F.greatest(F.col("_nb"), F.lit(1))
    m, eps = (p + q) / 2, 1e-12
    term = p * F.log((p + eps) / (m + eps)) + q * F.log((q + eps) / (m + eps))
    empty = (F.min("_na") == 0) | (F.min("_nb") == 0)
    result = F.when(empty, 0.693).when(F.max("_span") == 0, 0.0).otherwise(F.sum(term) / 2)
    return shares.groupBy(*by).agg(result.alias("jsd"))


def log2_variation(df: DataFrame, by: Sequence[str], measured: str, projected: str) -> DataFrame:
    """Total variation between two columns' log2 histograms, per group."""
    by = list(by)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col(measured).alias("v")),
        F.struct(F.lit(1).alias("side"), F.col(projected).alias("v")),
    )
    long = df.select(*by, F.explode(sides).alias("s")).select(*by, "s.side", "s.v")
    return log2_variation_long(long.filter("v IS NOT NULL"), by, "side", "v", (0, 1))


def log2_variation_long(
    df: DataFrame, by: Sequence[str], arm: str, value: str, arms: tuple
) -> DataFrame:
    by = list(by)
    spot = F.when(F.col(value) < 1, -1).otherwise(floor_log2(F.col(value)))
    counts = df.groupBy(*by, spot.alias("_bin")).agg(
        F.count(F.when(F.col(arm) == arms[0], 1)).alias("_a"),
        F.count(F.when(F.col(arm) == arms[1], 1)).alias("_b"),
    )
    sizes = counts.groupBy(*by).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    if by:
        counts = counts.join(sizes, by)
    else:
        na, nb = sizes.first()
        counts = counts.withColumns({"_na": F.lit(na or 0), "_nb": F.lit(nb or 0)})
    both = (F.col("_na") > 0) & (F.col("_nb") > 0)
    gap = F.abs(F.try_divide("_a", "_na") - F.try_divide("_b", "_nb"))
    return counts.groupBy(*by).agg(
        (F.when(F.max(both), F.sum(gap) / 2).otherwise(1.0)).alias("tv")
    )


def pearson(a: Column, b: Column) -> Column:
    """Correlation aggregate: 0 below two rows; 1 or 0 if a side is constant."""
    constant = (F.stddev_pop(a) == 0) | (F.stddev_pop(b) == 0)
    same = F.when(F.max(F.abs(a - b)) == 0, 1.0).otherwise(0.0)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return (
        F.when(F.count(a) < 2, 0.0)
        .when(constant, same)
        .otherwise(F.try_divide(F.covar_pop(a, b), spread))
    )


def smape(a: Column, b: Column) -> Column:
    """Symmetric relative error aggregate; 0 where nothing can be compared."""
    size = F.abs(a) + F.abs(b)
    each = F.when(size > 0, F.try_divide(F.abs(a - b) * 2, size))
    return F.coalesce(F.avg(each), F.lit(0.0))


def wape(measured: Column, projected: Column) -> Column:
    miss = F.sum(F.abs(measured - projected))
    return F.coalesce(F.try_divide(miss, F.sum(measured)), F.lit(0.0))
