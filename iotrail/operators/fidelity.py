"""How faithful a replay is to its capture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import int_div, is_read, is_write
from iotrail.functions.stats import js_divergence, ks_distance, pearson, smape
from iotrail.operators import series
from iotrail.operators.blocks import count_if
from iotrail.operators.pairing import latency_long, lifecycles
from iotrail.operators.scan import RunningSum, Scan
from iotrail.session import pin

ARMS = (0, 1)
NAMES = ("cap", "rep")


def arm_spans(arms: DataFrame) -> tuple[int, int]:
    """Length of the two arms; both start at zero."""
    ends = {r["arm"]: r["t"] for r in arms.groupBy("arm").agg(F.max("ts_ns").alias("t")).collect()}
    return ends.get(0, 0), ends.get(1, 0)


def _side_by_side(rows: DataFrame, buckets: int, values: list[str]) -> DataFrame:
    """Long rows (arm, bucket, values) to one row per bucket on a full grid, gaps as zero."""
    columns = [
        F.max(F.when(F.col("arm") == a, F.col(v))).alias(f"{n}_{v}")
        for a, n in zip(ARMS, NAMES, strict=True)
        for v in values
    ]
    wide = rows.filter(F.col("bucket") < buckets).groupBy("bucket").agg(*columns)
    return series.dense(wide, buckets, dict.fromkeys(wide.columns[1:], 0.0))


def rate_series(arms: DataFrame, width: int) -> DataFrame:
    """Submission rates of both arms on one grid; the longer arm's rest goes to the last bucket."""
    n = series.bucket_count(min(arm_spans(arms)), width)
    seconds = width / 1e9
    at = F.least(int_div(F.col("ts_ns"), width), F.lit(n - 1).cast("long"))
    reads = is_read(F.col("rwbs"))
    queued = arms.filter("action = 'Q' AND nblocks > 0")
    rows = queued.groupBy("arm", at.alias("bucket")).agg(
        (count_if(reads) / seconds).alias("read_rate"),
        (count_if(~reads & is_write(F.col("rwbs"))) / seconds).alias("write_rate"),
    )
    wide = _side_by_side(rows, n, ["read_rate", "write_rate"])
    cap, rep = (F.col(f"{a}_read_rate") + F.col(f"{a}_write_rate") for a in NAMES)
    return wide.withColumn("residual", cap - rep)


def rate_scores(rates: DataFrame) -> DataFrame:
    cap, rep = (F.col(f"{a}_read_rate") + F.col(f"{a}_write_rate") for a in NAMES)
    return rates.agg(
        pearson(F.col("cap_read_rate"), F.col("rep_read_rate")).alias("q_rate_corr_read"),
        pearson(F.col("cap_write_rate"), F.col("rep_write_rate")).alias("q_rate_corr_write"),
        smape(cap, rep).alias("q_rate_smape"),
    )


def drift(arms: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """Cumulative submissions and bytes of both arms and their differences."""
    n = series.bucket_count(min(arm_spans(arms)), width)
    at = F.least(int_div(F.col("ts_ns"), width), F.lit(n - 1).cast("long"))
    queued = arms.filter("action = 'Q' AND nblocks > 0")
    rows = queued.groupBy("arm", at.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("nblocks") * block_bytes).alias("b")
    )
    wide = _side_by_side(rows, n, ["n", "b"])
    sums = [RunningSum(f"{a}_{k}", F.col(f"{a}_{v}")) for a in NAMES for v, k in (("n", "count"), ("b", "bytes"))]
    out = Scan(wide, [], ["bucket"]).add(*sums).df
    gap = F.col("cap_count") - F.col("rep_count")
    pct = F.when(F.col("cap_count") > 0, F.try_divide(gap * 100, "cap_count")).otherwise(0.0)
    return out.select(
        "bucket",
        "cap_count",
        "rep_count",
        "cap_bytes",
        "rep_bytes",
        gap.alias("count_drift"),
        (F.col("cap_bytes") - F.col("rep_bytes")).alias("bytes_drift"),
        pct.alias("pct_drift"),
    )


def completion_series(arms: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """Throughput (MB/s) and IOPS of both arms, for the buckets both have."""
    spans = arm_spans(arms)
    counts = [series.bucket_count(s, width) for s in spans]
    last = F.when(F.col("arm") == 0, counts[0] - 1).otherwise(counts[1] - 1).cast("long")
    at = F.least(int_div(F.col("ts_ns"), width), last)
    seconds = width / 1e9
    rows = arms.filter("action = 'C'").groupBy("arm", at.alias("bucket")).agg(
        (F.sum(F.col("nblocks") * block_bytes) / seconds / 1048576).alias("mbps"),
        (F.count(F.lit(1)) / seconds).alias("iops"),
    )
    return _side_by_side(rows, min(counts), ["mbps", "iops"])


def depth_series(arms: DataFrame, width: int) -> DataFrame:
    """Mean queue depth of both arms per bucket."""
    counts = [series.bucket_count(s, width) for s in arm_spans(arms)]
    depth = series.queue_depth(arms, ["arm"])
    rows = depth.groupBy("arm", int_div(F.col("ts_ns"), width).alias("bucket")).agg(
        F.avg("qd").alias("qd")
    )
    return _side_by_side(rows, min(counts), ["qd"])


def series_scores(wide: DataFrame, values: list[str]) -> DataFrame:
    columns: list[Column] = []
    for v in values:
        a, b = F.col(f"cap_{v}"), F.col(f"rep_{v}")
        columns += [pearson(a, b).alias(f"{v}_corr"), smape(a, b).alias(f"{v}_smape")]
    return wide.agg(*columns)


def size_distances(arms: DataFrame, block_bytes: int) -> DataFrame:
    """Divergence and largest gap of the size distributions: all, reads, writes."""
    size = (F.col("nblocks") * block_bytes).alias("size")
    reads, writes = is_read(F.col("rwbs")), is_write(F.col("rwbs"))
    classes = F.array_compact(
        F.array(F.lit("all"), F.when(reads, "reads"), F.when(~reads & writes, "writes"))
    )
    rows = pin(arms.filter("action = 'Q' AND nblocks > 0").select("arm", size, F.explode(classes).alias("class")))
    ks = ks_distance(rows, ["class"], "arm", "size", ARMS)
    return ks.join(js_divergence(rows, ["class"], "arm", "size", ARMS), "class")


def latency_distances(arms: DataFrame) -> DataFrame:
    """The same for total and device latency, by direction."""
    life = lifecycles(arms, keys=("arm", "major", "minor", "sector", "nblocks"))
    rows = pin(latency_long(life, ["arm"]).filter("kind IN ('q2c', 'd2c')"))  # read by both distances
    by = ["kind", "is_read"]
    ks = ks_distance(rows, by, "arm", "us", ARMS)
    return ks.join(js_divergence(rows, by, "arm", "us", ARMS), by)


def address_cells(arms: DataFrame, width: int, bins: int, max_time_bins: int = 200) -> DataFrame:
    """Sparse address x time counts of both arms over a shared address range, and their difference."""
    common = min(arm_spans(arms))
    queued = arms.filter("action = 'Q' AND nblocks > 0 AND sector > 0")
    top = queued.agg(F.max("sector")).first()[0]
    nt = max(1, min(max_time_bins, common // width))
    ti = F.least(F.floor(F.col("ts_ns") / common * nt), F.lit(nt - 1)).cast("long")
    si = F.least(F.floor(F.col("sector") / (top + 1) * bins), F.lit(bins - 1)).cast("long")
    cells = queued.groupBy(si.alias("si"), ti.alias("ti")).agg(
        count_if(F.col("arm") == 0).alias("cap"), count_if(F.col("arm") == 1).alias("rep")
    )
    return cells.withColumn("diff", F.col("cap") - F.col("rep"))


def address_profile(cells: DataFrame, bins: int) -> DataFrame:
    sums = cells.groupBy("si").agg(F.sum("cap").alias("cap"), F.sum("rep").alias("rep"))
    full = series.dense(sums, bins, {"cap": 0, "rep": 0}, "si")
    return full.withColumn("diff", F.col("cap") - F.col("rep"))


def metrics(arms: DataFrame, width: int, block_bytes: int, bins: int) -> DataFrame:
    """The whole family as (metric, value) rows; one small row set per part."""
    arms = pin(arms)  # every part reads it
    profile = address_profile(address_cells(arms, width, bins), bins)
    flat = [
        rate_scores(rate_series(arms, width)),
        series_scores(completion_series(arms, width, block_bytes), ["mbps", "iops"]),
        series_scores(depth_series(arms, width), ["qd"]),
        profile.agg(pearson(F.col("cap").cast("double"), F.col("rep").cast("double")).alias("lba_freq_corr")),
    ]
    parts = [_unpivot(df, df.columns) for df in flat]
    sizes = size_distances(arms, block_bytes)
    parts.append(_named(sizes, F.concat(F.lit("size_"), F.col("class"))))
    lat = latency_distances(arms)
    side = F.when(F.col("is_read"), "read").otherwise("write")
    parts.append(_named(lat, F.concat_ws("_", F.lit("lat"), F.col("kind"), side)))
    return reduce(DataFrame.unionByName, parts)


def _unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def _named(df: DataFrame, stem: Column) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.concat(stem, F.lit(f"_{k}")).alias("metric"), F.col(k).alias("value")) for k in ("ks", "jsd")]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def score(values: DataFrame) -> DataFrame:
    """Overall score and grade: mean of correlation, 1 - relative error and 1 - largest gap."""
    name = F.col("metric")
    corr = F.avg(F.when(name.contains("corr"), F.col("value")))
    miss = 1 - F.avg(F.when(name.contains("smape"), F.col("value")))
    gap = 1 - F.avg(F.when(name.contains("_ks"), F.col("value")))
    parts = values.agg(corr.alias("correlation"), miss.alias("one_minus_smape"), gap.alias("one_minus_ks"))
    names = ("correlation", "one_minus_smape", "one_minus_ks")
    known = F.array_compact(F.array(*[F.col(n) for n in names]))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    rows = parts.withColumn("overall", F.try_divide(total, F.size(known)))
    overall = F.col("overall")
    grade = F.when(overall > 0.95, "EXCELLENT").when(overall > 0.90, "GOOD").when(overall > 0.80, "FAIR")
    return rows.withColumn("grade", grade.otherwise("POOR"))
