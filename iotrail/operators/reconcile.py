"""Agreement of two witnesses: tracer against truth, parts against wholes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iotrail.functions.scalar import project_object
from iotrail.functions.stats import quantiles
from iotrail.operators.blocks import count_if
from iotrail.operators.scan import Previous, Scan


def reconcile(
    truth: DataFrame, submitted: DataFrame, completed: DataFrame, order: Sequence[str]
) -> DataFrame:
    """One row per (problem, user_data) between an application's own log and a tracer's.

    Of several traced submissions with one tag the first in ``order`` is compared.
    """
    at = F.struct(*order)
    fields = (
        "offset", "requested_bytes", "requested_bytes_valid", "requested_bytes_lower", "ddir",
    )
    first = submitted.groupBy("user_data").agg(
        F.count(F.lit(1)).alias("n"), *[F.min_by(c, at).alias(f"t_{c}") for c in fields]
    )
    done = completed.select("user_data").distinct().withColumn("done", F.lit(True))
    known = truth.join(done, "user_data", "left").withColumn("known", F.lit(True))
    both = known.join(first, "user_data", "full")
    missing, spurious = F.col("n").isNull(), F.col("known").isNull()
    valid = F.coalesce("t_requested_bytes_valid", F.lit(True))
    wrong = {
        "missing": missing,
        "spurious": spurious,
        "duplicate": ~spurious & (F.col("n") > 1),
        "offset": F.col("offset") != F.col("t_offset"),
        "bytes": valid & (F.col("requested_bytes") != F.col("t_requested_bytes")),
        "lower_bound": ~valid
        & (F.coalesce("t_requested_bytes_lower", F.lit(0)) > F.col("requested_bytes")),
        "direction": F.col("ddir") != F.col("t_ddir"),
        "no_completion": ~missing & ~spurious & F.col("done").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(c, n) for n, c in wrong.items()]))
    return both.select(F.explode(found).alias("problem"), "user_data")


def self_check(truth: DataFrame, emission: Sequence[str]) -> DataFrame:
    """Repeated tags, results that differ from requests, and tags out of order."""
    rows = Scan(truth, [], emission).add(Previous("_p", F.col("user_data"))).df
    short = (F.col("cqe_res") >= 0) & (F.col("cqe_res") != F.col("requested_bytes"))
    scalar = ~F.col("op_name").isin("READV", "WRITEV")
    return rows.agg(
        (F.count(F.lit(1)) - F.count_distinct("user_data")).alias("duplicates"),
        count_if(scalar & short).alias("result_mismatch"),
        count_if(F.col("user_data") < F.col("_p")).alias("not_monotonic"),
    )


def component_problems(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Records whose parts differ from the truth or do not add up to their size."""
    names = ("k_bytes", "v_bytes", "scale_bytes")
    known = truth.select("key", "header_bytes", *[F.col(c).alias(f"t_{c}") for c in names])
    rows = records.join(known, "key")
    part = {c: F.coalesce(F.col(f"components.{c}"), F.lit(0)) for c in names}
    total = part["k_bytes"] + part["v_bytes"] + part["scale_bytes"] + F.col("header_bytes")
    wrong = {
        "part": F.col("part") != "kv",
        "object": F.col("object_id") != F.col("key"),
        "components": F.col("components").isNull(),
        "k": part["k_bytes"] != F.col("t_k_bytes"),
        "v": part["v_bytes"] != F.col("t_v_bytes"),
        "scale": part["scale_bytes"] != F.col("t_scale_bytes"),
        "sum": total != F.col("bytes"),
    }
    found = F.array_compact(F.array(*[F.when(c, n) for n, c in wrong.items()]))
    return rows.select("key", found.alias("problems")).filter(F.size("problems") > 0)


def replay_report(timings: DataFrame, mdts_bytes: int) -> DataFrame:
    """Latency quantiles and projected rates per replayed object and operation."""
    by = ["op", "object"]
    q = quantiles(timings, by, "ms", {"p50_ms": 0.5, "p99_ms": 0.99}, nearest=True)
    means = timings.groupBy(*by).agg(F.avg("ms").alias("mean"), F.max("bytes").alias("payload"))
    rows = q.join(means, by)
    proj = project_object(F.col("payload"), F.col("op"), mdts_bytes=mdts_bytes)
    seconds = F.col("mean") / 1e3
    return rows.select(
        *by,
        "n",
        "p50_ms",
        "p99_ms",
        F.round(F.col("payload") / seconds / 1e6, 12).alias("mbps"),
        F.round(proj["n_commands"] / seconds, 12).alias("cmds_per_s"),
    )


def speedup(runs: DataFrame) -> DataFrame:
    """Best wall time per worker count, its rate, and the gain over the smallest count.

    Worker counts are few, so the last step orders a handful of rows.
    """
    best = runs.groupBy("workers").agg(F.min("wall_ns").alias("best_ns"), F.sum("bytes").alias("bytes"))
    smallest = best.agg(F.min_by("best_ns", "workers")).first()[0]
    return best.select(
        "workers",
        "best_ns",
        F.round(F.col("bytes") / F.col("best_ns"), 15).alias("gbs"),
        F.round(F.lit(smallest) / F.col("best_ns"), 9).alias("speedup"),
    )


def stream_referee(streams: DataFrame, stream: str, base: str) -> DataFrame:
    """Totals per replay stream and its command inflation against the base stream."""
    n = F.count(F.lit(1))
    rows = streams.groupBy(stream).agg(
        n.alias("cmds"),
        count_if(F.col("op_name") == "write").alias("writes"),
        (F.sum("bytes") / 1e6).alias("mb"),
        (F.sum("bytes") / n / 1024).alias("avg_kb"),
        ((F.max("ts_ns") - F.min("ts_ns")) / 1e9).alias("dur_s"),
    )
    reference = rows.filter(F.col(stream) == base).select("cmds").first()
    base_n = reference[0] if reference else None
    return rows.withColumn("inflation_pct", (F.col("cmds") - base_n) * 100 / F.lit(base_n))


def common_sizes(streams: DataFrame, stream: str, k: int = 3) -> DataFrame:
    """The k most frequent command sizes of each stream with their whole-percent share."""
    counts = streams.groupBy(stream, "bytes").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(stream).agg(F.sum("n").alias("total"))
    # A stream has at most as many sizes as a transfer has blocks.
    ranked = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy(stream).orderBy(F.desc("n"), "bytes"))
    )
    top = ranked.filter(F.col("rank") <= k).join(totals, stream)
    share = F.floor(F.col("n") * 100 / F.col("total")).cast("long")
    return top.select(stream, "rank", "bytes", "n", share.alias("pct"))
