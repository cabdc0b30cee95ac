"""Worked values: alignment, size bins, command splits, statistics."""

import math

import pytest
from pyspark.sql import functions as F

from iotrail.functions import scalar as S
from iotrail.functions import stats
from iotrail.operators.objects import projected_sizes


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_alignment_example(spark):
    r = one(spark, **S.unit_metrics(F.lit(12).cast("long"), F.lit(8).cast("long"), 8))
    assert (r["crossings"], r["touched"], r["ideal"], r["waf"], r["aligned"]) == (1, 2, 1, 2.0, False)
    assert one(spark, **S.unit_metrics(F.lit(0).cast("long"), F.lit(8).cast("long"), 8))["waf"] == 1.0
    assert one(spark, **S.unit_metrics(F.lit(4).cast("long"), F.lit(8).cast("long"), 8))["waf"] == 2.0


def test_zero_based_geometry(spark):
    assert one(spark, x=S.zero_based_bytes(F.lit(3), 512))["x"] == 2048


@pytest.mark.parametrize(
    "payload, commands",
    [(4096, 1), (131072, 1), (196608, 2), (327680, 3), (524288, 4), (700000, 6), (1048576, 8), (1572864, 12)],
)
def test_payload_splits(spark, payload, commands):
    sizes = one(spark, x=S.split_sizes(F.lit(payload).cast("long"), 131072, 512))["x"]
    assert len(sizes) == commands
    if payload == 700000:
        assert sizes[-1] == 45056
    store = one(spark, **S.project_object(F.lit(payload).cast("long"), F.lit("store")))
    assert store["n_commands"] == commands + 1
    assert store["total_bytes"] == sum(sizes) + 4096


def test_projected_size_counts(spark):
    rows = spark.createDataFrame([(1, "store", 700000, None)], "trace_id long, op string, bytes long, error string")
    got = {r["size"]: r["n"] for r in projected_sizes(rows, 131072).collect()}
    assert got == {131072: 5, 45056: 1, 4096: 1}


def test_model_chunk(spark):
    token = one(spark, x=S.token_bytes(F.lit(32), F.lit(8), F.lit(128), F.lit(2)))["x"]
    assert token * 256 == 32 * 1024 * 1024


def test_size_bucket_edges(spark):
    edges = {0: "0 B", 1: "1 B", 4: "2-4 B", 512: "257-512 B", 513: "513-1023 B", 1024: "1-2 KB", 2048: "2-4 KB", 16777216: "> 16 MB"}
    for size, label in edges.items():
        assert one(spark, x=S.size_bucket(F.lit(size)))["x"] == label


def test_log_buckets(spark):
    for v in [1, 2, 3, 4, 7, 8, 2**31 - 1, 2**31, 2**53 - 1, 2**53, 2**62 + 1]:
        assert one(spark, x=S.floor_log2(F.lit(v)))["x"] == v.bit_length() - 1
    assert one(spark, x=S.floor_log2(F.lit(0)))["x"] == 0
    for v in [1, 512, 513, 1024, 1025, 4096]:
        want = max(9, math.ceil(math.log2(v))) if v > 1 else 9
        assert one(spark, x=S.power_ceiling(F.lit(v).cast("long"), 8192))["x"] == want


def test_path_id(spark):
    import hashlib

    want = int.from_bytes(hashlib.md5(b"a/b/7").digest()[:8], "big") & (2**63 - 1)
    assert one(spark, x=S.path_id(F.lit("a"), F.lit("b"), F.lit(7)))["x"] == want


def test_page_bits(spark):
    entry = (1 << 63) | (1 << 55) | (1 << 61) | 1234
    r = one(spark, **S.page_state(F.lit(entry - (1 << 64))))
    assert (r["present"], r["swapped"], r["file_mapped"], r["soft_dirty"], r["exclusive"], r["pfn"]) == (
        True, False, True, True, False, 1234,
    )


def test_human_sizes(spark):
    for v, text in [(0, "0 B"), (1023, "1023 B"), (1024, "1 KiB"), (1536, "1.5 KiB"), (5 * 2**30, "5 GiB"), (2**50, "1024 TiB")]:
        assert one(spark, x=S.human_size(F.lit(v).cast("long")))["x"] == text


def test_quantile_kinds(spark):
    import numpy as np

    values = {"a": [5.0, 1.0, 2.0, 2.0, 9.0, 4.0], "b": [3.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    points = {"p50": 0.5, "p95": 0.95, "p100": 1.0}
    linear = {r["g"]: r for r in stats.quantiles(df, ["g"], "v", points).collect()}
    nearest = {r["g"]: r for r in stats.quantiles(df, ["g"], "v", points, nearest=True).collect()}
    for g, vs in values.items():
        for name, q in points.items():
            assert linear[g][name] == pytest.approx(np.quantile(vs, q))
            assert nearest[g][name] == sorted(vs)[min(len(vs) - 1, int(q * len(vs)))]


def test_distances_at_their_ends(spark):
    schema = "m string, arm int, v double"
    same = spark.createDataFrame([("x", a, float(v)) for a in (0, 1) for v in range(50)], schema)
    apart = spark.createDataFrame([("x", a, float(v + 1000 * a)) for a in (0, 1) for v in range(50)], schema)
    lone = spark.createDataFrame([("x", 0, 1.0), ("x", 0, 2.0)], schema)
    point = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 1.0)], schema)
    for df, ks, jsd in [(same, 0, 0), (apart, 1, math.log(2)), (lone, 1, 0.693), (point, 0, 0)]:
        assert stats.ks_distance(df, ["m"], "arm", "v", (0, 1)).first()["ks"] == pytest.approx(ks)
        assert stats.js_divergence(df, ["m"], "arm", "v", (0, 1)).first()["jsd"] == pytest.approx(jsd, abs=1e-6)


def test_correlation_without_variance(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 1.0, 3.0)], "a double, b double, c double")
    r = rows.agg(
        stats.pearson(F.col("a"), F.col("b")).alias("same"),
        stats.pearson(F.col("a"), F.col("c")).alias("other"),
        stats.smape(F.col("a") * 0, F.col("b") * 0).alias("nothing"),
    ).first()
    assert (r["same"], r["other"], r["nothing"]) == (1.0, 0.0, 0.0)


def test_log2_variation(spark):
    rows = spark.createDataFrame([("a", 4096, 4096), ("a", 8192, 4096), ("b", 4096, 1)], "k string, m long, p long")
    got = {r["k"]: r["tv"] for r in stats.log2_variation(rows, ["k"], "m", "p").collect()}
    assert got == {"a": 0.5, "b": 1.0}
