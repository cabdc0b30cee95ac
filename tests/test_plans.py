"""What the plans must and must not hold at any scale."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as contract
from iotrail.operators.scan import CHUNK, RunningSum, Scan

# Streams have run by the time their result is returned.
BATCH = sorted(n for n in contract.queries() if not n.startswith("stream_"))


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


SAMPLE = BATCH[::6]


@pytest.mark.parametrize("name", SAMPLE)
def test_no_products_and_only_needed_columns(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert len(re.findall(r"\bl_\w+:", schema)) < 11, "a scan reads every column of lineitem"


def test_filters_reach_the_scan(spark, tmp_path):
    """On a written trace, a stage filter is pushed down and unused columns are not read."""
    from iotrail.operators.pairing import lifecycles
    from iotrail.plans.registry import Tables

    Tables(spark, SF).blk.withColumn("process", F.lit("x")).write.parquet(str(tmp_path / "blk"))
    text = plan(lifecycles(spark.read.parquet(str(tmp_path / "blk"))))
    assert "In(action, [C,D,Q])" in text.replace("Or(", "In(") or "PushedFilters: [In(action" in text
    assert all("process" not in r and "pid" not in r for r in re.findall(r"ReadSchema: struct<([^>]*)>", text))


def test_a_plain_keyed_scan_shuffles_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    scan = Scan(df, ["k"], ["id"], chunked=False)
    scan.add(RunningSum("a", F.col("id"))).add(RunningSum("b", F.col("a")))
    assert plan(scan.df).count("Exchange hashpartitioning") == 1


def test_chunks_are_placed_by_number(spark):
    df = spark.range(6400).select((F.col("id") % 3).alias("k"), "id")
    scan = Scan(df, ["k"], ["id"], chunked=True).add(RunningSum("a", F.col("id")))
    text = plan(scan.df)
    assert "hashpartitioning(_chunk" not in text.split("BroadcastExchange")[0]
    sizes = [r["count"] for r in scan.df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)


def test_a_hot_position_is_no_single_chunk(spark):
    from iotrail.operators.asof import asof_join

    left = spark.range(8000).select(F.lit(7).alias("at"), "id")
    right = spark.createDataFrame([(3, 1), (7, 2), (9, 3)], "at long, v long")
    rows = asof_join(left, right, [], "at", "at", {"v": "v"})
    assert rows.filter("v = 2").count() == 8000
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 4000


def test_a_global_scan_is_cut_into_balanced_chunks(spark):
    df = spark.range(10_000).select(F.lit(5).alias("ts"), "id")
    sizes = Scan(df, [], ["ts", "id"])._df.groupBy(CHUNK).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 5_000
