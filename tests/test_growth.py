"""Findings on growth: what a plan may not hold any more, with results worked out by hand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from iotrail.operators import blocks as B
from iotrail.operators import pages as G
from iotrail.operators import readamp as A
from iotrail.operators.asof import asof_join
from iotrail.plans import objects
from iotrail.plans.registry import REGISTRY, Tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_histogram_beyond_64_bits(spark):
    rows = spark.createDataFrame([(True, 1 << 62)] * 3 + [(True, 5)], "is_read boolean, ns long")
    got = {r["bucket"]: r for r in B.log2_histogram(rows, "ns", "is_read", cap=62).collect()}
    assert got[62]["n"] == 3 and got[62]["approx_bytes"] is None and got[62]["cumulative_pct"] == 100
    assert got[2]["approx_bytes"] == 4


def tables(spark, tmp_path):
    """Twelve parts of four sizes and two brands."""
    parts = [(k, 1 + k % 4 * 9, f"b{k % 2}") for k in range(1, 13)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return Tables(spark, str(tmp_path))


def test_pages_are_not_shuffled(spark, tmp_path):
    t = tables(spark, tmp_path)
    for name in ("page_letters", "page_dirty_density", "dirty_runs", "hottest_window"):
        found = REGISTRY[name].build(t)
        assert plan(found).count("Exchange hashpartitioning") == 1, name  # of the mappings
    letters = {(r["start_addr"], r["iter"], r["stripe"]): r["letters"] for r in REGISTRY["page_letters"].build(t).collect()}
    assert sum(map(len, letters.values())) == 2 * sum((1 + k % 4 * 9) * 4 for k in range(1, 13))

    def letter(base, i, it):
        if (base + i) % 5:
            return "D" if (base * 7 + i * 3 + it) % 4 == 0 else "F" if i % 3 == 0 else "P"
        return "S" if (base + i) % 10 == 0 else "."

    assert letters[3 << 20, 1, 1] == "".join(letter(3, i, 1) for i in range(64, 112))


def test_hottest_window_without_join(spark):
    values = {("a", 0): [0, 9, 9, 0, 9, 9, 0], ("a", 1): [0] * 9, ("b", 0): [1, 2, 3], ("b", 1): [k * 7 % 5 for k in range(80)]}
    rows = [(*k, i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    blocks = spark.createDataFrame(rows, "g string, iter long, block long, dirty_pct long")
    found = G.hottest_window(blocks, ["g", "iter"])
    assert "Join" not in plan(found)
    want = {}
    for key, vs in values.items():
        w = max(4, len(vs) // 8)
        sums = [(sum(vs[i : i + w]), -i) for i in range(len(vs) - w + 1)]
        if sums and max(sums)[0] > 0:
            want[key] = (-max(sums)[1], w, max(sums)[0])
    assert {(r["g"], r["iter"]): (r["start_block"], r["window"], r["window_sum"]) for r in found.collect()} == want


def test_file_pages_are_hashed(spark):
    size = 4096
    vma = [("f", 0, 0, 2 * size), ("f", 0, 100 * size, 103 * size), ("f", size, 200 * size, 205 * size), ("g", 0, 7 * size, 8 * size), ("g", 0, 7 * size, 8 * size)]
    vma = spark.createDataFrame(vma, "pathname string, file_offset long, start_addr long, end_addr long")
    size_of = F.col("end_addr") - F.col("start_addr")
    pages = G.numbered(vma).withColumn("page_idx", F.explode(F.sequence(F.lit(0).cast("long"), (size_of / size).cast("long") - 1)))
    pages = pages.withColumns({"iter": F.lit(0).cast("long"), "present": F.col("start_addr") == 100 * size, "soft_dirty": F.col("start_addr") == 200 * size})
    pages = pages.withColumns({"swapped": ~F.col("present"), "file_mapped": F.col("page_idx") == 1})
    found = G.file_pages(pages)
    assert "SortAggregate" not in plan(found)
    got = {(r["pathname"], r["page_idx"]): tuple(r)[3:] for r in found.collect()}
    first = {("f", p): (True, False, False, p == 1) for p in range(3)}
    assert got == first | {("f", p): (False, True, True, p == 2) for p in range(3, 6)} | {("g", 0): (False, False, True, False)}


def test_portions_of_batches():
    parts = list(G._portions(iter([pd.DataFrame({"a": range(600)}), pd.DataFrame({"a": range(3)})])))
    assert [len(p) for p in parts] == [256, 256, 88, 3]
    assert [v for p in parts for v in p["a"]] == [*range(600), *range(3)]


def test_weekly_rows_are_shuffled_once(spark, tmp_path):
    row = "timestamp '2020-01-{day:02d} 00:00:00' l_shipdate, {k}L l_orderkey, {n} l_linenumber, 4.0D l_quantity, 'R' l_returnflag"
    lines = [spark.sql("select " + row.format(day=d, k=k, n=d)) for k in (1, 2) for d in (1, 2, 9, 30)]
    every = lines[0]
    for line in lines[1:]:
        every = every.unionByName(line)
    every.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = REGISTRY["activity_runs"].build(Tables(spark, str(tmp_path)))
    assert plan(found).count("Exchange") == 1
    week = 7 * 86_400 * 10**9
    got = sorted((r["tid"], r["cmds"], (r["end_ns"] - r["begin_ns"]) // week) for r in found.collect())
    assert got == [(2, 1, 1), (2, 3, 3), (3, 1, 1), (3, 3, 3)]


def test_footprint_of_ranges(spark):
    faults = spark.createDataFrame([(0, 1, 3), (0, 1, 3), (0, 1, 9), (0, 1, None), (0, 1, None), (None, 2, 1)], "dev long, ino long, pgoff long")
    direct = spark.createDataFrame(
        [(0, 1, 0, 4096 * 4), (0, 1, 4096 * 2 + 5, 4096 * 4), (0, 1, 4096 * 2, 1), (0, 1, 4096 * 20, 0), (5, 5, 1 << 40, 1 << 50)], "dev long, ino long, pos long, count long"
    )
    found = A.footprint(faults, direct)
    assert "Generate" not in plan(found)
    got = {(r["dev"], r["ino"]): r["unique_pages"] for r in found.collect()}
    assert got == {(0, 1): 7 + 1 + 1, (None, 2): 1, (5, 5): 1 << 38}


def objects_and_commands(spark, tmp_path):
    """Three operations on two keys, with two commands each."""
    orders = [(k, k % 2, "O", 10.5, f"2020-01-{k + 1:02d}") for k in range(3)]
    orders = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day string")
    orders.select("*", F.to_timestamp("day").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, 1, 1, n, 2.0, "R", f"2020-01-{k + n:02d}") for k in range(3) for n in (1, 2)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, day string")
    lines.select("*", F.to_timestamp("day").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return Tables(spark, str(tmp_path))


def test_spans_shuffle_what_is_asked_for(spark, tmp_path):
    t = objects_and_commands(spark, tmp_path)
    narrow = plan(objects._spans(t).select("trace_id", "begin_ns", "end_ns"))
    assert "Window" in narrow and not any(name in narrow for name in ("l_quantity", "l_returnflag", "o_totalprice"))
    found = REGISTRY["objects_in_flight_overlap"].build(t)
    assert "Window" not in plan(found) and "Join" not in plan(found)  # spans are worked out once
    # Spans begin on days 1, 2 and 3; the quantiles by rank are the first two.
    assert sorted(r["trace_id"] for r in found.collect()) == [1, 2]


def test_asof_join_without_what_nobody_reads(spark):
    left = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 9, "y"), (None, 3, 9, "z"), ("b", 4, None, "w")], "k string, id int, at int, wide string")
    right = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), (None, 8, 3), ("b", 1, 4)], "k string, since int, v int")
    for forward, want in ((False, {1: 1, 2: 2, 3: 3, 4: None}), (True, {1: 1, 2: None, 3: None, 4: None})):
        for chunked in (None, True):
            found = asof_join(left, right, ["k"], "at", "since", {"v": "v"}, forward=forward, chunked=chunked)
            assert [(f.name, f.dataType) for f in found.schema][:4] == [(f.name, f.dataType) for f in left.schema]
            assert {r["id"]: r["v"] for r in found.collect()} == want
            assert {r["id"]: (r["k"], r["at"], r["wide"]) for r in found.collect()} == {r["id"]: (r["k"], r["at"], r["wide"]) for r in left.collect()}
    assert plan(asof_join(left, right, ["k"], "at", "since", {"v": "v"}).select("id", "v")).count("wide") == 1  # in the table itself


def test_command_lines_are_cut_once(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02d}:00", k // 8, "view", 1.0) for k in range(16)]
    rows = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string, value double")
    rows.select("event_id", F.to_timestamp("at").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    found = REGISTRY["nvme_command_pairs"].build(Tables(spark, str(tmp_path)))
    assert "lambda" not in plan(found)
    # Four set-ups are followed by their completions, four minutes later.
    assert sorted((r["event_id"], r["lat_ns"]) for r in found.collect()) == [(k, 4 * 60 * 10**9) for k in (4, 5, 6, 7, 12, 13, 14, 15)]
