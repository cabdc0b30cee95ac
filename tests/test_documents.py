"""Documents as a whole: what the part files hold, odd entries, and kinds of documents that lack something."""

import json

import pytest
from pyspark.sql import functions as F

from iotrail import sinks
from iotrail.operators import documents as D
from iotrail.operators import syscalls as Y
from iotrail.sources import records


def written(lines, path):
    sinks.write_document(lines, str(path))
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("at"), (F.col("id") % 1).alias("tie"), F.to_json(F.struct("id")).alias("value"))


def test_lists_of_any_length(spark, tmp_path):
    head = spark.sql("select 1 as a, named_struct('x', null, 'y', 'q\"') as b, 'z' as c")
    lists = {"one": numbers(spark, 5000), "b.two": numbers(spark, 1), "b.none": numbers(spark, 0), "n.three": numbers(spark, 2), "last": numbers(spark, 3)}
    doc = written(sinks.json_document(head, lists), tmp_path / "doc")
    ids = lambda n: [{"id": i} for i in range(n)]
    assert doc == {"a": 1, "c": "z", "one": ids(5000), "b": {"x": None, "y": 'q"', "two": ids(1), "none": []}, "n": {"three": ids(2)}, "last": ids(3)}
    assert len(list((tmp_path / "doc").glob("part-*"))) > 1
    assert written(sinks.json_document(head.select("a"), {"b.none": numbers(spark, 0)}), tmp_path / "empty") == {"a": 1, "b": {"none": []}}


def test_label_documents(spark):
    rows = spark.createDataFrame([("a", 'q"1', 5, 1.5), ("a", None, 6, None), ("b", "x", 7, 2.0)], "label string, op string, n long, v double")
    more = spark.createDataFrame([("a", 3, 9)], "label string, rank long, n long")
    docs = {r["label"]: json.loads(r["value"]) for r in sinks.label_documents({"ops": (rows, "op"), "ranks": (more, "rank")}).collect()}
    assert docs["a"] == {"label": "a", "ops": {'q"1': {"n": 5, "v": 1.5}, "null": {"n": 6, "v": None}}, "ranks": {"3": {"n": 9}}}
    assert docs["b"] == {"label": "b", "ops": {"x": {"n": 7, "v": 2.0}}}
    assert sinks.label_documents({"ops": (rows.limit(0), "op")}).count() == 0


EVENTS = "event_id long, ts_ns long, pid long, comm string, syscall_nr int, syscall_name string, fd long, size long, file_offset long, filename string, open_flags long, ret long"


def test_syscall_document(spark, tmp_path):
    rows = [
        (1, 2_000_000, 7, "cp", 0, "read", 3, 100, 0, 'a"b\\c', None, 100), (2, 1_500_000, 7, "cp", 257, "openat", 3, 0, 0, "/x", 66, -13),
        (3, 3_000_000_000, 8, "dd", 1, "write", 4, 30, 5, None, None, 30),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    doc = written(sinks.json_document(*D.syscall_document(events, 'my "run"')), tmp_path / "doc")
    assert doc["metadata"] == {"total_events": 3, "monitoring_duration": 2.999, "unique_syscalls": 3, "unique_processes": 2, "workload_label": 'my "run"', "detailed_logging": True}
    assert doc["summary"] == {"total_io_bytes": 130, "most_active_process": "cp", "most_active_process_pid": 7}
    assert [c["syscall_name"] for c in doc["aggregated_stats"]["all_syscalls"]] == ["read", "write", "openat"]
    assert [(p["pid"], p["total_events"], len(p["syscalls"])) for p in doc["process_analysis"]] == [(7, 2, 2), (8, 1, 1)]
    assert [e["timestamp_ms"] for e in doc["raw_events"]] == [1.5, 2.0, 3000.0]
    opened, read, _ = doc["raw_events"]
    assert (opened["open_flags_str"], opened["open_flags_hex"], opened["error_code"], opened["io_direction"]) == ("O_RDWR|O_CREAT", 66, 13, "NONE")
    assert (read["filename"], read["open_flags_str"], read["error_code"], read["io_direction"]) == ('a"b\\c', "", 0, "READ")
    bare = written(sinks.json_document(*D.syscall_document(events, detailed=False)), tmp_path / "bare")
    assert bare["raw_events"] == [] and bare["metadata"]["detailed_logging"] is False
    none = written(sinks.json_document(*D.syscall_document(events.limit(0))), tmp_path / "none")
    assert none["metadata"]["total_events"] == 0 and none["summary"]["most_active_process"] == "N/A" and none["process_analysis"] == []


def test_io_path_document(spark, tmp_path):
    """Two lives of pid 2: only the one in the family counts; a fork within the other family stays out."""
    forks = spark.createDataFrame([(1, 2, 10, "a", "b"), (2, 3, 20, "b", "c"), (9, 2, 50, "z", "y"), (2, 4, 60, "y", "x")], "parent_pid long, child_pid long, ts_ns long, parent_comm string, child_comm string")
    base = {"comm": "b", "fd": 3, "length": 4096, "file_offset": 0, "latency_us": 9, "filename": "", "path": "", "return_value": 0, "address": 0, "page_events": 2}
    calls = [(1, 5, 1, "pread64", "/d/file"), (2, 30, 2, "mmap", ""), (3, 55, 2, "mmap", ""), (4, 31, 3, "read", ""), (5, 70, 77, "read", "")]
    events = spark.createDataFrame(calls, "event_id long, ts_ns long, pid long, syscall string, path string")
    events = events.withColumns({k: F.lit(v) for k, v in base.items() if k != "path"}).withColumn("return_value", F.when(F.col("syscall") == "mmap", 4096 + F.col("event_id")).otherwise(0))
    vma = spark.createDataFrame([(1, 8192, 16384, "/m/file", "r--s"), (2, 4096, 8192, "/m/lib", "r-xp")], "pid long, start_addr long, end_addr long, pathname string, perms string")
    doc = written(sinks.json_document(*D.io_path_document(events, forks, vma, root=1)), tmp_path / "doc")
    assert (doc["pid"], doc["follow_forks"], doc["event_count"], doc["tracked_pids"]) == (1, True, 3, [1, 2, 3])
    tree = doc["process_tree"]
    assert (tree["root_pid"], tree["root_comm"]) == (1, "a") and [(f["parent_pid"], f["child_pid"], f["child_comm"]) for f in tree["forks"]] == [(1, 2, "b"), (2, 3, "c")]
    assert tree["children"] == [{"pid": 1, "birth_ns": -1, "children": [2]}, {"pid": 2, "birth_ns": 10, "children": [3]}]
    assert [(e["syscall"]["timestamp_ns"], e["fd_info"], (e["mapping"] or {}).get("file")) for e in doc["events"]] == [(5, "/d/file", "/m/file"), (30, "", "/m/lib"), (31, "", None)]
    assert doc["events"][1]["mapping"] == {"start": "0x1000", "end": "0x2000", "size_kb": 4, "permissions": "r-xp", "file": "/m/lib"}
    other = written(sinks.json_document(*D.io_path_document(events, forks, vma, root=9)), tmp_path / "other")
    assert other["tracked_pids"] == [2, 4, 9] and [e["syscall"]["timestamp_ns"] for e in other["events"]] == [55]


@pytest.mark.parametrize(
    ("text", "kind", "rows"),
    [
        (None, "bad", 1), ("", "bad", 1), ("[1, 2", "bad", 1), ("7", "other", 1), ('{"mode": 5}', "other", 1), ('{"mode": "heatmap"}', "heatmap", 1), ('{"mode": "snapshot"}', "snapshot", 1),
        ('{"mode": "timeline", "samples": []}', "timeline", 1), ('{"mode": "timeline", "samples": "x"}', "timeline", 1), ('{"mode": "region_all", "files": [{"pathname": "a"}]}', "region_all", 1),
        ('{"mode": "heatmap", "snapshots": [{"iter": 1, "blocks": [1, 2, 3]}, {"iter": 2}], "pid": 4}', "heatmap", 3),
        ('{"mode": "region_all", "tracking": [{"iter": 1}, {"iter": 2, "files": [{"path": "a", "dirty": 1}]}]}', "region_all", 1),
        ('{"mode": "file_unified", "files": [{"pathname": "a"}, {"pathname": "b", "snapshots": [{"iter": 1}, {"iter": 2, "blocks": [5]}]}]}', "file_unified", 1),
    ],
)
def test_odd_monitor_documents(spark, text, kind, rows):
    """A document never fails, and is never lost."""
    docs = spark.createDataFrame([(1, text)], "id long, value string")
    got = records.monitor_rows(docs).collect()
    assert {(r["id"], r["kind"]) for r in got} == {(1, kind)} and len(got) == rows
    assert records.monitor_costs(docs).count() == 0


def test_process_sets_and_summaries(spark):
    live = spark.createDataFrame([(1,), (1,), (2,)], "pid long")
    active = spark.createDataFrame([(2,), (3,)], "pid long")
    assert sorted(map(tuple, Y.process_sets(live, active).collect())) == [("active_only", 3), ("both", 2), ("live_only", 1)]
    none = spark.createDataFrame([], EVENTS)
    assert Y.run_summary(none).collect() == [(0, None, 0, None, None)]
    assert Y.process_io(none, live, ["read"]).count() == 0
