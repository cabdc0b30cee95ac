"""Readers and writers on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from iotrail import schemas, sinks
from iotrail.operators import pages as G
from iotrail.sources import records, text


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_block_line(spark, tmp_path):
    path = tmp_path / "trace.txt"
    path.write_text(
        "CPU5 (disk7):\n\n251,9 6 1 0.000098765 4321 Q WF 7340032 + 24 [writer one]\n"
        "251,9 6 2 0.75 4321 C R 48+16\n251,9 6 3 1.5 4321 M 96 + 8 [x]\nno event here\n251,9 6 4 1.5 4321 QQ R 96 + 8\nTotal (disk7):\n===\n"
    )
    rows = text.read_block_trace(spark, str(path)).orderBy("seq").collect()
    first = rows[0]
    assert len(rows) == 3
    assert (first["ts_ns"], first["sector"], first["nblocks"], first["process"]) == (98765, 7340032, 24, "writer one")
    assert rows[1]["process"] == "" and rows[1]["is_read"] and (rows[1]["sector"], rows[1]["nblocks"]) == (48, 16)
    assert rows[2]["rwbs"] == ""
    parsed = text.block_trace(text.read_lines(spark, str(path)))
    assert parsed.filter("NOT parsed").count() == 2


def test_tolerant_block_line(spark):
    row = text.block_trace(lines(spark, "65,16 2 777 0.031415926 5150 AB RX9 1048592 + 40 [z]"), tolerant=True).first()
    assert (row["action"], row["rwbs"], row["seq"], row["ts_ns"]) == ("AB", "RX9", 777, 31415926)


def test_ftrace_lines(spark):
    rows = text.ftrace_block(
        lines(
            spark,
            "loader-77 [011] ...1 42.125: block_rq_issue: 251,4 RA 0 (x y) 81920 + 256 [loader]",
            "idle-0 [011] ..s1 42.250: block_rq_complete: 251,4 RA () 81920 + 256 [0]",
            "something else",
        )
    ).orderBy("ts_ns").collect()
    assert [r["action"] for r in rows] == ["issue", "complete"]
    assert rows[0]["bytes"] == 131072 and rows[0]["ts_ns"] == 42125000000 and rows[1]["sector"] == 81920


def test_nvme_lines(spark):
    rows = text.ftrace_nvme(
        lines(
            spark,
            "job-9 [4] 7.25: NVME_SETUP_CMD: nvme3: nvme3n2 qid=5, cmdid=40, nsid=2, flags=0x0, cmd=(nvme_cmd_read slba=4711, len=6, qid=99)",
            "job-9 [4] 7.5: nvme_complete_rq: nvme3: qid=5, cmdid=40, res=0",
        )
    ).orderBy("ts_ns").collect()
    assert (rows[0]["disk"], rows[0]["ctrl"], rows[0]["qid"], rows[0]["nsid"]) == ("nvme3n2", 3, 5, 2) and rows[0]["cmd"].startswith("nvme_cmd_read")
    assert rows[1]["disk"] is None and rows[1]["status"] == "unknown"


def test_strace_lines(spark):
    rows = text.strace(
        lines(
            spark,
            '[pid 31] 1800000000.5 pread64(6, "", 512, 1536) = 512',
            "[pid 31] 1800000001.5 clone(child_stack=NULL) = 88",
            '1800000002.5 openat(AT_FDCWD, "/data/x", O_RDONLY) = 3',
            '1800000003.5 read(3, ")", 1) = 1',
            "1800000004.5 mmap(NULL, 8192, PROT_READ, MAP_SHARED, 3, 0) = 0x7f0000000000",
        ),
        default_pid=9,
    ).orderBy("ts_ns").collect()
    assert [r["syscall"] for r in rows] == ["pread64", "clone", "openat", "mmap"]
    assert (rows[0]["fd"], rows[0]["length"], rows[0]["offset"]) == (6, 512, 1536)
    assert rows[1]["child_pid"] == 88 and rows[2]["filename"] == "/data/x" and rows[2]["pid"] == 9
    assert rows[3]["return_value"] == 0x7F0000000000 and rows[3]["address"] == 0


def test_maps_line(spark):
    row = text.proc_maps(lines(spark, "560000a00000-560000a02000 -w-s 00001000 08:11 90210   /some/where else")).first()
    assert row["end_addr"] - row["start_addr"] == 8192 and row["pathname"] == "/some/where else"
    assert (row["perms"], row["file_offset"], row["inode"]) == ("-w-s", 4096, 90210)


def test_compressed_and_truncated_capture(spark, tmp_path):
    good = {"event_type": "nvme_cmd", "user_data": 2**64 - 1, "tid": 5, "slba": 8, "bytes": 4096, "ts": 10**18 + 1}
    body = json.dumps(good) + "\n\n" + json.dumps({"event_type": "drops", "dropped": 7}) + "\n" + json.dumps(good)[:20]
    with gzip.open(tmp_path / "cap.jsonl.gz", "wt") as f:
        f.write(body)
    rows = records.classified(records.read_capture(spark, str(tmp_path), schemas.DEVICE)).collect()
    kinds = sorted(r["family"] for r in rows)
    assert kinds == ["corrupt", "drops", "nvme_cmd"]
    cmd = next(r for r in rows if r["family"] == "nvme_cmd")
    assert int(cmd["user_data"]) == 2**64 - 1 and cmd["ts"] == 10**18 + 1


def test_families(spark):
    docs = [
        {"trace_id": 4, "op": "store", "bytes": 9},
        {"event_type": "clock_anchor"},
        {"event_type": "kvio_meta", "schema": 2},
        {"foo": 1},
    ]
    parsed = records.parse_lines(lines(spark, *map(json.dumps, docs)), schemas.CAPTURE)
    got = sorted(r["family"] for r in records.classified(parsed).collect())
    assert got == ["clock_anchor", "kvio_meta", "other", "semantic"]


def test_arms(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"event_type": "nvme_cmd", "tid": 1}) + "\n")
    specs = [f"x={tmp_path}/a.jsonl,-", f"y={tmp_path}/a.jsonl,{tmp_path}/b.jsonl"]
    got = records.read_arms(spark, specs).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"x": 1, "y": 2}


def test_health_log_forms(spark):
    old = "critical_warning : 0x4\nTemperature : 308 K\nAvailable Spare Threshold : 10%\nAvailable Spare : 99%\nData Units Read : 1,234,567"
    doc = 'warming up\n{"temperature": 310, "critical_warning": 1, "avail_spare": 50}'
    rows = text.health_logs(lines(spark, old, doc)).collect()
    assert (rows[0]["critical_warning"], rows[0]["temperature"], rows[0]["avail_spare"]) == (4, 308.0, 99.0)
    assert rows[0]["spare_thresh"] == 10.0 and rows[0]["data_units_read"] == 1234567.0
    assert (rows[1]["critical_warning"], rows[1]["temperature"], rows[1]["percent_used"]) == (1, 310.0, None)


def test_phase_lines(spark):
    rows = text.phase_markers(
        lines(spark, "PHASE_START access=x mono_ns=5 feat_bytes=68", "noise", "PHASE_END mono_ns=9 ra_signal=431.250 signal_bytes=2")
    ).orderBy("mono_ns").collect()
    assert rows[0]["feat_bytes"] == 68 and rows[1]["ra_signal"] == 431.25


def test_replay_log_is_ordered(spark, tmp_path):
    cmd = spark.createDataFrame(
        [(5_000_000, "write", 2, 4096), (1_000_000, "read", 1, 512), (1_500_000, "flush", 0, 0)],
        "ts_ns long, op_name string, slba long, bytes long",
    )
    out = str(tmp_path / "log")
    sinks.write_replay_log(sinks.replay_log(cmd, "/dev/x", ["slba"]), ["slba"], out)
    got = [ln for p in sorted((tmp_path / "log").glob("part-*")) for ln in p.read_text().splitlines()]
    assert got == [
        "fio version 3 iolog",
        "0 /dev/x add",
        "0 /dev/x open",
        "0 /dev/x read 512 512",
        "4 /dev/x write 1024 4096",
        "4 /dev/x close",
    ]


@pytest.mark.parametrize("kind", ["json", "csv", "parquet"])
def test_reports_read_back(spark, tmp_path, kind):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    sinks.write_report(df, str(tmp_path / kind), kind)
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    assert reader.format(kind).load(str(tmp_path / kind)).count() == 5


def test_manifest_document(spark):
    objects = spark.createDataFrame([(0, "kv", 700000, ["store", "load"])], "index long, part string, payload_bytes long, ops array<string>")
    value = sinks.replay_manifest_document(objects, 704512)
    back = json.loads(value.first()["value"])
    assert back["ops"] == ["store", "load"] and back["device_geometry"]["slot_bytes"] == 704512


def test_page_diff_patterns(spark):
    base = bytearray(4096)
    strided = bytearray(base)
    strided[::64] = b"\x01" * 64
    sparse = bytearray(base)
    for at in (0, 1000, 2000, 3000):
        sparse[at : at + 4] = bytes.fromhex("deadbeef")
    burst = bytearray(base)
    burst[1024:1280] = b"\xff" * 256
    rows = [(i, base, after) for i, after in enumerate([base, strided, sparse, burst])]
    df = spark.createDataFrame([(i, bytes(a), bytes(b)) for i, a, b in rows], "i int, before binary, after binary")
    got = {r["i"]: r for r in G.page_diff(df, ["i"], 256).collect()}
    assert set(got) == {1, 2, 3}
    assert [got[i]["changed_bytes"] for i in (1, 2, 3)] == [64, 16, 256]
    assert [got[i]["changed_words"] for i in (1, 2, 3)] == [64, 4, 32]
    assert got[3]["blocks"] == [(4, 256)] and got[3]["details"] == []
    assert [d["offset"] for d in got[2]["details"]][:5] == [0, 1, 2, 3, 1000]


def test_ground_truth_lines_are_numbered(spark, tmp_path):
    good = [json.dumps({"user_data": 2**64 - 1 - i, "offset": i * 512, "requested_bytes": 512, "op_name": "WRITE", "iov_sizes": [256, 256]}) for i in range(4)]
    (tmp_path / "a.jsonl").write_text("\n".join([good[0], good[1][:20], good[2]]) + "\n")
    (tmp_path / "b.jsonl").write_text(good[3] + "\n")
    rows = records.read_ground_truth(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["line"], r["bad"]) for r in rows] == [(1, False), (2, True), (3, False), (4, False)]
    assert int(rows[0]["user_data"]) == 2**64 - 1 and rows[3]["offset"] == 1536 and rows[2]["iov_sizes"] == [256, 256]
