"""Writers for reports, logs and nested documents."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import int_div


def replay_log(cmd: DataFrame, device: str, order: list[str], block_bytes: int = 512) -> DataFrame:
    """Lines of a device replay log in order: header, open, one per command, close.

    The lines keep (part, ts_ns, order) as sort columns, so that writing them in
    order takes one range shuffle and no line numbers.
    """
    cmd = cmd.filter(F.col("op_name").isin("read", "write"))
    start, last = cmd.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    start, last = start or 0, last or 0
    ms = int_div(F.col("ts_ns") - start, 1_000_000)
    line = F.concat_ws(
        " ", ms, F.lit(device), F.col("op_name"), F.col("slba") * block_bytes, F.col("bytes")
    )
    body = cmd.select(F.lit(1).alias("part"), "ts_ns", *order, line.alias("value"))
    spark = cmd.sparkSession
    ends = spark.createDataFrame(
        [
            (0, 0, "fio version 3 iolog"),
            (0, 1, f"0 {device} add"),
            (0, 2, f"0 {device} open"),
            (2, 0, None),
        ],
        "part int, ts_ns bigint, value string",
    )
    close = f"{(last - start) // 1_000_000} {device} close"
    ends = ends.withColumn("value", F.coalesce("value", F.lit(close)))
    return ends.unionByName(body, allowMissingColumns=True)


def write_replay_log(lines: DataFrame, order: list[str], path: str) -> None:
    """Ordered part files: their names sort like their contents."""
    lines.orderBy("part", "ts_ns", *order).select("value").write.mode("errorifexists").text(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A result as JSON, CSV or Parquet part files."""
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


def replay_manifest_document(manifest: DataFrame, slot_bytes: int, engine: str = "io_uring") -> DataFrame:
    """One JSON line per object, each with the device geometry it needs."""
    geometry = F.struct(
        F.lit(engine).alias("engine"),
        F.lit(131072).alias("mdts_bytes"),
        F.lit(4096).alias("block_align"),
        F.lit(4096).alias("header_bytes"),
        F.lit(slot_bytes).alias("slot_bytes"),
    )
    record = F.struct("index", "part", "payload_bytes", "ops", geometry.alias("device_geometry"))
    return manifest.select(F.to_json(record).alias("value"))


def process_documents(per_syscall: DataFrame, keys: list[str]) -> DataFrame:
    """One nested record per process with its statistics per syscall.

    A process has at most as many entries as there are system calls, so the
    collected lists are small whatever the trace size.
    """
    entry = F.struct("syscall_name", "count", "bytes", "avg_bytes", "pct_of_process")
    return per_syscall.groupBy(*keys).agg(
        F.sum("count").alias("events"),
        F.sum("bytes").alias("bytes"),
        F.sort_array(F.collect_list(entry)).alias("syscalls"),
    )


def json_document(head: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Lines (section, at, tie, value) of one JSON document whose lists may be of any length.

    ``head`` holds the plain fields in one row, structs for objects. ``lists`` are tables by the name of their field (``a.b``: the field
    b of the object a) with ``value``, an entry as JSON, and its place (at, tie), which is unique. In the order of (section, at, tie) the
    lines are the document, so part files one behind the other are, too. Only the head passes through the driver.
    """
    objects = {name.partition(".")[0] for name in lists if "." in name}
    text = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(*[c for c in head.columns if c not in objects]), text).alias("plain")
    row = head.select(plain, *[F.to_json(F.col(c), text).alias(c) for c in head.columns if c in objects]).first().asDict()
    opening, inside, marks, out = row["plain"][:-1], "", [], None
    for number, (name, rows) in enumerate(lists.items()):
        parent, _, field = name.rpartition(".")
        if parent != inside:
            opening += "}" if inside else ""
            if parent:
                opening += f",{json.dumps(parent)}:" + (row[parent][:-1] if parent in row else "{")
        inside = parent
        opening += ("" if opening.endswith("{") else ",") + f"{json.dumps(field)}:["
        marks.append((2 * number, 0, 0, opening))
        opening = "]"
        first = rows.orderBy("at", "tie").select("at", "tie").first()
        if first is not None:
            leads = (F.col("at") == F.lit(first["at"])) & (F.col("tie") == F.lit(first["tie"]))
            entry = F.concat(F.when(leads, "").otherwise(","), "value").alias("value")
            body = rows.select(F.lit(2 * number + 1).alias("section"), "at", "tie", entry)
            out = body if out is None else out.unionByName(body)
    marks.append((2 * len(lists), 0, 0, opening + ("}}" if inside else "}")))
    frame = head.sparkSession.createDataFrame(marks, "section int, at long, tie long, value string")
    return frame if out is None else frame.unionByName(out)


def write_document(lines: DataFrame, path: str) -> None:
    """Part files that make up the document in the order of their names."""
    lines.orderBy("section", "at", "tie").select("value").write.mode("errorifexists").text(path)


def label_documents(reports: dict[str, tuple[DataFrame, str]], label: str = "label") -> DataFrame:
    """(``label``, ``value``): one JSON document per label, {label, report: {key: {metric: number}}}.

    ``reports`` are tables by name, each with the column of its keys, such as operations; all other columns are metrics. A label has one
    entry per key, so the lists are as long as there are keys, whatever the size of the trace. Keys come in order, null keys as "null".
    """
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(F.coalesce(c.cast("string"), F.lit("null")))), r"(?s)^\[(.*)\]$", 1)
    joined = lambda pair: F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda p: F.concat(p["k"], F.lit(":"), p["v"])), ",")
    parts = []
    for name, (rows, key) in reports.items():
        metrics = F.to_json(F.struct(*[c for c in rows.columns if c not in (label, key)]), {"ignoreNullFields": "false"})
        parts.append(rows.select(label, F.lit(name).alias("report"), quoted(F.col(key)).alias("k"), metrics.alias("v")))
    every = reduce(DataFrame.unionByName, parts)
    inner = every.groupBy(label, "report").agg(joined(F.struct("k", "v")).alias("v"))
    outer = inner.select(label, quoted(F.col("report")).alias("k"), F.concat(F.lit("{"), "v", F.lit("}")).alias("v")).groupBy(label).agg(joined(F.struct("k", "v")).alias("v"))
    return outer.select(label, F.concat(F.lit('{"label":'), quoted(F.col(label)), F.lit(","), "v", F.lit("}")).alias("value"))
