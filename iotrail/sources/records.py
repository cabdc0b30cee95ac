"""Readers of JSON captures and documents, with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iotrail import schemas
from iotrail.operators.scan import RunningSum, Scan

CORRUPT = "_corrupt"


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON lines to typed columns plus ``_corrupt``; blank lines are dropped.

    A line that was cut off keeps its text in ``_corrupt`` and can be counted.
    """
    text = F.trim(column)
    full = f"{schema}, {CORRUPT} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = lines.filter(text != "").withColumn("_r", F.from_json(text, full, options))
    return rows.select(*[c for c in lines.columns if c != column], "_r.*")


def read_capture(spark: SparkSession, path: str, schema: str = schemas.CAPTURE) -> DataFrame:
    """A capture from JSON lines, plain or compressed."""
    reader = spark.read.schema(f"{schema}, {CORRUPT} string")
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def ground_truth(lines: DataFrame, order: list[str]) -> DataFrame:
    """Typed ground-truth records with their ``line`` number (from 1, in the given order); ``bad`` marks lines that are no record."""
    numbered = Scan(lines, [], order).add(RunningSum("line", F.lit(1))).df
    rows = parse_lines(numbered, schemas.GROUND_TRUTH)
    return rows.withColumn("bad", F.col(CORRUPT).isNotNull()).drop(CORRUPT)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth from text files; lines are counted over all of them, file by file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Within a block the number of a row follows the lines.
    return ground_truth(lines.withColumn("row", F.monotonically_increasing_id()), ["file", "block", "row"])


def classified(capture: DataFrame) -> DataFrame:
    """Add ``family``: the record kind, other, or corrupt."""
    kind = F.col("event_type")
    # Record kinds of a capture.
    known = ("nvme_cmd", "nvme_cmp", "clock_anchor", "kvio_meta", "drops", "cq_overflow")
    family = (
        F.when(F.col(CORRUPT).isNotNull(), "corrupt")
        .when(kind.isin(*known), kind)
        .when(kind.isNull() & F.col("op").isNotNull() & F.col("trace_id").isNotNull(), "semantic")
        .otherwise("other")
    )
    return capture.withColumn("family", family)


def lost_events(capture: DataFrame) -> DataFrame:
    """Reported drops, corrupt lines and rows per family."""
    return classified(capture).groupBy("family").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped")
    )


def union_arms(arms: dict[str, DataFrame]) -> DataFrame:
    """Captures of several arms as one table with a ``label``."""
    labelled = [df.withColumn("label", F.lit(name)) for name, df in arms.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def read_arms(spark: SparkSession, specs: list[str]) -> DataFrame:
    """Arms from ``LABEL=SEMANTIC,DEVICE[,SERVING]``; a dash leaves a part out."""
    arms = {}
    for spec in specs:
        label, _, paths = spec.partition("=")
        parts = [read_capture(spark, p) for p in paths.split(",") if p not in ("", "-")]
        arms[label] = reduce(DataFrame.unionByName, parts)
    return union_arms(arms)


def syscall_events(documents: DataFrame, column: str = "value") -> DataFrame:
    """Raw events of system call documents; documents without any are dropped."""
    doc = documents.withColumn("_d", F.from_json(column, schemas.SYSCALL_DOCUMENT))
    kept = [c for c in documents.columns if c != column]
    rows = doc.filter(F.size("_d.raw_events") > 0).select(*kept, F.explode("_d.raw_events").alias("e"))
    return rows.select(*kept, "e.*")


def benchmark_jobs(documents: DataFrame, column: str = "value") -> DataFrame:
    rows = documents.select(F.explode(F.from_json(column, schemas.BENCHMARK).jobs).alias("j"))
    return rows.select(
        "j.jobname",
        F.coalesce("j.iodepth", F.lit(1)).alias("iodepth"),
        F.coalesce(F.col("j")["job options"]["bs"], F.lit("?")).alias("bs"),
        "j.read",
        "j.write",
    )


def page_monitor_blocks(documents: DataFrame, column: str = "value") -> DataFrame:
    """Blocks of page monitor documents: one row per snapshot and block."""
    doc = F.from_json(column, schemas.PAGE_MONITOR)
    rows = documents.select(doc.alias("d")).select("d.pid", "d.start", "d.mode", F.explode("d.snapshots").alias("s"))
    return rows.select(
        "pid", "start", "mode", "s.iter", "s.total_dirty", F.posexplode("s.blocks").alias("block", "dirty_pct")
    )


def geometries(documents: DataFrame, column: str = "value") -> DataFrame:
    """Device geometries; unknown keys are ignored, missing ones are 0."""
    kept = [c for c in documents.columns if c != column]
    rows = documents.select(*kept, F.from_json(column, schemas.GEOMETRY).alias("g"))
    return rows.select(*kept, "g.*").fillna(0).fillna("", ["device_name"])


def manifest_objects(documents: DataFrame, column: str = "value") -> DataFrame:
    """Objects of replay manifests with the device geometry, defaults filled in."""
    rows = documents.select(F.from_json(column, schemas.MANIFEST).alias("m"))
    rows = rows.select("m.device_geometry", F.explode("m.objects").alias("o"))
    # Geometry defaults.
    defaults = {"mdts_bytes": 131072, "block_align": 4096, "header_bytes": 4096}
    return rows.select(
        "o.*",
        *[F.coalesce(F.col(f"device_geometry.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()],
    )


# What a row of a page monitor document can hold.
MONITOR_ROW = {
    "item": "string", "iter": "bigint", "position": "bigint", "pages": "bigint", "present": "bigint", "dirty": "bigint", "dirty_kb": "bigint", "dirty_pct": "double", "detail": "string",
}


def _monitor_row(**given: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', cast({given.get(n, 'null')} as {kind})" for n, kind in MONITOR_ROW.items()) + ")"


def _inside(path: str, kind: str) -> str:
    return f"try_variant_get(v, '$.{path}', '{kind}')"


def monitor_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """All kinds of page monitor documents as rows: the other columns, ``kind``, ``pid`` and the columns of ``MONITOR_ROW``.

    A snapshot has one row (``detail``: a letter per page), soft-dirty tracking and a timeline one per sample, a heat map one per sample
    and block (``position``), a region scan one per file and, with ``iter``, one per tracked sample and file, and a scan unified by file
    one per file, sample and block. Other modes give a row of the kind ``other``, texts that are no JSON one of the kind ``bad``.
    Documents are read once, as variants; what they lack is null.
    """
    kept = [c for c in documents.columns if c != column]
    shots = "array<struct<iter:bigint,present:bigint,newly_dirty:bigint,dirty:bigint,dirty_kb:bigint,bitmap:string,blocks:array<double>>>"
    files = f"array<struct<pathname:string,total_pages:bigint,present:bigint,dirty:bigint,dirty_pct:double,snapshots:{shots}>>"
    tracking = "array<struct<iter:bigint,files:array<struct<path:string,dirty:bigint,dirty_kb:bigint>>>>"
    # A sample without its list has no rows; the others of its document stay.
    each = lambda values, row: f"coalesce(transform({values}, {row}), array())"
    blocks = lambda shot, **more: each(f"{shot}.blocks", f"(b, i) -> {_monitor_row(iter=f'{shot}.iter', position='i', dirty_pct='b', **more)}")
    region = _monitor_row(item="f.pathname", pages="f.total_pages", present="f.present", dirty="f.dirty", dirty_pct="f.dirty_pct")
    one = each("s.files", f"f -> {_monitor_row(item='f.path', iter='s.iter', dirty='f.dirty', dirty_kb='f.dirty_kb')}")
    tracked = f"flatten({each(_inside('tracking', tracking), f's -> {one}')})"
    soft = _monitor_row(item=_inside("start", "string"), iter="s.iter", present="s.present", dirty="s.newly_dirty", dirty_kb="s.dirty_kb", detail="s.bitmap")
    timed = _monitor_row(item=_inside("start", "string"), iter="s.iter", present="s.present", dirty="s.dirty", dirty_kb="s.dirty_kb")
    unified = blocks("s", item="f.pathname")
    single = _monitor_row(
        item=_inside("start", "string"), pages=_inside("total_pages", "bigint"), present=_inside("present", "bigint"), dirty=_inside("dirty", "bigint"),
        dirty_pct=_inside("dirty_pct", "double"), detail=_inside("pages", "string"),
    )
    kinds = {
        "snapshot": f"array({single})",
        "softdirty": f"transform({_inside('snapshots', shots)}, s -> {soft})",
        "heatmap": f"flatten({each(_inside('snapshots', shots), 's -> ' + blocks('s', item=_inside('start', 'string')))})",
        "timeline": f"transform({_inside('samples', shots)}, s -> {timed})",
        "region_all": f"concat({each(_inside('files', files), f'f -> {region}')}, {tracked})",
        "file_unified": f"flatten({each(_inside('files', files), 'f -> flatten(' + each('f.snapshots', f's -> {unified}') + ')')})",
    }
    kind = F.expr("case when v is null then 'bad' when {0} in ({1}) then {0} else 'other' end".format(_inside("mode", "string"), ", ".join(f"'{k}'" for k in kinds)))
    found = F.expr("case kind " + " ".join(f"when '{k}' then {rows}" for k, rows in kinds.items()) + " end")
    docs = documents.select(*kept, F.try_parse_json(column).alias("v")).withColumn("kind", kind)
    docs = docs.select(*kept, "kind", F.expr(_inside("pid", "bigint")).alias("pid"), found.alias("rows"))
    return docs.select(*kept, "kind", "pid", F.inline_outer("rows"))


def monitor_costs(documents: DataFrame, column: str = "value") -> DataFrame:
    """What each method of page monitoring costs: one row per measurement, from diffs within pages and from comparisons of methods."""
    cost = "label:string,wall_ms:double,cpu_pct:double,peak_rss_kb:bigint,bytes_read:bigint"
    diffs = _inside("snapshots", f"array<struct<total_changed_bytes:bigint,total_changed_pages:bigint,overhead:struct<{cost}>>>")
    runs = _inside("benchmarks", f"array<struct<{cost}>>")
    row = "named_struct('c', {}, 'changed_bytes', {}, 'changed_pages', {})"
    measured = F.expr(
        f"case {_inside('mode', 'string')} when 'sub_page_diff' then transform({diffs}, s -> {row.format('s.overhead', 's.total_changed_bytes', 's.total_changed_pages')})"
        f" when 'overhead_bench' then transform({runs}, b -> {row.format('b', 'cast(null as bigint)', 'cast(null as bigint)')}) end"
    )
    kept = [c for c in documents.columns if c != column]
    rows = documents.select(*kept, F.try_parse_json(column).alias("v")).select(*kept, F.inline(measured)).filter("c is not null")
    return rows.select(*kept, F.col("c.label").alias("method"), "c.wall_ms", "c.cpu_pct", "c.peak_rss_kb", "c.bytes_read", "changed_bytes", "changed_pages")
