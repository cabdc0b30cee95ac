"""Page state analyses: residency, soft-dirty tracking, file heat, byte diffs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrail.functions.scalar import int_div, page_letter, page_state
from iotrail.operators.blocks import count_if
from iotrail.operators.scan import Previous, RunningSum, Scan, split_on_gap

PAGE = 4096


def decoded(pages: DataFrame) -> DataFrame:
    return pages.withColumns(page_state(F.col("entry")))


def snapshot(pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals and shares of page states; the dirty share is of the present pages."""
    n, present = F.count(F.lit(1)), count_if(F.col("present"))
    dirty = count_if(F.col("soft_dirty"))
    return pages.groupBy(*by).agg(
        n.alias("pages"),
        present.alias("present"),
        dirty.alias("dirty"),
        count_if(F.col("swapped")).alias("swapped"),
        count_if(F.col("file_mapped")).alias("file_mapped"),
        (present * 100 / n).alias("resident_pct"),
        F.coalesce(F.try_divide(dirty * 100, present), F.lit(0.0)).alias("dirty_pct"),
    )


def letters(pages: DataFrame, by: Sequence[str], stripe: int = 1024) -> DataFrame:
    """One string of page letters per stripe of consecutive pages."""
    mark = page_letter(F.col("present"), F.col("swapped"), F.col("soft_dirty"), F.col("file_mapped"))
    # A number of page and letter takes less room in a list than a struct, and is sorted faster.
    entry = F.shiftleft("page_idx", 7) + F.ascii(mark)
    rows = pages.withColumns({"entry": entry, "stripe": int_div(F.col("page_idx"), stripe)})
    strings = rows.groupBy(*by, "stripe").agg(F.sort_array(F.collect_list("entry")).alias("e"))
    letter = F.transform("e", lambda e: F.char(e.bitwiseAND(F.lit(127).cast("long"))))
    return strings.select(*by, "stripe", F.array_join(letter, "").alias("letters"))


def dirty_iterations(pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Newly dirty pages per iteration with the range they span."""
    dirty = F.when(F.col("soft_dirty"), F.col("page_idx"))
    return pages.groupBy(*by).agg(
        F.count(dirty).alias("newly_dirty"),
        (F.min(dirty) * PAGE).alias("first_offset"),
        (F.max(dirty) * PAGE).alias("last_offset"),
        ((F.max(dirty) - F.min(dirty) + 1) * PAGE).alias("span_bytes"),
    )


def density(pages: DataFrame, by: Sequence[str], pages_per_block: int) -> DataFrame:
    """Whole-percent share of dirty pages per block."""
    block = int_div(F.col("page_idx"), pages_per_block).alias("block")
    n, dirty = F.count(F.lit(1)), count_if(F.col("soft_dirty"))
    return pages.groupBy(*by, block).agg(
        n.alias("pages"),
        dirty.alias("dirty"),
        int_div(dirty * 100, n).alias("dirty_pct"),
    )


def dirty_rate(pages: DataFrame, by: Sequence[str], interval_ms: int) -> DataFrame:
    kb = count_if(F.col("soft_dirty")) * (PAGE // 1024)
    return pages.groupBy(*by, "iter").agg(
        count_if(F.col("soft_dirty")).alias("dirty"),
        kb.alias("dirty_kb"),
        (kb * 1000 / interval_ms).alias("kb_per_s"),
    )


def method_comparison(costs: DataFrame) -> DataFrame:
    """Mean and peak cost of each method of page monitoring, and what it found; null costs don't count."""
    return costs.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("wall_ms").alias("avg_wall_ms"),
        F.max("wall_ms").alias("peak_wall_ms"),
        F.avg("cpu_pct").alias("avg_cpu_pct"),
        F.max("peak_rss_kb").alias("peak_rss_kb"),
        F.avg("bytes_read").alias("avg_bytes_read"),
        F.sum("changed_bytes").alias("changed_bytes"),
        F.sum("changed_pages").alias("changed_pages"),
    )


def file_groups(vma: DataFrame) -> DataFrame:
    size = F.col("end_addr") - F.col("start_addr")
    return vma.groupBy("pathname").agg(
        F.count(F.lit(1)).alias("n_vmas"),
        int_div(F.sum(size), 1024).alias("mapped_kb"),
        F.min("file_offset").alias("offset_min"),
        F.max(F.col("file_offset") + size).alias("offset_max"),
    )


def coalesced(vma: DataFrame) -> DataFrame:
    """Overlapping or adjacent file ranges merged per file."""
    size = F.col("end_addr") - F.col("start_addr")
    rows = vma.select(
        "pathname",
        "file_offset",
        (-size).alias("_size"),
        "start_addr",
        (F.col("file_offset") + size).alias("file_end"),
    )
    order = ["file_offset", "_size", "start_addr"]
    cut = split_on_gap(rows, ["pathname"], order, "file_offset", "file_end")
    return cut.groupBy("pathname", "island").agg(
        F.min("file_offset").alias("range_start"),
        F.max("file_end").alias("range_end"),
        F.count(F.lit(1)).alias("n_vmas"),
    )


def numbered(vma: DataFrame, name: str = "place") -> DataFrame:
    """Mappings with their place by file offset, larger ones first, then by address."""
    order = ["file_offset", "_size", "start_addr"]
    rows = vma.withColumn("_size", F.col("start_addr") - F.col("end_addr"))
    return Scan(rows, [], order).add(RunningSum(name, F.lit(1))).df.drop("_size")


def file_pages(pages: DataFrame) -> DataFrame:
    """Each file page once per iteration, as the first mapping that shows it has it.

    Mappings come by ``place``, see ``numbered``. Place and state make one
    number, so that the first one is the least: pages are hashed, not sorted.
    """
    at = int_div(F.col("file_offset"), PAGE) + F.col("page_idx")
    flags = ("present", "soft_dirty", "swapped", "file_mapped")
    number = F.col("place").cast("long") * (1 << len(flags))
    for k, flag in enumerate(flags):
        number = number + F.when(F.col(flag), F.lit(1 << k)).otherwise(F.lit(0))
    rows = pages.groupBy("iter", "pathname", at.alias("page_idx")).agg(F.min(number).alias("_first"))
    states = [(F.col("_first").bitwiseAND(F.lit(1 << k)) != 0).alias(flag) for k, flag in enumerate(flags)]
    return rows.select("iter", "pathname", "page_idx", *states)


def hottest_window(blocks: DataFrame, by: Sequence[str], value: str = "dirty_pct") -> DataFrame:
    """Start of the window with the largest sum: an eighth of the blocks, at least 4.

    Blocks are numbered from 0 without holes. Groups without a positive sum give
    no row; of equal windows the first one wins.
    """
    by = list(by)
    scan = Scan(blocks, by, ["block"]).add(RunningSum("_upto", F.col(value)))
    if scan.chunked:
        sizes = blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        rows = scan.df.hint("merge").join(sizes, by)
    else:
        rows = scan.df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    rows = rows.withColumn("_w", F.greatest(F.lit(4).cast("long"), int_div(F.col("_n"), 8)))
    # A block ends one window and starts another; both meet at the window's last block, without a join.
    none = F.lit(None)
    ends = F.struct(F.col("block").alias("_end"), F.col("_upto").alias("_through"), none.alias("_before"), none.alias("block"), "_w")
    before = F.col("_upto") - F.col(value)
    starts = F.struct((F.col("block") + F.col("_w") - 1).alias("_end"), none.alias("_through"), before.alias("_before"), "block", "_w")
    marks = rows.select(*by, F.explode(F.array(ends, starts)).alias("m")).select(*by, "m.*")
    full = marks.groupBy(*by, "_end").agg(*[F.max(c).alias(c) for c in ("_through", "_before", "block", "_w")])
    total = F.col("_through") - F.col("_before")
    best = full.withColumn("window_sum", total).filter("window_sum > 0")
    pick = F.struct(F.col("window_sum"), -F.col("block"))
    out = best.groupBy(*by).agg(F.max_by(F.struct("block", "_w", "window_sum"), pick).alias("b"))
    return out.select(
        *by, F.col("b.block").alias("start_block"), F.col("b._w").alias("window"), F.col("b.window_sum").alias("window_sum")
    )


def largest_file_mapping(vma: DataFrame) -> DataFrame:
    """Largest mapping of the file with the most mapped bytes, per process."""
    size = F.col("end_addr") - F.col("start_addr")
    per_file = vma.groupBy("pid", "pathname").agg(
        F.sum(size).alias("total"),
        F.max_by("start_addr", F.struct(size, -F.col("start_addr"))).alias("start_addr"),
        F.max(size).alias("vma_bytes"),
    )
    # The path settles ties.
    best = F.min_by(F.struct("pathname", "total", "start_addr", "vma_bytes"), F.struct(-F.col("total"), "pathname"))
    return per_file.groupBy("pid").agg(best.alias("b")).select("pid", "b.*")


def binary_pages(contents: DataFrame, key: str, value: str) -> DataFrame:
    """Contents cut into pages: (key, page_idx, content)."""
    n = F.greatest(int_div(F.octet_length(value) + (PAGE - 1), PAGE), F.lit(1)).cast("int")
    rows = contents.select(key, F.col(value).cast("binary").alias("_b"), n.alias("_n"))
    rows = rows.select(key, "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("page_idx"))
    cut = F.substring(F.col("_b"), F.col("page_idx") * PAGE + 1, F.lit(PAGE))
    return rows.select(key, "page_idx", cut.alias("content"))


def _portions(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches cut up: a page may list hundreds of blocks and bytes, so the lists of a few pages are held at a time."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def page_diff(pages: DataFrame, keys: Sequence[str], block: int, detail_up_to: int = 64) -> DataFrame:
    """Changed bytes per page and per sub-block between ``before`` and ``after``.

    Pages without changes are dropped. ``details`` lists (offset, old, new) for
    pages with at most ``detail_up_to`` changes, and ``detailed`` tells for which;
    ``page_changes`` lists all. Only dirty pages should be given.
    """
    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    schema += (
        ", changed_bytes long, changed_words long, blocks array<struct<block:int,changed:int>>"
        ", details array<struct<offset:int,old:int,new:int>>, detailed boolean"
    )
    names = list(keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _portions(batches):
            out = []
            for row in batch.itertuples(index=False):
                a = np.frombuffer(row.before, dtype=np.uint8)
                b = np.frombuffer(row.after, dtype=np.uint8)
                at = np.flatnonzero(a != b)
                if not at.size:
                    continue
                spots, counts = np.unique(at // block, return_counts=True)
                detailed = at.size <= detail_up_to
                few = at if detailed else at[:0]
                out.append(
                    (
                        *[getattr(row, k) for k in names],
                        at.size,
                        np.unique(at // 8).size,
                        [{"block": int(s), "changed": int(c)} for s, c in zip(spots, counts, strict=True)],
                        [{"offset": int(i), "old": int(a[i]), "new": int(b[i])} for i in few],
                        detailed,
                    )
                )
            yield pd.DataFrame(out, columns=[*names, "changed_bytes", "changed_words", "blocks", "details", "detailed"])

    return pages.select(*names, "before", "after").mapInPandas(compare, schema)


def page_changes(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, offset, old, new) of every byte that differs between ``before`` and ``after``."""
    every = page_diff(pages, keys, PAGE, detail_up_to=PAGE)
    return every.select(*keys, F.explode("details").alias("d")).select(*keys, "d.*")


def rolling_changes(samples: DataFrame, keys: Sequence[str], order: Sequence[str], content: str = "content") -> DataFrame:
    """(keys, order, offset, old, new) of every byte of a page that differs from what the page held when it was last sampled.

    ``samples`` has the pages that were dirty, each with its content. The baseline
    rolls forward: a page is compared with its own latest sample, however long ago,
    and its first one is compared with nothing. A byte that one side lacks is 0.
    """
    chained = Scan(samples.select(*keys, *order, F.col(content).alias("after")), keys, order)
    pairs = chained.add(Previous("before", F.col("after"))).df.filter("before IS NOT NULL AND after IS NOT NULL AND before <> after")
    names = [*keys, *order]
    fields = [samples.schema[n] for n in names] + [T.StructField(n, T.IntegerType()) for n in ("offset", "old", "new")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sides = [part.column(part.schema.get_field_index(n)).to_pylist() for n in ("before", "after")]
                width = max(len(p) for side in sides for p in side)
                old, new = (np.frombuffer(b"".join(p.ljust(width, b"\0") for p in side), np.uint8).reshape(-1, width) for side in sides)
                row, offset = np.nonzero(old != new)
                taken = pa.array(row)
                columns = [part.column(part.schema.get_field_index(n)).take(taken) for n in names]
                numbers = [pa.array(x.astype(np.int32)) for x in (offset, old[row, offset], new[row, offset])]
                yield pa.RecordBatch.from_arrays([*columns, *numbers], names=[f.name for f in fields])

    return pairs.select(*names, "before", "after").mapInArrow(compare, T.StructType(fields))
