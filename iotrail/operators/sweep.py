"""Which of many open windows counts at a point, found in one ordered sweep.

Windows enter the stream of their key at their begin; points ask. A window is only worth keeping while no better one lasts as long, so the
open windows of a kind form a staircase: the later the rank, the later the end. Staircases are the mergeable state that one part of
the stream hands to the next.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from iotrail.operators.scan import CHUNK, ROWS_PER_TASK, exceeds
from iotrail.session import pin

#: Before any position of a stream.
FIRST = -(1 << 63)


class Staircase:
    """The open windows of one kind that can still be the best: ranks and ends both rise."""

    def __init__(self) -> None:
        self.ranks: list[tuple] = []
        self.ends: list[int] = []
        self.values: list = []

    def enter(self, at: int, end: int, rank: tuple, value) -> None:
        over = bisect_right(self.ends, at)
        del self.ranks[:over], self.ends[:over], self.values[:over]
        i = bisect_left(self.ranks, rank)
        if i and self.ends[i - 1] >= end:
            return
        j = bisect_right(self.ends, end, i)
        self.ranks[i:j], self.ends[i:j], self.values[i:j] = [rank], [end], [value]

    def best(self, at: np.ndarray) -> list:
        """The value of the best window open at each position, None without one."""
        if not self.ends:
            return [None] * len(at)
        if len(at) < 64:
            places = [bisect_right(self.ends, t) for t in at.tolist()]
        else:
            places = np.searchsorted(np.array(self.ends), at, side="right").tolist()
        values, n = self.values, len(self.values)
        return [values[k] if k < n else None for k in places]


def _sweep(name: str, columns: Sequence[str], kind: pa.DataType):
    """Batches of a sorted stream -> its points with ``name``. Group columns come first in the stream; a new group starts from nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stairs, every = None, {}, Staircase()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cell = {c: batch.column(c) for c in ("_part", "_key", "_at", "_side")}
            part, at, point = cell["_part"].to_numpy(), cell["_at"].to_numpy(), cell["_side"].to_numpy() == 1
            keys = cell["_key"].to_numpy(zero_copy_only=False)
            new = np.r_[True, (part[1:] != part[:-1]) | (keys[1:] != keys[:-1])]
            ends, ranks, values = batch.column("_window").filter(pa.array(~point)).flatten()
            windows = zip(ends.to_pylist(), zip(*(r.to_pylist() for r in ranks.flatten()), strict=True), values.to_pylist(), strict=True)
            wants = batch.column("_kind").to_numpy(zero_copy_only=False)
            found: list = [None] * n
            stops = np.append(np.flatnonzero(new | ~point), n).tolist()
            for i, j in pairwise(stops):
                if new[i] and (here := (part[i], keys[i])) != group:
                    group, stairs, every = here, {}, Staircase()
                if not point[i]:
                    until, rank, value = next(windows)
                    entry = (int(at[i]), until, (*rank, value), value)
                    every.enter(*entry)
                    if wants[i] is not None:
                        stairs.setdefault(wants[i], Staircase()).enter(*entry)
                    i += 1
                if i == j:
                    continue
                run_at, run_wants = at[i:j], wants[i:j]
                out = every.best(run_at)
                for way, stair in stairs.items():
                    own = np.flatnonzero(run_wants == way)
                    for k, better in zip(own.tolist(), stair.best(run_at[own])):
                        out[k] = out[k] if better is None else better
                found[i:j] = out
            rows = batch.column("_row").filter(pa.array(point))
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(found, kind).filter(pa.array(point))], names=[*columns, name])

    return run


def best_open(
    points: DataFrame, windows: DataFrame, key: str, at: str, kind: str, begin: str, end: str, rank: Sequence[str], window_kind: str, value: str,
    chunked: bool | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``points`` with the ``value`` of the best window [begin, end) of their key that holds them.

    A window of the point's own kind goes before others, then the least rank, then the least value. Positions are integers, keys aren't
    null, a null kind matches none. Every point comes out once, repeated ones too; without an open window ``value`` is null.

    A key of up to ``rows_per_task`` rows is swept by one task. Beyond that (``chunked``, decided from the rows if None) the stream is split
    by key and position, and each part starts with the windows that earlier parts of its key leave open: a window comes in
    once for each later part that it reaches, unless a better one lasts as long.
    """
    order = F.struct(*(F.col(c) for c in rank)).alias("rank")
    entering = windows.filter(F.col(end) > F.col(begin)).select(
        F.col(key).alias("_key"), F.col(begin).cast("long").alias("_at"), F.lit(0).alias("_side"), F.col(window_kind).alias("_kind"),
        F.struct(F.col(end).cast("long").alias("end"), order, F.col(value).alias("value")).alias("_window"),
    )
    kept = [c for c in points.columns if c != value]
    asking = points.select(
        F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_side"), F.col(kind).alias("_kind"), F.struct(*kept).alias("_row")
    )
    events = entering.unionByName(asking, allowMissingColumns=True)
    if chunked is None:
        chunked = exceeds(events.select("_key"), ["_key"], rows_per_task)
    if chunked:
        events = events.withColumn("_mix", F.xxhash64("_window", "_row"))
        events = pin(events.repartitionByRange("_key", "_at", "_side", "_mix").withColumn(CHUNK, F.spark_partition_id()).drop("_mix"))
        parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        stream = events.unionByName(_left_open(events)).withColumnRenamed(CHUNK, "_part").repartitionById(parts, F.col("_part"))
    else:
        stream = events.repartition("_key").withColumn("_part", F.lit(0))
    stream = stream.sortWithinPartitions("_part", "_key", "_at", "_side")
    fields = [points.schema[c] for c in kept]
    out = T.StructField(value, windows.schema[value].dataType)
    return stream.mapInArrow(_sweep(value, kept, to_arrow_type(out.dataType)), T.StructType([*fields, out]))


def _left_open(events: DataFrame) -> DataFrame:
    """The windows that every part of a split stream starts with."""
    place = F.struct("_key", "_at")
    bounds = events.groupBy(CHUNK).agg(F.min(place).alias("lo"), F.max(place).alias("hi"))  # one row per part
    last = bounds.select(CHUNK, F.col("hi._key").alias("_key"), F.col("hi._at").alias("_until"))
    open_ = events.filter("_side = 0").join(F.broadcast(last), [CHUNK, "_key"]).filter("_window.end > _until").drop("_until")
    entry = bounds.select(F.col(CHUNK).alias("_to"), F.col("lo._key").alias("_key"), F.col("lo._at").alias("_from"))
    reach = (F.col("_to") > F.col(CHUNK)) & (F.col("_window.end") > F.col("_from"))
    listed = _undominated(open_, CHUNK).join(F.broadcast(entry), "_key").filter(reach).withColumn(CHUNK, F.col("_to")).drop("_to", "_from")
    return _undominated(listed, CHUNK).withColumn("_at", F.lit(FIRST)).select(*events.columns)


def _undominated(windows: DataFrame, part: str) -> DataFrame:
    """Without windows that a better one of their kind outlasts."""
    better: Column = F.struct("_window.rank", "_window.value")
    before = Window.partitionBy(part, "_key", "_kind").orderBy(better).rowsBetween(Window.unboundedPreceding, -1)
    reach = windows.withColumn("_reach", F.max("_window.end").over(before))
    return reach.filter(F.col("_reach").isNull() | (F.col("_window.end") > F.col("_reach"))).drop("_reach")
