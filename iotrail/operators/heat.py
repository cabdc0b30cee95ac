"""Decaying heat and moving-sum frequency per block, as folds that can be split.

The touches of one block in one sample are counted first, so a (block, part)
group holds at most ``PART`` rows however hot the block is. Each part is turned
into the function it applies to the state it starts from; the functions of a
block are then applied in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import frequency_digit, heat_digit, int_div

#: Samples per part.
PART = 4096
FULL = 10_000


def _per_sample(touches: DataFrame) -> DataFrame:
    counts = touches.groupBy("block", "sample").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("part", int_div(F.col("sample"), PART))


def heat(touches: DataFrame, decay: int, per_level: int, now: int, levels: int = 9) -> DataFrame:
    """Heat of each block at sample ``now``: every touch adds one point up to the
    cap, every sample takes ``decay`` points.

    A run of touches maps a state h to min(max(h + add, low), high), and such
    maps compose into one of the same kind.
    """
    cap = levels * per_level
    rows = F.sort_array(F.collect_list(F.struct("sample", "n")))

    def clamp(x: Column) -> Column:
        return F.greatest(x, F.lit(0).cast("long"))

    def touch(acc: Column, x: Column) -> Column:
        lost = (x["sample"] - acc["last"]) * decay
        return F.struct(
            (acc["add"] - lost + x["n"]).alias("add"),
            F.least(clamp(acc["low"] - lost) + x["n"], F.lit(cap)).alias("low"),
            F.least(clamp(acc["high"] - lost) + x["n"], F.lit(cap)).alias("high"),
            x["sample"].alias("last"),
        )

    first = F.col("rows")[0]["sample"]
    start = F.struct(
        F.lit(0).cast("long").alias("add"),
        F.lit(0).cast("long").alias("low"),
        F.lit(cap).cast("long").alias("high"),
        first.alias("last"),
    )
    parts = _per_sample(touches).groupBy("block", "part").agg(rows.alias("rows"))
    parts = parts.select("block", first.alias("first"), F.aggregate("rows", start, touch).alias("f"))

    def apply(acc: Column, x: Column) -> Column:
        before = clamp(acc["h"] - (x["first"] - acc["last"]) * decay)
        after = F.least(F.greatest(before + x["f"]["add"], x["f"]["low"]), x["f"]["high"])
        return F.struct(after.alias("h"), x["f"]["last"].alias("last"))

    zero = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("last"))
    steps = F.sort_array(F.collect_list(F.struct("first", "f")))
    state = parts.groupBy("block").agg(F.aggregate(steps, zero, apply).alias("s"))
    raw = clamp(F.col("s.h") - (F.lit(now) - F.col("s.last")) * decay)
    return state.select(
        "block", F.col("s.h").alias("points"), F.col("s.last").alias("last_sample"), heat_digit(raw, per_level).alias("digit")
    )


def fade(points: np.ndarray, idle: int, window: int, rate: int) -> np.ndarray:
    """Points left after ``idle`` samples without a touch."""
    if idle <= 0 or rate == 0:
        return points
    if idle * rate >= window:
        return np.zeros_like(points)
    for _ in range(idle):
        step = points // window * rate + points % window * rate // window
        points = np.where(step >= points, 0, points - step)
        if not points.any():
            break
    return points


def frequency(touches: DataFrame, window: int, now: int, rate: int = 1) -> DataFrame:
    """Moving-sum frequency of each block at sample ``now``, in points of 10,000.

    The first part of a block starts from nothing. A later part is evaluated for
    all 10,001 states it could start from, of which few stay distinct; the result
    is kept as the steps of a monotone function.
    """
    gain = FULL // window

    def run(points: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        back = np.arange(len(points))
        last = int(rows["sample"].iloc[0])
        for sample, n in zip(rows["sample"], rows["n"], strict=True):
            points = np.minimum(fade(points, int(sample) - last, window, rate) + gain * int(n), FULL)
            last = int(sample)
            if len(points) > 1:
                points, index = np.unique(points, return_inverse=True)
                back = index[back]
        return points, back

    def transfer(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sample")
        known = bool(rows["is_first"].iloc[0])
        points, back = run(np.zeros(1, dtype=np.int64) if known else np.arange(FULL + 1), rows)
        outcome = points[back]
        starts = np.flatnonzero(np.r_[True, outcome[1:] != outcome[:-1]])
        return pd.DataFrame(
            {
                "block": [rows["block"].iloc[0]],
                "first": [rows["sample"].iloc[0]],
                "last": [rows["sample"].iloc[-1]],
                "starts": [starts.tolist()],
                "values": [outcome[starts].tolist()],
            }
        )

    counts = _per_sample(touches)
    opening = counts.groupBy("block").agg(F.min("part").alias("_first"))
    rows = counts.join(opening, "block").withColumn("is_first", F.col("part") == F.col("_first"))
    kind = touches.schema["block"].dataType.simpleString()
    schema = f"block {kind}, first long, last long, starts array<long>, values array<long>"
    parts = rows.drop("_first").groupBy("block", "part").applyInPandas(transfer, schema)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        points, last = np.zeros(1, dtype=np.int64), 0
        for part in rows.sort_values("first").itertuples():
            points = fade(points, int(part.first) - last, window, rate)
            at = np.searchsorted(part.starts, points[0], side="right") - 1
            points, last = np.array([part.values[at]], dtype=np.int64), int(part.last)
        left = fade(points, now - last, window, rate)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "points": points, "left": left})

    state = parts.groupBy("block").applyInPandas(finish, f"block {kind}, points long, left long")
    return state.select("block", "points", frequency_digit(F.col("left")).cast("long").alias("digit"))


def zoom(blocks: DataFrame, factor: int, value: str = "digit") -> DataFrame:
    """Hottest child and number of live children per coarser block."""
    live = F.count(F.when(F.col(value) > 0, 1))
    coarse = int_div(F.col("block"), factor).alias("block")
    return blocks.groupBy(coarse).agg(F.max(value).alias(value), live.alias("hot"))
