"""Folds in Arrow batches over sorted partitions, with the state carried along."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from iotrail.operators.scan import split_on_gap


def assign_lanes(
    spans: DataFrame, keys: Sequence[str], begin: str, end: str, tie: Sequence[str]
) -> DataFrame:
    """First-fit lane per span: the lowest lane whose last span ended before ``begin``.

    Lanes all fall free where no span is open, so the spans are first split into
    islands and only an island is worked on in order. A task streams its sorted
    rows and holds one entry per lane in use, never a whole island.
    """
    keys = list(keys)
    order = [begin, end, *tie]
    cut = split_on_gap(spans, keys, order, begin, end)
    schema = T.StructType([*cut.schema.fields, T.StructField("lane", T.LongType())])
    by = [*keys, "island"]

    def lanes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free, busy, used = None, [], [], 0
        for batch in batches:
            out = []
            columns = [batch[c] for c in (*by, begin, end)]
            for *group, b, e in zip(*columns, strict=True):
                if group != current:
                    current, free, busy, used = group, [], [], 0
                while busy and busy[0][0] < b:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    lane = heapq.heappop(free)
                else:
                    lane, used = used, used + 1
                heapq.heappush(busy, (e, lane))
                out.append(lane)
            yield batch.assign(lane=out)

    sorted_rows = cut.repartition(*by).sortWithinPartitions(*by, *order)
    return sorted_rows.mapInPandas(lanes, schema).drop("island")
