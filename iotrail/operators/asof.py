"""As-of and range joins built from scans and equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.functions.scalar import int_div
from iotrail.operators import scan
from iotrail.operators.scan import LastSeen, Scan


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_on: str,
    right_on: str,
    take: dict[str, str],
    tie: Sequence[str] = (),
    forward: bool = False,
    chunked: bool | None = None,
) -> DataFrame:
    """Add to each left row the ``take`` columns (right name -> new name) of the
    latest right row at or before it (``forward``: the earliest at or after it).

    Both sides are put into one ordered stream, in which the last right row
    seen is carried forward. The position columns must be integers. Right rows
    that share a position are ordered by ``tie``; the last one wins.
    """
    sign = -1 if forward else 1
    right_tie = [F.col(c) for c in tie]
    # Columns of the left side stay columns, so that those nobody asks for later aren't shuffled; its position is kept once.
    held = [c for c in left.columns if c not in keys and c != left_on]
    rows_r = right.select(
        *keys,
        (F.col(right_on) * sign).alias("_at"),
        F.lit(0).alias("_side"),
        *[c.alias(f"_tie{i}") for i, c in enumerate(right_tie)],
        F.struct(*[F.col(c).alias(n) for c, n in take.items()]).alias("_hit"),
    )
    rows_l = left.select(*keys, (F.col(left_on) * sign).alias("_at"), F.lit(1).alias("_side"), *held)
    order = ["_at", "_side", *[f"_tie{i}" for i in range(len(right_tie))]]
    if chunked is None:
        sizes = rows_r.select(*keys).unionByName(rows_l.select(*keys))
        chunked = not keys or scan.exceeds(sizes, keys, scan.ROWS_PER_TASK)
    if chunked:
        # Left rows at one position are spread by a hash of what they hold, so that a hot position is no single chunk.
        rows_l = rows_l.withColumn("_mix", F.xxhash64(*(held or ["_at"])))
        order.append("_mix")
    both = rows_r.unionByName(rows_l, allowMissingColumns=True)
    seen = Scan(both, keys, order, chunked).add(LastSeen("_seen", F.col("_hit"))).df
    at = (F.col("_at") * sign).cast(left.schema[left_on].dataType).alias(left_on)
    columns = [at if c == left_on and c not in keys else c for c in left.columns]
    return seen.filter("_side = 1").select(*columns, *[f"_seen.{n}" for n in take.values()])


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    point: str,
    low: str,
    high: str,
    width: int,
    how: str = "inner",
) -> DataFrame:
    """Join points with the half-open ranges [low, high) that hold them.

    Each range is listed once per ``width``-sized cell it touches, so that the
    join is an equi-join on (keys, cell). ``width`` should be near the usual
    range length: then a range has few cells and a cell has few ranges.
    """
    cells = F.sequence(_cell(F.col(low), width), _cell(F.col(high) - 1, width))
    listed = ranges.filter(F.col(high) > F.col(low)).withColumn("_cell", F.explode(cells))
    placed = points.withColumn("_cell", _cell(F.col(point), width))
    p, r = placed.alias("p"), listed.alias("r")
    on = [F.col(f"p.{k}") == F.col(f"r.{k}") for k in keys]
    on += [
        F.col("p._cell") == F.col("r._cell"),
        F.col(f"p.{point}") >= F.col(f"r.{low}"),
        F.col(f"p.{point}") < F.col(f"r.{high}"),
    ]
    kept = [F.col(f"r.{c}") for c in ranges.columns if c not in points.columns]
    return p.join(r, on, how).select(*[F.col(f"p.{c}") for c in points.columns], *kept)


def _cell(value: Column, width: int) -> Column:
    return int_div(value, width)
