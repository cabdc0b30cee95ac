"""Ordered scans that stay parallel.

A window without keys, or with one key that holds a large share of the rows,
runs in a single task. ``Scan`` offers running sums, running extremes, the
previous and next row, the last value seen and clamped counters in two forms
behind one interface:

* keys whose largest group was measured to be small use a plain window;
* otherwise the rows are range-partitioned on (keys, order). The partition
  number is written with the rows, each partition ("chunk") is scanned on its
  own, one summary row per chunk and boundary key is scanned to get what the
  chunk inherits, and that carry is joined back and merged in.

The carry table has at most two rows per chunk, so its broadcast is bounded by
the number of partitions, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from iotrail.session import pin

#: A group up to this size may be sorted by one task.
ROWS_PER_TASK = 20_000_000

#: Rows that a task holds on average if keyed rows are dealt out for more than one step.
ROWS_PER_DEAL = 500_000

#: Rows per hash of the keys are counted first, before rows per key.
HASHES = 4096

CHUNK = "_chunk"


@dataclass
class Measure:
    """One output column of a scan; subclasses say how chunks combine."""

    name: str
    value: Column

    def first(self, rows: WindowSpec) -> dict[str, Column]:
        """Window columns within a chunk."""
        raise NotImplementedError

    def second(self, rows: WindowSpec) -> dict[str, Column]:
        """Window columns that build on those of ``first``."""
        return {}

    def total(self, order: Sequence[str]) -> dict[str, Column]:
        """What a whole chunk hands on."""
        raise NotImplementedError

    def carries(self, chunks: WindowSpec) -> list[dict[str, Column]]:
        """What a chunk inherits, in steps over the chunk totals."""
        raise NotImplementedError

    def result(self, carried: bool) -> Column:
        raise NotImplementedError

    #: Whether ``total`` reads columns of ``first`` or ``second``.
    total_needs_rows = False
    #: Whether rows and chunks are gone through from the last to the first.
    backward = False

    def _c(self, suffix: str) -> str:
        return f"_{self.name}_{suffix}"


def _upto(rows: WindowSpec, exclusive: bool) -> WindowSpec:
    return rows.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)


def _earlier(chunks: WindowSpec) -> WindowSpec:
    return chunks.rowsBetween(Window.unboundedPreceding, -1)


@dataclass
class RunningSum(Measure):
    exclusive: bool = False

    def first(self, rows):
        return {self._c("in"): F.sum(self.value).over(_upto(rows, self.exclusive))}

    def total(self, order):
        return {self._c("t"): F.sum(self.value)}

    def carries(self, chunks):
        return [{self._c("k"): F.sum(self._c("t")).over(_earlier(chunks))}]

    def result(self, carried):
        inner = F.coalesce(F.col(self._c("in")), F.lit(0))
        return inner + F.coalesce(F.col(self._c("k")), F.lit(0)) if carried else inner


@dataclass
class RunningMax(Measure):
    exclusive: bool = False

    def first(self, rows):
        return {self._c("in"): F.max(self.value).over(_upto(rows, self.exclusive))}

    def total(self, order):
        return {self._c("t"): F.max(self.value)}

    def carries(self, chunks):
        return [{self._c("k"): F.max(self._c("t")).over(_earlier(chunks))}]

    def result(self, carried):
        inner = F.col(self._c("in"))
        return F.greatest(inner, F.col(self._c("k"))) if carried else inner


@dataclass
class LastSeen(Measure):
    """The latest non-null value up to this row (or before it)."""

    exclusive: bool = False

    def first(self, rows):
        frame = _upto(rows, self.exclusive)
        return {self._c("in"): F.last(self.value, ignorenulls=True).over(frame)}

    def total(self, order):
        at = F.when(self.value.isNotNull(), F.struct(*order))
        return {self._c("t"): F.max_by(self.value, at)}

    def carries(self, chunks):
        return [{self._c("k"): F.last(self._c("t"), ignorenulls=True).over(_earlier(chunks))}]

    def result(self, carried):
        inner = F.col(self._c("in"))
        return F.coalesce(inner, F.col(self._c("k"))) if carried else inner


@dataclass
class NextSeen(LastSeen):
    """The earliest non-null value behind this row."""

    exclusive: bool = True
    backward = True

    def total(self, order):
        at = F.when(self.value.isNotNull(), F.struct(*order))
        return {self._c("t"): F.min_by(self.value, at)}


@dataclass
class Previous(Measure):
    """The value of the row before; null on the first row of a key."""

    def first(self, rows):
        return {self._c("in"): F.lag(F.struct(self.value.alias("v"))).over(rows)}

    def total(self, order):
        return {self._c("t"): F.max_by(F.struct(self.value.alias("v")), F.struct(*order))}

    def carries(self, chunks):
        return [{self._c("k"): F.lag(self._c("t")).over(chunks)}]

    def result(self, carried):
        inner = F.col(self._c("in"))
        return (F.coalesce(inner, F.col(self._c("k"))) if carried else inner).getField("v")


@dataclass
class Following(Measure):
    """The value of the row after; null on the last row of a key."""

    def first(self, rows):
        return {self._c("in"): F.lead(F.struct(self.value.alias("v"))).over(rows)}

    def total(self, order):
        return {self._c("t"): F.min_by(F.struct(self.value.alias("v")), F.struct(*order))}

    def carries(self, chunks):
        return [{self._c("k"): F.lead(self._c("t")).over(chunks)}]

    def result(self, carried):
        inner = F.col(self._c("in"))
        return (F.coalesce(inner, F.col(self._c("k"))) if carried else inner).getField("v")


@dataclass
class Clamped(Measure):
    """A counter that adds ``value`` per row and then never lies below ``floor``.

    With A the running sum of the steps, the state is A + max(0, max(floor - A))
    over the rows so far, which needs one running sum and one running maximum.
    """

    floor: Column | None = None
    total_needs_rows = True

    def _floor(self) -> Column:
        return F.lit(0) if self.floor is None else self.floor

    def first(self, rows):
        return {self._c("a"): F.sum(self.value).over(_upto(rows, False))}

    def second(self, rows):
        return {self._c("m"): F.max(self._floor() - F.col(self._c("a"))).over(_upto(rows, False))}

    def total(self, order):
        return {self._c("ta"): F.sum(self.value), self._c("tm"): F.max(self._c("m"))}

    def carries(self, chunks):
        before = F.coalesce(F.sum(self._c("ta")).over(_earlier(chunks)), F.lit(0))
        lifted = F.max(F.col(self._c("tm")) - F.col(self._c("ka"))).over(_earlier(chunks))
        return [{self._c("ka"): before}, {self._c("km"): lifted}]

    def result(self, carried):
        a, m = F.col(self._c("a")), F.col(self._c("m"))
        if carried:
            start = F.coalesce(F.col(self._c("ka")), F.lit(0))
            a, m = a + start, F.greatest(m - start, F.col(self._c("km")))
        return a + F.greatest(F.lit(0), m)


@dataclass
class ClampedBefore(Clamped):
    """What ``Clamped`` was before the row; 0 on the first row of a key."""

    def first(self, rows):
        return {**super().first(rows), self._c("b"): F.sum(self.value).over(_upto(rows, True))}

    def second(self, rows):
        return {**super().second(rows), self._c("n"): F.max(self._floor() - F.col(self._c("a"))).over(_upto(rows, True))}

    def result(self, carried):
        a, m = F.coalesce(F.col(self._c("b")), F.lit(0)), F.coalesce(F.col(self._c("n")), F.lit(0))
        if carried:
            start = F.coalesce(F.col(self._c("ka")), F.lit(0))
            a, m = a + start, F.greatest(F.col(self._c("n")) - start, F.col(self._c("km")))
        return a + F.greatest(F.lit(0), m)


class Scan:
    """A scan of ``df`` in the order of ``order``, restarted for each key.

    ``order`` names ascending columns that together form a total order.
    ``chunked`` forces (True) or forbids (False) the two-level form; by default
    a scan without keys is two-level, and a keyed one is if its largest key
    holds more than ``rows_per_task`` rows.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        chunked: bool | None = None,
        rows_per_task: int | None = None,
    ) -> None:
        self.keys, self.order = list(keys), list(order)
        if chunked is None:
            limit = ROWS_PER_TASK if rows_per_task is None else rows_per_task
            chunked = not self.keys or exceeds(df, self.keys, limit)
        self.chunked = chunked
        # Whether the rows so far are written, so that reading them twice is cheap.
        self._written = chunked
        if chunked:
            ranged = df.repartitionByRange(*self.keys, *self.order)
            df = pin(ranged.withColumn(CHUNK, F.spark_partition_id()))
        self._df = df

    def add(self, *measures: Measure) -> Scan:
        """Append one column per measure; later calls may use earlier columns."""
        parts = ([CHUNK] if self.chunked else []) + self.keys
        rows = Window.partitionBy(*parts).orderBy(*self.order)
        down = Window.partitionBy(*parts).orderBy(*map(F.desc, self.order))
        if self.chunked and not self._written:
            self._df = pin(self._df)
        kept = self._df.columns
        local = self._df
        if self.chunked and self._written:
            # Every chunk goes to the partition of its number; later windows and additions find it there.
            local = local.repartitionById(_partitions(local), F.col(CHUNK))
        self._written = False
        for step in ("first", "second"):
            columns: dict[str, Column] = {}
            for measure in measures:
                columns.update(getattr(measure, step)(down if measure.backward else rows))
            if columns:
                local = local.withColumns(columns)
        if self.chunked:
            if any(m.total_needs_rows for m in measures):
                # The totals and the result both need the window: run it once.
                local, self._written = pin(local), True
            local = self._with_carry(local, measures)
        results = [m.result(self.chunked).alias(m.name) for m in measures]
        self._df = local.select(*kept, *results)
        return self

    def _with_carry(self, local: DataFrame, measures: Sequence[Measure]) -> DataFrame:
        by = [CHUNK, *self.keys]
        # Most totals are plain aggregates, which need no window of their own.
        edge_rows = local if any(m.total_needs_rows for m in measures) else self._df
        if self.keys:
            # Only the first and the last key of a chunk can reach into another.
            whole = F.struct(*self.keys)
            ends = self._df.groupBy(CHUNK).agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
            edges = ends.select(CHUNK, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e"))
            edges = edges.select(CHUNK, *[F.col(f"e.{k}").alias(k) for k in self.keys])
            edge_rows = _null_safe_join(edge_rows, edges, by, "left_semi")
        totals: dict[str, Column] = {}
        for measure in measures:
            totals.update(measure.total(self.order))
        carry = edge_rows.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
        by_keys = Window.partitionBy(*(self.keys or [F.lit(0)]))
        chunks, down = by_keys.orderBy(CHUNK), by_keys.orderBy(F.desc(CHUNK))
        names: list[str] = []
        depth = max(len(m.carries(chunks)) for m in measures)
        for step in range(depth):
            columns: dict[str, Column] = {}
            for measure in measures:
                steps = measure.carries(down if measure.backward else chunks)
                if step < len(steps):
                    columns.update(steps[step])
            names += columns
            carry = carry.withColumns(columns)
        return _null_safe_join(local, carry.select(*by, *names), by, "left")

    @property
    def df(self) -> DataFrame:
        return self._df.drop(CHUNK)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _null_safe_join(rows: DataFrame, small: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Join with at most two rows per chunk on ``by``; a null key is a key like any other."""
    marked = small.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in small.columns if c not in by]
    )
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    out = rows.join(F.broadcast(marked), same, how)
    return out.drop(*[f"_by_{c}" for c in by])


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """``df`` by hash of ``keys``, in as many tasks as ``rows`` (those of ``df`` by default) need, so that a task's share doesn't grow.

    Groups and windows whose keys include ``keys`` then need no other exchange.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(_partitions(df), -(-rows // ROWS_PER_DEAL)), *keys)


def exceeds(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """Whether a key has more than ``limit`` rows. Keys are counted only if that many rows share one of ``HASHES`` hashes."""
    shared = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(HASHES)).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return (shared.agg(F.max("n")).first()[0] or 0) > limit and largest_group(df, keys) > limit


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key: one small number to the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts: Column,
    name: str = "island",
    chunked: bool | None = None,
) -> DataFrame:
    """Number the runs of rows; ``starts`` is true on the first row of a run.

    ``starts`` must not depend on other rows; see ``split_on_gap``.
    """
    step = Scan(df, keys, order, chunked).add(RunningSum(name, F.when(starts, 1).otherwise(0)))
    return step.df


def split_on_gap(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    begin: str,
    end: str,
    gap: int = 0,
    name: str = "island",
    chunked: bool | None = None,
) -> DataFrame:
    """Number runs of intervals; a run ends where all earlier ends + gap < begin."""
    scan = Scan(df, keys, order, chunked)
    scan.add(RunningMax("_reach", F.col(end), exclusive=True))
    opens = F.col("_reach").isNull() | (F.col(begin) > F.col("_reach") + F.lit(gap))
    scan.add(RunningSum(name, F.when(opens, 1).otherwise(0)))
    return scan.df.drop("_reach")
