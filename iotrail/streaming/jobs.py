"""Streaming forms of the analyses, over growing folders of traces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType

from iotrail.functions.scalar import floor_log2
from iotrail.operators.asof import asof_join
from iotrail.operators.blocks import count_if
from iotrail.operators.heat import FULL, fade
from iotrail.session import scratch
from iotrail.sources.records import CORRUPT


def tail(
    spark: SparkSession,
    folder: str,
    schema: str,
    kind: str = "json",
    files_per_batch: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """New files of a folder as a stream; cut-off JSON lines stay in ``_corrupt``."""
    reader = spark.readStream.format(kind)
    if kind == "json":
        schema = f"{schema}, {CORRUPT} string"
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.schema(schema).load(folder)


#: The time of the row that closes a stream; nothing recorded is that late.
CLOSING = "2250-01-01 00:00:00"


def closable(events: DataFrame, time: str) -> tuple[DataFrame, Callable[[], None]]:
    """``events`` and a function that ends them: what still waits for the watermark then comes out.

    The function adds one row with nothing but a very late time, which moves the watermark past all windows and timeouts; its own window
    stays open. Call it when nothing will follow, between two runs of the same query (see ``run_available``).
    """
    spark, folder = events.sparkSession, scratch(events.sparkSession, "closing")
    spark.createDataFrame([], events.schema).write.parquet(folder)
    nullable = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    late = spark.readStream.schema(nullable).parquet(folder)

    def close() -> None:
        columns = [F.lit(CLOSING if f.name == time else None).cast(f.dataType).alias(f.name) for f in events.schema.fields]
        spark.range(1).select(*columns).write.mode("append").parquet(folder)

    return events.unionByName(late), close


def event_time(ts_ns: Column) -> Column:
    return F.timestamp_micros((ts_ns / 1000).cast("bigint"))


def tumbling_status(
    events: DataFrame, time: str, width: str, delay: str, by: Sequence[str] = (), slide: str | None = None
) -> DataFrame:
    """Events and bytes per window; rows later than ``delay`` are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = events.withWatermark(time, delay).groupBy(window.alias("w"), *by)
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "bytes")


def activity_sessions(events: DataFrame, time: str, gap: str, delay: str, by: Sequence[str]) -> DataFrame:
    """Runs of activity that an idle gap ends."""
    session = F.session_window(time, gap).alias("w")
    out = events.withWatermark(time, delay).groupBy(session, *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def live_histogram(events: DataFrame, value: str, by: str) -> DataFrame:
    """Counts per log2 bucket; at most 32 rows per group are kept as state."""
    bucket = floor_log2(F.col(value), 31).alias("bucket")
    return events.groupBy(by, bucket).agg(F.count(F.lit(1)).alias("n"))


CLOSING_MS = int(pd.Timestamp(CLOSING, tz="UTC").timestamp() * 1000) - 366 * 86_400_000


def paired(
    events: DataFrame, keys: Sequence[str], time: str, delay: str, timeout_ns: int
) -> DataFrame:
    """Start and end events paired under a key, with expiry of unanswered starts.

    Needs ``is_start`` and ``ts_ns``. A later start replaces an open one and an
    end without a start is dropped. A start that is still open when the watermark
    is ``timeout_ns`` past it gives a row with outcome expired; one that is open
    when the stream is closed (see ``closable``), with outcome open.

    Events may come in any order within ``delay``: they are kept as state until the
    watermark has passed them, and settled in the order of their times. Rows of a key
    are sorted and compared with their neighbours as arrays.
    """
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    key_schema = ", ".join(f"{k} {fields[k]}" for k in keys)
    output = f"{key_schema}, outcome string, start_ns bigint, end_ns bigint"

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        opened, times, kinds = state.get if state.exists else (None, [], [])
        ts, starts = [np.array(times, "int64")], [np.array(kinds, bool)]
        for batch in () if state.hasTimedOut else batches:
            rows = batch[["ts_ns", "is_start"]].dropna()
            ts.append(rows["ts_ns"].to_numpy("int64"))
            starts.append(rows["is_start"].to_numpy(bool))
        ts, starts = np.concatenate(ts), np.concatenate(starts)
        order = np.lexsort((starts, ts))
        ts, starts = ts[order], starts[order]
        # What the watermark has passed is complete.
        n = int(np.searchsorted(ts // 1_000_000, mark))
        left, left_starts = ts[n:], starts[n:]
        ts, starts = ts[:n], starts[:n]
        if opened is not None:
            ts, starts = np.append(np.int64(opened), ts), np.append(True, starts)
        # A start is over at the next event of its key: too late for it, an end that pairs, or another start that replaces it.
        late = ts[1:] - ts[:-1] > timeout_ns
        over = starts[:-1] & (late | ~starts[1:])
        end = pd.array(ts[1:][over], "Int64")
        end[late[over]] = None
        found = pd.DataFrame({"outcome": np.where(late[over], "expired", "paired"), "start_ns": pd.array(ts[:-1][over], "Int64"), "end_ns": end})
        opened = int(ts[-1]) if len(ts) and starts[-1] else None
        due = None if opened is None else (opened + timeout_ns) // 1_000_000
        if due is not None and due < mark:
            last = pd.DataFrame({"outcome": ["open" if mark > CLOSING_MS else "expired"], "start_ns": pd.array([opened], "Int64"), "end_ns": pd.array([None], "Int64")})
            found, opened, due = pd.concat([found, last]) if len(found) else last, None, None
        if opened is None and not len(left):
            if state.exists:
                state.remove()
        else:
            state.update((opened, left.tolist(), left_starts.tolist()))
            wake = [x for x in (due, int(left[0]) // 1_000_000 if len(left) else None) if x is not None]
            state.setTimeoutTimestamp(max(min(wake), mark + 1))
        if len(found):
            for name, value in reversed(list(zip(keys, key, strict=True))):
                found.insert(0, name, [value] * len(found))
            yield found

    slim = events.withWatermark(time, delay).select(*keys, time, "ts_ns", "is_start")
    return slim.groupBy(*keys).applyInPandasWithState(
        step, output, "opened bigint, ts array<bigint>, starts array<boolean>", "append", GroupStateTimeout.EventTimeTimeout
    )


#: How many requests may be open at once.
MAX_OPEN = 262_144

#: Events that are Python objects at once; all others wait as columns.
EVENTS_AT_ONCE = 10_000


class BoundedPairs(StatefulProcessor):
    """Pairs of one group of keys with a bounded number of open starts.

    Events wait until the watermark has passed them and are then taken in the order of their times (ends first at one time, then by
    key). The open starts are kept in the order of their age, so the first ones expire, and the first one is evicted when one more
    than ``cap`` is open. Waiting events are Arrow tables, in memory and as state, as one micro-batch may bring very many.
    """

    def __init__(self, group: str, key: str, kinds: tuple[str, str], timeout_ns: int, cap: int, key_type: DataType):
        self.group, self.key, self.kinds, self.timeout, self.cap = group, key, kinds, timeout_ns, cap
        self.schema = pa.schema([("key", to_arrow_type(key_type)), ("ts_ns", pa.int64()), ("is_start", pa.bool_())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", f"key {self.kinds[1]}, ts bigint")
        self.waiting = handle.getListState("waiting", "events binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: list[pa.Table] = []
        for batch in rows:
            full = batch[[self.key, "ts_ns", "is_start"]].dropna()
            columns = [full[self.key], full["ts_ns"].astype("int64"), full["is_start"].astype(bool)]
            new.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema))
        yield from self.settle(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, [], timerValues.getCurrentWatermarkInMs())

    def settle(self, group: tuple, new: list[pa.Table], mark: int) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(events).read_all() for (events,) in self.waiting.get()]
        rows = pa.concat_tables([self.schema.empty_table(), *held, *new])
        rows = rows.sort_by([(name, "ascending") for name in ("ts_ns", "is_start", "key")])
        n = int(np.searchsorted(rows["ts_ns"].to_numpy(), min(mark * 1_000_000, 2**63 - 1)))
        begun = dict(map(tuple, self.open.get()))  # key -> time of its start, the oldest first
        out: list[tuple] = []

        def drop_first(outcome: str) -> None:
            key = next(iter(begun))
            out.append((key, outcome, begun.pop(key), None))

        for batch in rows.slice(0, n).to_batches(max_chunksize=EVENTS_AT_ONCE):
            for key, ts, is_start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while begun and next(iter(begun.values())) + self.timeout < ts:
                    drop_first("expired")
                before = begun.pop(key, None)
                if is_start:
                    begun[key] = ts
                    while len(begun) > self.cap:
                        drop_first("evicted")
                elif before is not None:
                    out.append((key, "paired", before, ts))
            if out:
                yield self.emitted(group, out)
                out.clear()
        due = lambda: (next(iter(begun.values())) + self.timeout) // 1_000_000
        while begun and due() < mark:
            drop_first("open" if mark > CLOSING_MS else "expired")
        self.open.put(list(begun.items())) if begun else self.open.clear()
        self.waiting.clear()
        for batch in rows.slice(n).to_batches(max_chunksize=EVENTS_AT_ONCE):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as stream:
                stream.write_batch(batch)
            self.waiting.appendValue((sink.getvalue().to_pybytes(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        wake = [*([due()] if begun else []), *([rows["ts_ns"][n].as_py() // 1_000_000] if n < len(rows) else [])]
        if wake:
            self.handle.registerTimer(max(min(wake), mark) + 1)
        if out:
            yield self.emitted(group, out)

    def emitted(self, group: tuple, out: list[tuple]) -> pd.DataFrame:
        keys, outcomes, begins, ends = map(list, zip(*out, strict=True))
        # Integers all the way: nanoseconds don't fit the floats that a list with nulls would turn into.
        times = {"start_ns": pd.array(begins, "Int64"), "end_ns": pd.array(ends, "Int64")}
        return pd.DataFrame({self.group: [group[0]] * len(out), self.key: keys, "outcome": outcomes, **times})

    def close(self) -> None:
        pass


def bounded_pairs(events: DataFrame, group: str, key: str, time: str, delay: str, timeout_ns: int, cap: int = MAX_OPEN) -> DataFrame:
    """``paired`` with at most ``cap`` open starts in a group (such as a device or a hash of the key); the oldest ones beyond it are evicted.

    Outcomes are paired, expired, evicted and open. Needs the state store of ``ROCKSDB``, see ``run_available``. A group of keys is one
    task's work, and holds ``cap`` open starts and the events that the watermark hasn't passed; spread hot groups by a hash of the key.
    """
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    slim = events.withWatermark(time, delay).select(group, key, time, "ts_ns", "is_start")
    return slim.groupBy(group).transformWithStateInPandas(
        BoundedPairs(group, key, (fields[group], fields[key]), timeout_ns, cap, events.schema[key].dataType),
        f"{group} {fields[group]}, {key} {fields[key]}, outcome string, start_ns bigint, end_ns bigint", "append", "EventTime",
    )


#: The state store that lists and timers need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: A sample as an event time: a second each, from the second day on, as a row at the watermark's first value, 0, counts as late.
SAMPLE_TIME = "sample_time"
SAMPLE_ZERO = 86_400


def with_sample_time(touches: DataFrame) -> DataFrame:
    return touches.withColumn(SAMPLE_TIME, F.timestamp_seconds(F.col("sample") + SAMPLE_ZERO))


def _touched(touches: DataFrame, lateness: int, advance: Callable[[int, int, int], int]) -> DataFrame:
    """Points and last sample of each touched block, as the watermark passes its samples.

    ``advance(points, idle, n)`` gives the points after ``idle`` samples without and one with ``n`` touches. A touch may be ``lateness``
    samples behind the latest one seen; it waits as state until no earlier one can come, so the order of arrival doesn't matter.
    Touches that are later are dropped. Needs ``sample_time`` (see ``with_sample_time``).
    """
    kind = touches.schema["block"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        points, last, samples, counts = state.get if state.exists else (0, 0, [], [])
        waiting = Counter(dict(zip(samples, counts, strict=True)))
        for batch in () if state.hasTimedOut else batches:
            waiting.update(batch["sample"].dropna().astype("int64").tolist())
        ready = sorted(s for s in waiting if (s + SAMPLE_ZERO) * 1000 < mark)
        for sample in ready:
            points, last = advance(points, sample - last, waiting.pop(sample)), sample
        samples = sorted(waiting)
        state.update((points, last, samples, [waiting[s] for s in samples]))
        if samples:
            state.setTimeoutTimestamp(max((samples[0] + SAMPLE_ZERO) * 1000, mark + 1))
        if ready:
            yield pd.DataFrame({"block": [key[0]], "points": [points], "last_sample": [last]})

    slim = touches.withWatermark(SAMPLE_TIME, f"{lateness} seconds").select("block", "sample", SAMPLE_TIME)
    return slim.groupBy("block").applyInPandasWithState(
        step, f"block {kind}, points bigint, last_sample bigint", "points bigint, last bigint, samples array<bigint>, counts array<bigint>",
        "update", GroupStateTimeout.EventTimeTimeout,
    )


def block_heat(touches: DataFrame, decay: int, cap: int, lateness: int = 0) -> DataFrame:
    """Heat of each block: every touch adds a point up to ``cap``, every sample takes ``decay`` points."""
    return _touched(touches, lateness, lambda points, idle, n: min(max(points - decay * idle, 0) + n, cap))


def block_frequency(touches: DataFrame, window: int, rate: int = 1, lateness: int = 0) -> DataFrame:
    """Moving-sum frequency of each block in points of 10,000, see ``operators.heat.frequency``."""
    gain = FULL // window

    def advance(points: int, idle: int, n: int) -> int:
        return min(int(fade(np.array([points], dtype=np.int64), idle, window, rate)[0]) + gain * n, FULL)

    return _touched(touches, lateness, advance)


def counted_losses(capture: DataFrame, name: str = "losses") -> DataFrame:
    """Attach counters of rows, corrupt lines and reported drops to a stream."""
    return capture.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col(CORRUPT).isNotNull()).alias("corrupt"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"),
    )


def wall_clock(records: DataFrame, anchors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Wall-clock time of monotonic records from the latest anchor at or before them."""
    take = {"monotonic_ns": "_m", "realtime_ns": "_r"}
    rows = asof_join(records, anchors, keys, "ts_ns", "monotonic_ns", take, tie=["realtime_ns"])
    return rows.withColumn("wall_ns", F.col("ts_ns") + F.col("_r") - F.col("_m")).drop("_m", "_r")


def run_available(
    stream: DataFrame, mode: str = "append", name: str = "stream", close: Callable[[], None] | None = None, conf: dict[str, str] | None = None
) -> DataFrame:
    """Process what is there and return the emitted rows, written as Parquet.

    ``conf`` holds while the stream runs.

    With ``close`` (see ``closable``) the stream then ends, and what was left open is emitted, too.

    In update mode a row may be emitted several times; ``batch`` tells in which
    micro-batch, so that the latest one can be taken.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state")
    schema = stream.schema

    def append(batch: DataFrame, number: int) -> None:
        # One folder per batch: a batch that is run again replaces its own rows.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(append).trigger(availableNow=True)
    before = {key: spark.conf.get(key, None) for key in conf or {}}
    for key, value in (conf or {}).items():
        spark.conf.set(key, value)
    try:
        writer.start().awaitTermination()
        if close:
            close()
            writer.start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, batch bigint").parquet(out)


def latest(emitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last emission of each key of an update stream."""
    values = [c for c in emitted.columns if c not in (*keys, "batch")]
    rows = emitted.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return rows.select(*keys, "v.*")


FOREST = "pid bigint, birth_ns bigint, root bigint, depth bigint"


def growing_forest(edges: DataFrame, lateness_ns: int = 60_000_000_000) -> DataFrame:
    """Root and depth of every process (pid and birth) as fork events (with ts_ns) come in, and the ``batch`` that settled it.

    A fork may come ``lateness_ns`` after the latest one seen: it waits until no earlier birth can turn up, so that its parent is
    certain, and what was written stays. Forks that are later still are dropped, repeated ones count once. A batch writes the
    processes that it settles, and those that wait; from the table of earlier ones it reads the pids that are parents now.
    """
    from iotrail.operators.syscalls import fork_tree

    spark = edges.sparkSession
    base = scratch(spark, "forest")
    kind = "parent_pid bigint, child_pid bigint, ts_ns bigint"

    def table(name: str, schema: str, before: int) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], f"{schema}, batch bigint")
        return spark.read.schema(f"{schema}, batch bigint").parquet(f"{base}/{name}").filter(F.col("batch") < before)

    def settle(new: DataFrame, number: int, last: bool = False) -> None:
        marks = table("marks", "high bigint, settled bigint", number).agg(F.max("high"), F.max("settled")).first()
        waiting = table("waiting", kind, number).filter(F.col("batch") == number - 1).drop("batch")
        rows = new.select("parent_pid", "child_pid", F.col("ts_ns").cast("long").alias("ts_ns")).dropna()
        rows = rows.filter(F.col("ts_ns") > marks[1]) if marks[1] is not None else rows
        high = max((x for x in (rows.agg(F.max("ts_ns")).first()[0], marks[0]) if x is not None), default=None)
        settled = high if last or high is None else high - lateness_ns
        rows = rows.unionByName(waiting)
        if settled is not None:
            ready = rows.filter(F.col("ts_ns") <= settled)
            parents = ready.select(F.col("parent_pid").alias("pid")).distinct()
            known = table("forest", FOREST, number).drop("batch").join(parents, "pid", "left_semi").select("pid", "birth_ns", "root", "depth")
            fork_tree(ready, known).write.mode("overwrite").parquet(f"{base}/forest/batch={number}")
            rows = rows.filter(F.col("ts_ns") > settled)
        rows.write.mode("overwrite").parquet(f"{base}/waiting/batch={number}")
        mark = max((x for x in (settled, marks[1]) if x is not None), default=None)
        spark.createDataFrame([(high, mark)], "high bigint, settled bigint").coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")

    writer = edges.writeStream.option("checkpointLocation", f"{base}/state")
    writer.foreachBatch(settle).trigger(availableNow=True).start().awaitTermination()
    newest = table("marks", "high bigint, settled bigint", 1 << 62).agg(F.max("batch")).first()[0]
    end = 0 if newest is None else newest + 1
    settle(spark.createDataFrame([], kind), end, last=True)
    return table("forest", FOREST, end + 1)


def tracked_processes(
    edges: DataFrame, roots: Sequence[int], finish: Callable[[DataFrame], DataFrame] | None = None, lateness_ns: int = 60_000_000_000
) -> DataFrame:
    """Processes (pid and birth) that descend from the roots, kept up to date as fork events (with ts_ns) come in, see ``growing_forest``."""
    forest = growing_forest(edges, lateness_ns).drop("batch")
    first = edges.sparkSession.createDataFrame([(int(r),) for r in roots], "root bigint")
    rows = forest.join(F.broadcast(first), "root", "left_semi").select("pid", "birth_ns", "root", "depth")
    return finish(rows) if finish else rows
