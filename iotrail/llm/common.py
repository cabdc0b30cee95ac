"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.session import pin

#: What the result contracts call a word: a run without blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def drop_named(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without the columns called ``names`` in any case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.select(*(quoted(c) for c in df.columns if c.lower() not in taken))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def word_count(text: Column) -> Column:
    """The number of words of ``text``; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int | Column, *keys: Column) -> Column:
    """A number in [0, 1) that the seed and the keys decide alone; SQL engines with md5 agree on it."""
    text = F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: What tasks leave in a Python worker for later tasks of the same operator, by key.
_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """The object that this Python worker keeps under ``key``; it is made, and what was kept before goes, if there is none."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Gives back what tasks of other operators have left in this Python worker. Spark goes on using its workers, so operators without
    anything to keep call it when a task begins."""
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def pin_and_free(df: DataFrame) -> DataFrame:
    """Like ``pin``, and the shuffle files of the rows go as soon as they are written, not when the driver collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return pin(df)
    finally:
        conf.set(key, before)
