"""Quality rules whose limits follow each language and source.

Fixed base rules come first (too few words, too many words in repeated passages). Then every measure of a document is held against limits
that its own (language, source) group sets: the median, and ``reach`` spreads to either side. The spread is the smaller distance of the two
quartiles from the median, so that up to a half of bad documents on one side does not move it, and at least the ``least`` of the measure, so
that groups of equal documents keep their neighbours. Groups of fewer than ``few`` documents take the limits of their language, and
languages of fewer those of all documents.

Quantiles come from mergeable sketches: a measure is counted in buckets that grow by a constant factor (zero has its own), sketches merge
by adding counts, and a quantile is off by half a factor at most. A sketch has a bounded number of buckets whatever the number of documents;
counting them is an ordinary aggregate, with partial sums in the tasks, so a hot source costs no more than another one. The limits are
joined to the documents' measures; up to ``BROADCAST`` groups as a broadcast, beyond that over a salted key, as a source may hold a third of
all rows.

Null and empty texts have no words and fail the base rules. A null language or source is a group like any other. Repeated rows count and
come out as often as they are there; an empty table gives no rows; columns that are called like the new ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrail.llm.common import drop_named, quoted
from iotrail.session import pin

SYMBOLS = b"#*$%&|<>"
#: Words of a window, for repeated passages.
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Buckets of a sketch grow by this factor; quantiles are exact to one percent.
FACTOR = 1.02
#: Groups whose limits a broadcast may hold: a row of some 100 bytes each.
BROADCAST = 100_000
SALTS = 16


@dataclass(frozen=True)
class Measure:
    """The ratio of two counts, which sides of it are limited, and its smallest spread."""

    name: str
    top: str
    bottom: str
    low: bool
    high: bool
    least: float

    @property
    def value(self) -> Column:
        return F.col(self.top) / F.greatest(F.col(self.bottom), F.lit(1))


MEASURES = (
    Measure("symbols_per_word", "n_symbols", "n_words", False, True, 0.008),
    Measure("repeated_lines", "n_dup_lines", "n_lines", False, True, 0.04),
    Measure("word_length", "word_chars", "n_words", True, True, 0.3),
)

_KIND = np.zeros(256, np.uint8)  # 1: a symbol, 2: goes on with a character
_KIND[list(SYMBOLS)] = 1
_KIND[0x80:0xC0] = 2


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    # Runs of words are numbered by their two halves, which are numbered before: numbers stay below n, so a pair fits 64 bits.
    number = {1: ids}

    def runs(size: int) -> np.ndarray:
        if size not in number:
            left = size // 2
            a, b = runs(left), runs(size - left)
            pairs = a[: len(words) - size + 1] * len(words) + b[left : left + len(words) - size + 1]
            number[size] = np.unique(pairs, return_inverse=True)[1]
        return number[size]

    codes = runs(window)
    again = np.flatnonzero(np.bincount(codes)[codes] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def count(raw: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` of a whole text in UTF-8. Words are what blanks and control characters 9 to 13 separate, as in ``bytes.split``."""
    if not raw:
        return (0,) * len(COUNTS)
    words = raw.split()
    packed = np.frombuffer(b"".join(words), np.uint8)
    kinds = np.bincount(_KIND[packed], minlength=3)  # symbols are never white space
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(packed) - int(kinds[2]), int(kinds[1]), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def counts(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``COUNTS`` of every whole text beside the carried columns."""
    kept = drop_named(docs.select(*map(quoted, docs.columns if carry is None else carry)), COUNTS).columns
    given = docs.select(*map(quoted, kept), quoted(text).cast("binary").alias("text of the operator"))
    schema = T.StructType([*given.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [count(raw) for raw in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=[*kept, *COUNTS])

    return given.mapInArrow(run, schema)


def bucket(value: Column, factor: float = FACTOR) -> Column:
    """The bucket of a value that isn't negative; zero has the bucket null."""
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(factor))).cast("int"))


def sketches(measured: DataFrame, keys: list[str], measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """(keys, ``measure``, ``bucket``, ``n``): the sketch of every measure in every group. Sketches merge by adding ``n``."""
    each = F.explode(F.array(*(F.struct(F.lit(m.name).alias("measure"), bucket(m.value).alias("bucket")) for m in measures)))
    return measured.select(*map(quoted, keys), each.alias("m")).groupBy(*map(quoted, keys), "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*map(quoted, keys), "measure", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, keys: list[str], measures: tuple[Measure, ...] = MEASURES, reach: float = 12.0, factor: float = FACTOR) -> DataFrame:
    """(keys, ``size``, and ``low`` and ``high`` of every measure) from the quartiles of sketches, which a group's few buckets give as arrays."""
    worth = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(factor), F.col("bucket")) * F.lit(2 / (factor + 1)))
    cells = F.sort_array(F.collect_list(F.struct(worth.alias("v"), "n")))  # at most some thousand buckets
    groups = sketch.groupBy(*map(quoted, keys), "measure").agg(cells.alias("cells"), F.sum("n").alias("size"))

    def quantile(q: float) -> Column:
        rank = F.ceil(F.col("size") * F.lit(q))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda acc, c: F.struct((acc["seen"] + c["n"]).alias("seen"), F.when(acc["seen"] < rank, c["v"]).otherwise(acc["v"]).alias("v"))
        return F.aggregate("cells", start, step)["v"]

    quartiles = groups.select(*map(quoted, keys), "measure", "size", quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(0.75).alias("q3"))
    least = F.create_map(*(x for m in measures for x in (F.lit(m.name), F.lit(m.least))))
    spread = F.greatest(F.least(F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2")), F.element_at(least, F.col("measure"))) * F.lit(reach)
    fenced = quartiles.select(*map(quoted, keys), "measure", "size", (F.col("q2") - spread).alias("low"), (F.col("q2") + spread).alias("high"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m.name, F.col(c)))
    columns = [of(m, side).alias(f"{side}_{m.name}") for m in measures for side in ("low", "high")]
    return fenced.groupBy(*map(quoted, keys)).agg(F.max("size").alias("size"), *columns)


def group_limits(measured: DataFrame, lang: str = "lang", source: str = "source", measures: tuple[Measure, ...] = MEASURES, reach: float = 12.0, few: int = 100) -> DataFrame:
    """The limits that hold for each (language, source): its own, its language's if it is small, or those of all documents if that is small, too.

    Only documents with words count.
    """
    names = [f"{side}_{m.name}" for m in measures for side in ("low", "high")]
    rows = measured.where("n_words > 0").select(quoted(lang).alias("lang"), quoted(source).alias("source"), *COUNTS)
    fine = pin(sketches(rows, ["lang", "source"], measures))
    by_lang = merged(fine, ["lang"])
    own, tongue = limits(fine, ["lang", "source"], measures, reach), limits(by_lang, ["lang"], measures, reach)
    tongue = tongue.select(F.col("lang").alias("lang_of"), F.col("size").alias("size_of"), *(F.col(c).alias(f"{c}_of") for c in names))
    whole = (limits(merged(by_lang, []), [], measures, reach).first() or Row()).asDict()  # one row
    both = own.join(tongue, F.col("lang").eqNullSafe(F.col("lang_of")))
    pick = lambda c: F.when(F.col("size") >= few, F.col(c)).when(F.col("size_of") >= few, F.col(f"{c}_of")).otherwise(F.lit(whole.get(c)).cast("double"))
    return both.select("lang", "source", *(pick(c).alias(c) for c in names))


def judged(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None, measures: tuple[Measure, ...] = MEASURES,
    reach: float = 12.0, few: int = 100, min_words: int = 10, max_repeated: int = 20, broadcast: int = BROADCAST,
) -> DataFrame:
    """The carried columns of every document with its ``COUNTS``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeated`` percent of them in repeated windows. ``kept``: neither that
    nor a measure beyond the limits of its group.
    """
    names = docs.columns if carry is None else carry
    extra = [c for c in (lang, source) if c not in names]
    measured = pin(counts(docs, text, [*names, *extra]))  # numbers only, unless texts are carried; read twice
    given = [c for c in drop_named(measured, [*COUNTS, *extra]).columns if c.lower() not in ("base_failed", "kept")]
    found = pin(group_limits(measured, lang, source, measures, reach, few))
    small = found.count() <= broadcast
    of_group = lambda c: F.col(f"{c} of the group")
    found = found.select(*(F.col(c).alias(f"{c} of the group") for c in found.columns))
    same = quoted(lang).eqNullSafe(of_group("lang")) & quoted(source).eqNullSafe(of_group("source"))
    if small:
        joined = measured.join(F.broadcast(found), same, "left")
    else:
        found = found.withColumn("salt of the group", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(*map(quoted, measured.columns)), F.lit(SALTS)).cast("int")
        joined = measured.withColumn("salt of the row", salt).join(found, same & (F.col("salt of the row") == of_group("salt")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    within = F.lit(True)
    for m in measures:
        within = within & (m.value >= of_group(f"low_{m.name}") if m.low else F.lit(True)) & (m.value <= of_group(f"high_{m.name}") if m.high else F.lit(True))
    return joined.select(*map(quoted, given), *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(False))).alias("kept"))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The documents, with their own columns, that the rules keep. Rows that are alike share their fate."""
    own = {c: f"column {k}" for k, c in enumerate(docs.columns)}
    rows = judged(docs.toDF(*own.values()), own[text], own[lang], own[source], **options)
    return rows.where("kept").select(*(F.col(n).alias(c) for c, n in own.items()))
