"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts in the tasks. Trees are grown from at most ``max_rows`` labelled documents (their statistics are
some megabytes), level by level on binned columns, and flattened into arrays in heap order: the children of node i are 2i+1 and
2i+2, so a batch goes down all trees at once with numpy indexing.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrail.llm.common import drop_named, forget, quoted

#: The largest number of labelled documents that a classifier is fitted on.
MAX_ROWS = 20_000
#: Byte classes whose share of the text is a statistic.
CLASSES = {
    "upper": range(ord("A"), ord("Z") + 1),
    "lower": range(ord("a"), ord("z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:?'\"()-",
    "mark": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "high": range(128, 256),
}
STATISTICS = ("bytes", *(f"share_{c}" for c in CLASSES), "words", "word_length", "longest_word", "distinct_words", "top_word", "lines", "line_length", "distinct_lines", "packed")
_MASK = np.zeros((256, len(CLASSES)))
for _k, _members in enumerate(CLASSES.values()):
    _MASK[list(_members), _k] = 1


def statistics(text: str | None) -> list[float]:
    """``STATISTICS`` of a whole text; null and empty texts have zeros."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MASK / n
    words, lines = raw.split(), raw.split(b"\n")
    counts = Counter(words)
    w = max(len(words), 1)
    return [
        math.log1p(n), *shares, math.log1p(len(words)), sum(map(len, words)) / w, math.log1p(max(map(len, counts), default=0)),
        len(counts) / w, max(counts.values(), default=0) / w, math.log1p(len(lines)), math.log1p(n / len(lines)),
        len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / n,
    ]


@dataclass(frozen=True)
class Trees:
    """Flattened trees of equal depth. ``feature`` and ``threshold``: one row per tree, in heap order; ``value``: its leaves."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for every row of ``x``."""
        n, tree = len(x), np.arange(len(self.feature))[None, :]
        row, at = np.arange(n)[:, None], np.zeros((n, len(self.feature)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        total = self.base + self.value[tree, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, leaf: int = 10, l2: float = 1.0) -> Trees:
    """Boosts ``trees`` trees for the log loss of labels ``y`` (0 or 1). Without both labels the score is constant (0.5 without any)."""
    n, columns = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = math.log(share / (1 - share))
    inner = 2**depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, 2**depth))
    if n == 0 or y.min() == y.max():
        return Trees(base, depth, feature, threshold, value)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(columns)]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(columns)], axis=1)
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            cut = np.full((width, 2), -1)
            for j in range(columns):
                cell = node * bins + codes[:, j]
                left = [np.bincount(cell, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = left, (s[:, -1:] for s in left)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < leaf) | (nt - nl < leaf)] = -1
                b = gain.argmax(axis=1)
                top = gain[np.arange(width), b]
                better = top > best
                best[better], cut[better, 0], cut[better, 1] = top[better], j, b[better]
            for k in range(width):
                if cut[k, 0] >= 0:
                    feature[t, first + k], threshold[t, first + k] = cut[k, 0], edges[cut[k, 0]][cut[k, 1]]
            node = 2 * node + (x[np.arange(n), feature[t, first + node]] > threshold[t, first + node])
        value[t] = rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
        total += value[t][node]
    return Trees(base, depth, feature, threshold, value)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept away from learning: CRC-32 of its id as text leaves 1 when divided by 3. Without an id it isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **how) -> Trees:
    """Trees from the labelled documents that are not held out.

    ``labels`` has doc_id and quality; other values than 0 and 1 and null ids don't count, several labels of one document are decided by
    majority (ties: 1). Beyond ``max_rows`` labelled documents those with the smallest hashes of their ids are taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    # Where there are far more, most fall away before they are ordered; the limit is what allows the broadcast.
    share = min(1.0, 2.0 * max_rows / max(known.count(), 1))
    low = F.xxhash64("doc_id") < F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)
    known = known.where(low).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column(2)]).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in rows.T)], names=["doc_id", "y", *STATISTICS])

    schema = "doc_id long, y double, " + ", ".join(f"{s} double" for s in STATISTICS)
    # Rows that share an id are averaged, so that the driver gets max_rows rows at most.
    table = texts.mapInArrow(run, schema).groupBy("doc_id").agg(F.max("y").alias("y"), *(F.avg(s).alias(s) for s in STATISTICS)).toPandas().sort_values("doc_id")
    return grow(table[list(STATISTICS)].to_numpy(np.float64), (table["y"].to_numpy() >= 0.5).astype(np.float64), **how)


def score(docs: DataFrame, trees: Trees, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """The carried columns (all by default) with ``score``, the probability of good quality, and ``predicted`` (1 from 0.5 on).

    Null and empty texts are scored by their statistics, all zero. Rows are neither dropped nor merged; columns that are called like
    the new ones are replaced.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("score", "predicted")]
    source = docs.select(*map(quoted, carry), quoted(text).cast("string").alias("input of the operator"))
    names = [*carry, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                p = trees.score(np.array([statistics(t.as_py()) for t in part.column(part.num_columns - 1)]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(run, schema)


def accepted(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier takes for good, with their columns as they were."""
    own = [c for c in docs.columns if c.lower() in ("score", "predicted")]
    if own:  # clashing columns ride along in a struct
        packed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), quoted(text).alias("text"))
        return score(packed, trees, ["row"]).where("predicted = 1").select("row.*")
    return drop_named(score(docs, trees, text=text).where("predicted = 1"), ["score", "predicted"])
