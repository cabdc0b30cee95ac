"""Embedding whitening with eigenvectors refined from single precision.

Vectors become integers, floor(``scale`` * c), and are fitted on each distinct vector once. Sums and the centred covariance are added up in
the tasks and combined in two levels, so that the driver adds some root of the number of partitions of d x d matrices. Its eigenvectors are
found in float32 and corrected by the matrix-multiplication iteration of Ogita and Aishima in extended precision: with X the vectors so far,
R = I - X'X and S = X'VX give a correction X + XE that squares the error. Eigenvalues that are too close for the error so far form a
cluster; X is turned inside its space by an eigenproblem of the cluster's size, shifted by its mean, until they come apart or prove equal.

Vectors of unlike lengths have no common covariance: every length is fitted and whitened for itself. Rows whose vector is null, or holds
null or non-finite entries, are dropped; repeated rows stay, and count once in the fit. An empty table gives no rows, an empty vector has no
components. A component without variance has no scale: ``whitened`` is null there. ``deviation`` is exact, as a decimal of 38 digits, and null
if it has more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrail.llm.common import drop_named, quoted
from iotrail.session import pin

#: Rows that one step of numpy takes.
BLOCK = 4096
OUTPUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


@dataclass(frozen=True)
class Fit:
    """What is known of the vectors of one length; components by falling eigenvalue, one per row."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scales(self) -> np.ndarray:
        """One over the standard deviation of each component; NaN where there is none."""
        least = len(self.sums) * np.finfo(np.float64).eps * max(self.trace, 0.0)
        return np.array([1 / math.sqrt(e) if e > least else np.nan for e in self.values])


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(entry(c.cast("double")), F.lit(False))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of one length, their positions in the batch, and their vectors as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            lists = part.column(at)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            lengths = np.diff(ends)
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                yield part, rows, flat[ends[rows][:, None] + np.arange(d)].astype(np.int64).reshape(len(rows), d)


def _exact(x: np.ndarray, room: int) -> np.ndarray:
    """``x`` as it is if numbers ``room`` times as large fit 62 bits, else as Python integers."""
    large = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    return x if large * room < 2**62 else x.astype(object)


def _total(vectors: DataFrame, partial: Callable[[np.ndarray], np.ndarray], numbers: type) -> dict[int, tuple[int, np.ndarray]]:
    """By length: how many vectors there are and the sum of ``partial`` over blocks of them, taken in tasks and in two levels.

    Sums travel as text if ``numbers`` is int (they may exceed 64 bits), else as the bytes of doubles.
    """
    schema = "d int, rows long, total " + ("array<string>" if numbers is int else "binary")
    kind = pa.list_(pa.string()) if numbers is int else pa.binary()
    pack = (lambda a: [str(int(v)) for v in a.ravel()]) if numbers is int else (lambda a: a.astype(np.float64).tobytes())
    unpack = (lambda v: np.array([int(x) for x in v], dtype=object)) if numbers is int else (lambda v: np.frombuffer(v, np.float64))

    def out(sums: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        cells = [pa.array([d for d in sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([pack(s) for _, s in sums.values()], kind)]
        return pa.RecordBatch.from_arrays(cells, names=["d", "rows", "total"])

    def add(sums: dict[int, tuple[int, np.ndarray]], d: int, n: int, more: np.ndarray) -> None:
        before = sums.get(d)
        sums[d] = (n, more) if before is None else (before[0] + n, before[1] + more)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for _, rows, x in _blocks(batches, 0):
            add(sums, x.shape[1], len(rows), partial(x))
        if sums:
            yield out(sums)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for d, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                add(sums, d, n, unpack(total))
        if sums:
            yield out(sums)

    parts = vectors.mapInArrow(first, schema)
    few = math.isqrt(max(vectors.rdd.getNumPartitions(), 1)) + 1
    found: dict[int, tuple[int, np.ndarray]] = {}
    for row in parts.repartition(few).mapInArrow(second, schema).toLocalIterator():
        add(found, row["d"], row["rows"], unpack(row["total"]))
    return found


def refine(v: np.ndarray, x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of the symmetric ``v``, from approximate vectors ``x``, in the precision of ``v``."""
    eye, eps = np.eye(len(v), dtype=v.dtype), np.finfo(v.dtype).eps
    norm = np.sqrt((v * v).sum())
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ v @ x
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(value)
        close = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > close
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        order = np.argsort(value, kind="stable")
        x, value = x[:, order], value[order]
        clusters = np.split(np.arange(len(value)), np.flatnonzero(np.diff(value) > close) + 1)
        for c in (c for c in clusters if len(c) > 1):
            shifted = x[:, c].T @ (v @ x[:, c] - value[c].mean() * x[:, c])
            size = np.abs(shifted).max()
            if size > eps * norm:  # eigenvalues that are equal to this precision need no turning
                x[:, c] = x[:, c] @ np.linalg.eigh((shifted / size).astype(np.float64))[1].astype(v.dtype)
        if max(np.abs((e * gap)[apart]).max(initial=0) / norm, np.abs(r).max(initial=0)) < 4 * len(v) * eps:
            break
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    value = (x * (v @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(value, kind="stable")
    return value[order], x[:, order]


def eigen(v: np.ndarray, precision: type = np.longdouble) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (rows) of a covariance, refined from those in float32; the largest entry of each is positive."""
    size = np.abs(v).max(initial=0)
    if size == 0:
        return np.zeros(len(v)), np.eye(len(v))
    scaled = v.astype(precision) / precision(size)
    value, x = refine(scaled, np.linalg.eigh(scaled.astype(np.float32))[1].astype(precision))
    x = x / np.sqrt((x * x).sum(axis=0))
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(v))] < 0, -1, 1)
    return (value[::-1] * precision(size)).astype(np.float64), x.T[::-1].astype(np.float64)


def fit(vectors: DataFrame, vector: str = "embedding", scale: int = 256, components: int = 4) -> dict[int, Fit]:
    """The fit of every length of vectors that occurs; ``vectors`` are read once, their distinct integer forms are written."""
    used = vectors.where(usable(quoted(vector)))
    distinct = pin(used.select(integers(quoted(vector), scale).alias("x")).where(F.size("x") > 0).distinct())
    sums = {d: (n, [int(v) for v in s]) for d, (n, s) in _total(distinct, lambda x: _exact(x, len(x)).sum(axis=0), int).items()}
    means = {d: np.array([v / n for v in s]) for d, (n, s) in sums.items()}

    def products(x: np.ndarray) -> np.ndarray:
        y = x - means[x.shape[1]]
        return (y.T @ y).ravel()

    fits: dict[int, Fit] = {}
    for d, (n, total) in _total(distinct, products, float).items():
        v = total.reshape(d, d) / n
        values, rows = eigen((v + v.T) / 2)
        fits[d] = Fit(n, sums[d][1], float(np.trace(v)), values[:components], rows[:components], None)
    shapes = {d: f.components.T * f.scales for d, f in fits.items()}

    def white(x: np.ndarray) -> np.ndarray:
        w = (x - means[x.shape[1]]) @ shapes[x.shape[1]]
        return (w.T @ w).ravel()

    for d, (n, total) in _total(distinct, white, float).items() if fits else ():
        f = fits[d]
        k = len(f.values)
        error = np.abs(total.reshape(k, k) / n - np.eye(k))
        known = error[~np.isnan(error)]
        fits[d] = Fit(f.n, f.sums, f.trace, f.values, f.components, float(known.max()) if len(known) else None)
    return fits


def _deviations(x: np.ndarray, f: Fit) -> pa.Array:
    """The exact sums of squares of n * x - S."""
    sums = np.array(f.sums, dtype=object)
    scaled = _exact(x, 2 * f.n) * f.n  # the mean of the fit is no larger than its largest vector, but x may be any
    small = scaled.dtype != object and max((abs(s) for s in f.sums), default=0) < 2**62
    off = scaled - (sums.astype(np.int64) if small else sums)
    off = _exact(off, 1) if small else off
    largest = int(np.abs(off.astype(np.float64)).max(initial=0)) + 1
    squares = (off * off).sum(axis=1) if off.dtype != object and largest * largest * max(x.shape[1], 1) < 2**62 else (off.astype(object) ** 2).sum(axis=1)
    if squares.dtype != object:
        return pa.array(squares.astype(np.int64)).cast(pa.decimal128(38, 0))
    return pa.array([int(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, fits: dict[int, Fit], vector: str = "embedding", scale: int = 256, carry: list[str] | None = None) -> DataFrame:
    """One row per usable vector and component: its place on the component in standard deviations, beside the carried columns.

    ``component`` (from 1), ``n`` (vectors of the fit), ``deviation`` (sum of squares of n * x - S, exact), ``whitened``, ``explained`` (share of
    the variance) and ``identity_error`` (largest entry of the covariance of ``whitened`` over the fit, less the identity). Columns of the same
    names are replaced.
    """
    kept = drop_named(vectors.select(*map(quoted, vectors.columns if carry is None else carry)), OUTPUT)
    names = kept.columns
    given = vectors.where(usable(quoted(vector))).select(*map(quoted, names), integers(quoted(vector), scale).alias("integers of the operator"))
    fields = [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0))]
    fields += [T.StructField(c, T.DoubleType()) for c in OUTPUT[3:]]
    schema = T.StructType([*given.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, x in _blocks(batches, len(names)):
            f = fits.get(x.shape[1])
            if f is None:
                continue
            k, n = len(f.values), len(rows)
            w = ((x - f.mean) @ (f.components.T * f.scales)).ravel()
            every = pa.array(np.repeat(rows, k))
            white = pa.array(w, mask=np.isnan(w))
            cells = [
                pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, f.n)), _deviations(x, f).take(pa.array(np.repeat(np.arange(n), k))), white,
                pa.array(np.tile(f.values / f.trace if f.trace > 0 else np.zeros(k), n)), pa.array([f.identity_error] * (n * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*(c.take(every) for c in part.columns[:-1]), *cells], names=[*names, *OUTPUT])

    return given.mapInArrow(run, schema)
