"""Approximate nearest neighbours with randomly rotated codes of a few bits per component (RaBitQ, extended).

A vector o is rotated, and of each component the sign and three bits of its size are kept, two components to a byte. Read as a unit
vector s, they estimate the inner product with any q: <o, q> is about |o| * <s, q> / a, where a = <s, o> / |o| is stored with the code.
The rotation is random, so the error of <s, q> / a is close to normal with deviation |q| * sqrt((1 - a * a) / (a * a) / (D - 1)). The
best estimates are reranked on their original components first; then every vector is whose estimate plus ``SURE`` deviations reaches
their k-th best score. With signs alone a is near 0.8, and a third of the rows have to be reranked; with four bits it is near 0.995,
and few more than the k best are.

Queries meet all rows block by block: rows and queries go into blocks of bounded size, every pair of blocks is one group, and a group
returns the k best per query. Nothing is collected, and no group grows with the tables. Estimates are made for all pairs of a query and
a row, so their number grows as the product of the two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotrail.session import pin

SEED = 8
SURE = 3.0
#: Levels of a component on either side of zero: four bits.
LEVELS = 8
#: Rows and queries of a block, about; with 64 components a group of both takes some 10 MB. Tables of more than ``BLOCKS`` such blocks get
#: larger ones, as every block is shuffled once per block of the other side, of at most ``NUMBERS`` components.
BLOCK, BLOCKS, NUMBERS = 8192, 64, 1 << 21
#: Queries of a block that are compared at once.
AT_ONCE = 128


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix that the seed decides."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of rotated vectors, and the cosine ``a`` of each vector and what its code reads as."""
    step = np.abs(turned).max(axis=1, keepdims=True) / LEVELS
    level = np.clip(np.floor(turned / np.where(step > 0, step, 1)), -LEVELS, LEVELS - 1)
    read = level + 0.5
    length = np.linalg.norm(turned, axis=1) * np.linalg.norm(read, axis=1)
    a = (turned * read).sum(axis=1) / np.where(length > 0, length, 1)
    halves = np.zeros((len(turned), turned.shape[1] + turned.shape[1] % 2), np.uint8)
    halves[:, : turned.shape[1]] = level + LEVELS
    return halves[:, 0::2] << 4 | halves[:, 1::2], a


def decode(packed: np.ndarray, dimension: int) -> np.ndarray:
    """What packed codes read as: unit vectors in the rotated space, in single precision."""
    read = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :dimension].astype(np.float32) - (LEVELS - 0.5)
    return read / np.linalg.norm(read, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, and all components are finite numbers."""
    number = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x)
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)


def index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", seed: int = SEED) -> DataFrame:
    """``vec_id``, ``vector``, ``code`` (packed levels), ``norm`` and ``a`` of every vector that takes part, once per id.

    Null, zero and non-finite vectors, rows without id, and vectors of another length than most take no part. Of rows that repeat an id
    the one with the smallest vector counts.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id is not null")
    rows = rows.where(usable(F.col("vector")))
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimension = usual["d"] if usual else 1
    rows = rows.where(F.size("vector") == dimension).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    turn = vectors.sparkSession.sparkContext.broadcast(rotation(dimension, seed))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, dimension)
            most = np.abs(x).max(axis=1)
            x /= most[:, None]  # squares of very large or small components leave the range of a double
            norm = np.linalg.norm(x, axis=1) * most
            code, a = encode(x @ turn.value.T)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(a)], names=["vec_id", "vector", "code", "norm", "a"])

    return rows.mapInArrow(run, "vec_id long, vector array<double>, code binary, norm double, a double")


def _best(rows: pa.Table, queries: pa.Table, k: int, turn: np.ndarray, sure: float) -> pa.Table:
    """The k best rows for each query of two blocks."""
    rows, queries = rows.combine_chunks(), queries.combine_chunks()
    n, dimension = rows.num_rows, len(turn)
    out: list[list[np.ndarray]] = [[], [], []]
    if n and queries.num_rows:
        matrix = lambda t, name: np.asarray(t.column(name).combine_chunks().flatten()).reshape(t.num_rows, dimension)
        ids, x = rows.column("vec_id").to_numpy(), matrix(rows, "vector")
        norm, a = rows.column("norm").to_numpy(), rows.column("a").to_numpy()
        packed = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(n, -1)
        # Estimates have single precision, so they are shares of the query's length times the block's greatest.
        most = norm.max()
        read = decode(packed, dimension) * (norm / most / a).astype(np.float32)[:, None]
        error = np.sqrt(np.maximum(1 - a * a, 0)) / a / np.sqrt(max(dimension - 1, 1))
        spread = (norm / most * (error * sure + 1e-5)).astype(np.float32)
        first = min(n, 2 * k + 1)
        for start in range(0, queries.num_rows, AT_ONCE):
            part = queries.slice(start, AT_ONCE)
            own, q = part.column("query_id").to_numpy(), matrix(part, "query")
            length = part.column("length").to_numpy()[:, None]
            guess = (q / length @ turn.T).astype(np.float32) @ read.T
            if n > first:
                best = np.argpartition(guess, n - first, axis=1)[:, n - first :]
                exact = np.einsum("qmd,qd->qm", x[best], q)
                exact[ids[best] == own[:, None]] = -np.inf
                floor = np.partition(exact, first - k, axis=1)[:, first - k, None]
                guess += spread
                which, row = np.divmod(np.flatnonzero(guess >= (floor / length / most).astype(np.float32)), n)
            else:
                which, row = np.divmod(np.arange(part.num_rows * n), n)
            other = ids[row] != own[which]
            which, row = which[other], row[other]
            scores = np.concatenate([(x[row[i : i + 50_000]] * q[which[i : i + 50_000]]).sum(axis=1) for i in range(0, len(row), 50_000)] or [np.empty(0)])
            order = np.lexsort((ids[row], -scores, which))
            which, row, scores = which[order], row[order], scores[order]
            place = np.arange(len(which)) - np.searchsorted(which, which, side="left")
            top = place < k
            out[0].append(own[which[top]])
            out[1].append(ids[row[top]])
            out[2].append(scores[top])
    columns = [np.concatenate(c) if c else np.empty(0, kind) for c, kind in zip(out, (np.int64, np.int64, np.float64))]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))


def search(codes: DataFrame, queries: DataFrame, k: int = 20, seed: int = SEED, sure: float = SURE, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k largest inner products found for each query.

    ``codes`` comes from :func:`index`, ``queries`` are rows of it; a query never finds its own id. Scores are inner products of the
    original vectors in double precision, ties go to the smaller vec_id. With fewer than k candidates all are returned, without any, or
    without queries, nothing.
    """
    rows, asked = codes.count(), queries.count()
    dimension = codes.select(F.size("vector")).first()[0] if rows else 1
    turn = codes.sparkSession.sparkContext.broadcast(rotation(dimension, seed))
    block = max(block, min(rows // BLOCKS, NUMBERS // dimension))
    row_blocks, query_blocks = max(1, -(-rows // block)), max(1, -(-asked // block))
    part = lambda c, n: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = codes.select("*", part("vec_id", row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    right = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.col("norm").alias("length"), part("vec_id", query_blocks).alias("qb"), every(row_blocks).alias("rb"))
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(lambda x, y: _best(x, y, k, turn.value, sure), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose id is divisible by ``every``."""
    codes = pin(index(vectors, vec_id, vector))
    return search(codes, codes.where(F.col("vec_id") % every == 0), k)
