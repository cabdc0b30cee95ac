"""Near-duplicate detection with HyperMinHash sketches.

1. A document is the set of its distinct shingles, as 64-bit hashes. The hashes fall into ``BUCKETS`` buckets, and each bucket keeps
   its minimum, compressed to the number of leading zeros (6 bits) and the next ``MANTISSA`` bits.
2. Documents with equal sets are one node, named by their smallest doc_id; only nodes go on.
3. ``ROWS`` neighbouring registers make a band. Nodes that agree in a band meet in its bin. A pair at similarity 0.8 misses all bands
   with probability (1 - 0.8**6)**42 = 3e-6. For this an empty register takes the value of the first filled one in an order of its own:
   else a band with one filled register would bring together all documents that share one passage.
4. Every node of a bin is compared with the bin's smallest node. What passes the estimate (share of equal registers, corrected for
   registers that agree by chance, with five standard errors of room) is confirmed on the full sets.
5. Components of these links are found. Nodes that bins connect are a family; families that still fall into several components have
   their pairs *across* components compared: block by block on full sets inside the tasks, which return links only, or, where a family is
   so loose that its bins have fewer pairs than its blocks have rows, pair by pair. Pairs within one component need no comparison, so
   groups of copies never expand into all pairs, and yet every pair that shares a bin is either connected or refuted.

Equal hashes of different shingles would change a set size by one; for a document of 20,000 shingles the odds are 1e-11.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.llm.components import components
from iotrail.llm.common import forget, fresh, quoted
from iotrail.session import pin

MANTISSA = 10
ROWS = 6
BANDS = 42
BUCKETS = ROWS * BANDS
EMPTY = 0xFFFF
#: Standard errors that an estimate may lie below the threshold before a pair is dropped unverified.
ROOM = 4.0
#: Bits of the filter that spares texts without a candidate the way to the verification; at most 8 MB.
FILTER_BITS = 1 << 26
#: Nodes of a block; a task compares two blocks at once.
BLOCK = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text.

    A-Z are lower-cased; words are runs without ASCII white space. Fewer words than ``width`` make one shingle; no words, none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes, both only know ASCII
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    s = mixed(h[: len(h) - span + 1] + np.uint64(span))
    for j in range(1, span):
        s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - span + 1 + j])
    return np.unique(s)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set: for each bucket the compressed minimum, ``EMPTY`` where it has no element."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket.astype(np.int64), mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1))
    used = np.zeros(BUCKETS, bool)
    used[bucket.astype(np.int64)] = True
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(63 - exponent, 0, 62)
    mantissa = np.minimum((fraction * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.int64).clip(0)
    return np.where(used, (zeros << MANTISSA) | mantissa, EMPTY).astype(">u2")


#: For each register the order in which others stand in for it.
_STAND_IN = np.argsort(np.random.default_rng(3).random((BUCKETS, BUCKETS)), axis=1)
_TURN = np.argsort(_STAND_IN, axis=1)
_MULTIPLIERS = np.random.default_rng(4).integers(1, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One number for each band of a sketch with a filled register at least."""
    filled = np.flatnonzero(sketch != EMPTY)
    empty = np.flatnonzero(sketch == EMPTY)
    if len(empty):
        sketch = sketch.copy()
        sketch[empty] = sketch[filled[_TURN[np.ix_(empty, filled)].argmin(axis=1)]]
    bands = mixed((sketch.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS)
    return mixed(bands.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similarity(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of sketches (one pair per row) and its standard error at similarity 0.8.

    Registers of different minima agree if both minima fall into one cell of relative width 2**-MANTISSA. For minima of nx and ny
    uniform values the odds are about 2**-MANTISSA * 0.68 * nx * ny / (nx + ny)**2, which is taken out.
    """
    seen = (x != EMPTY) | (y != EMPTY)
    n = np.maximum(seen.sum(axis=1), 1)
    share = ((x == y) & seen).sum(axis=1) / n
    chance = 2.0**-MANTISSA * 0.68 * nx * ny / np.maximum(nx + ny, 1) ** 2
    return (share - chance) / (1 - chance), np.sqrt(0.8 * 0.2 / n)


def sketch(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` (equal exactly for equal sets; null for empty ones) and ``registers`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, keys, sketches = [], [], []
                for t in part.column(1):
                    s = shingles(t.as_py(), width)
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sketches.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_key", "registers"]
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches = [np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u2").reshape(batch.num_rows, BUCKETS) for k in (4, 5)]
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3))
            guess, error = similarity(*sketches, na, nb)
            keep = pa.array(guess >= percent / 100 - ROOM * error)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long").distinct()


def _sets(wanted: DataFrame, docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(``node``, ``s``), the full sets of at least the documents in ``wanted`` (``node``), and of few others."""
    n = wanted.count()
    bits = 1 << 10
    while bits < min(FILTER_BITS, 16 * n):
        bits *= 2
    hit = F.pmod(F.xxhash64("node"), F.lit(bits)) + 1
    # One byte string for 32768 bits: no more than the filter itself reaches the driver.
    parts = wanted.groupBy(F.bitmap_bucket_number(hit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(hit)).alias("m")).collect()
    table = np.zeros(-(-bits // 32768) * 4096, np.uint8)
    for row in parts:
        table[(row["k"] - 1) * 4096 : row["k"] * 4096] = np.frombuffer(bytes(row["m"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).cast("string").alias("text")).where("node is not null and text is not null")
    rows = rows.select("node", "text", F.bitmap_bucket_number(hit).alias("k"), F.bitmap_bit_position(hit).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        found = shared.value
        for batch in batches:
            k, p = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            rows_in = np.flatnonzero((found[(k - 1) * 4096 + p // 8] >> (p % 8).astype(np.uint8)) & 1)
            for start in range(0, len(rows_in), 256):
                part = batch.take(pa.array(rows_in[start : start + 256]))
                sets = [shingles(t.as_py(), width).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["node", "s"])

    return rows.mapInArrow(run, "node long, s array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) that are as similar as asked for on their full sets."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(wanted, docs, width, doc_id, text)
    side = lambda c: sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(side("b"), "b").join(side("a"), "a").where(both.cast("long") * 100 >= union.cast("long") * percent).select("a", "b").distinct()


def linked_across(node: np.ndarray, place: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """One link for each two places of which nodes of the two blocks (or, if there is one block only, of that block) are similar enough."""
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (start, start + 4096))
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[lo:hi], column[lo:hi] - start] = 1
        common += held @ held.T
    union = sizes[:, None] + sizes[None, :] - common
    close = np.triu((common * 100 >= union * percent) & (place[:, None] != place[None, :]), 1)
    if block.min() != block.max():
        close &= block[:, None] != block[None, :]
    found = {}
    for i, j in np.argwhere(close):
        found.setdefault(tuple(sorted((place[i], place[j]))), (int(node[i]), int(node[j])))
    return list(found.values())


def _across_blocks(families: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) across the places of each family, from (``node``, ``family``, ``place``, ``f``: nodes in the family)."""
    blocks = F.ceil(F.col("f") / BLOCK).cast("int")
    dealt = families.select("node", "family", "place", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.join(_sets(families.select("node"), docs, width, doc_id, text), "node")
    dealt = dealt.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "place", "block", "s")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        values = group.column("s").combine_chunks()
        flat, ends = values.flatten().to_numpy(), np.cumsum(values.value_lengths().to_numpy())
        links = linked_across(*(group.column(c).to_numpy() for c in ("node", "place", "block")), np.split(flat, ends[:-1]), percent)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("family", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Documents whose sets of ``width``-word shingles have a Jaccard similarity of at least ``percent`` / 100 are linked;
    ``component_id`` is the smallest doc_id that links lead to, and ``kept`` tells whether that is the row's own. Null and empty texts
    have no shingles and no links. Repeated rows come back as often as they came in, with the same component. Rows without doc_id
    cannot be named in a link: their component is null and they are kept. An empty table gives an empty result.
    """
    sketches = pin(sketch(docs, width, doc_id, text))
    # Equal keys have equal registers, so whichever row is first gives the same.
    nodes = pin(
        sketches.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    )

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                keys = np.concatenate([band_keys(np.frombuffer(r.as_py(), ">u2").astype(np.int64)) for r in part.column(1)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["bin", "node"])

    bins = nodes.select("node", "registers").mapInArrow(banded, "bin long, node long")
    shared = bins.groupBy("bin").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top").select("bin", "a")
    members = pin(bins.join(shared, "bin").select("bin", "a", F.col("node").alias("b")))
    tried = pin(members.where("a < b").select("a", "b").distinct())
    links = pin(_confirmed(pin(_likely(tried, nodes, percent)), docs, width, percent, doc_id, text))
    places = components(links)

    family = components(tried).withColumnRenamed("component", "family")
    placed = family.join(places, "node", "left").select("node", "family", F.coalesce("component", "node").alias("place"))
    split = placed.groupBy("family").agg(F.count(F.lit(1)).alias("f"), F.min("place").alias("low"), F.max("place").alias("high")).where("low < high")
    loose = members.groupBy("bin").agg(F.min("a").alias("node"), F.count(F.lit(1)).alias("c")).join(family, "node")
    loose = loose.groupBy("family").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs"))
    split = split.join(loose, "family").withColumn("in_blocks", F.expr(f"f * ceil(f / {BLOCK}) <= greatest({BLOCK}, pairs)"))
    split = pin(placed.join(split.select("family", "f", "in_blocks"), "family"))
    more = pin(_across_blocks(split.where("in_blocks"), docs, width, percent, doc_id, text))
    rest = split.where("not in_blocks").select("node", "place")
    if not rest.isEmpty():
        left = members.select("bin", F.col("b").alias("node")).join(rest, "node")
        right = left.select("bin", F.col("node").alias("b"), F.col("place").alias("place_b"))
        across = left.select("bin", F.col("node").alias("a"), F.col("place").alias("place_a")).join(right, "bin").where("a < b and place_a <> place_b")
        across = pin(across.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        more = more.unionByName(pin(_confirmed(pin(_likely(across, nodes, percent)), docs, width, percent, doc_id, text)))
    if not more.isEmpty():
        places = components(links.unionByName(more))

    found = nodes.join(places, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest doc_id, and of unlike texts with this id
    the one with the smallest hash.

    A document is an id with a text, so unlike texts that share an id are documents of their own and stay. Of rows that repeat both, the
    one with the smallest hash of all columns stays. Texts without words are like nothing. Rows without doc_id stay.
    """
    key = fresh(docs, "document key")
    named = docs.where(F.col(doc_id).isNotNull()).withColumn(key, F.xxhash64(doc_id, F.coalesce(F.col(text).cast("string"), F.lit(""))))
    places = near_duplicates(named.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), width, percent)
    ids = named.select(F.col(key).alias("doc_id"), F.col(doc_id).alias("id")).distinct()
    first = places.select("doc_id", "component_id").distinct().join(ids, "doc_id").groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("kept"))
    kept = named.join(first.select(F.col("kept.doc_id").alias("kept key")), F.col(key) == F.col("kept key"), "left_semi")
    columns = [quoted(c) for c in docs.columns]
    once = kept.groupBy(key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return once.unionByName(docs.where(F.col(doc_id).isNull()))
