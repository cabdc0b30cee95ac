"""Stupid-backoff language model scores.

Grams of up to ``order`` words are counted over all documents. The last word of a gram g with the context v scores log(C(g) / C(v)) if
the gram is known, else log(backoff) more than the gram without its first word, down to log(C(w) / N) for a single word. Every word of
every document takes these steps: the counts of its grams of all sizes are looked up, and it goes down from the longest until one is known.

* Documents are packed into blocks of some ``BLOCK_WORDS`` words, which are written once: the hashes of a block's distinct words, and
  words as numbers among them.
* Each block sends its distinct grams of each size with their counts, ordered by hash and cut into as many ranges of hashes as the corpus
  needs (``RANGE_GRAMS`` grams on average). A range's counts are added up across blocks in one task, and go back in the order they came.
  However frequent a gram is, a block sends it once, so no range is hot. The ranges are taken in ``passes`` passes, so that no more than
  a share of the grams is on disk at once.
* A block scores its words from the counts that came back.

A gram is known if a counted document has it; with ``shared``, one of several words only if two counted documents or more have it. Words
and grams are 64-bit hashes; the odds that two of a billion different ones meet are about 3 %.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrail.llm.common import pin_and_free, quoted

PASSES = 2
BACKOFF = 0.4
#: Words of a block; a longer document is a block of its own.
BLOCK_WORDS = 1_000_000
#: Grams of one size that a range of hashes has on average, at most.
RANGE_GRAMS = 2_000_000
#: Stands before the first word of a document; grams of nothing else have this hash, too.
START = 0

BLOCK = "block long, ids array<long>, counted binary, lengths binary, vocabulary binary, words binary, n_docs long, n_words long, n_counted long"


def _mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (v * np.uint64(0x9E3779B97F4A7C15) ^ w) * np.uint64(0xBF58476D1CE4E5B9)


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of the documents ``rows`` (id, text, whether it is counted), with their counted documents that have words, and words."""

    def packed(number: int, ids: list, counted: list, parts: list[np.ndarray], vocabulary: dict[bytes, int]) -> pa.RecordBatch:
        lengths = np.array([len(p) for p in parts], np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
        words = np.concatenate(parts).astype(_kind(len(hashes)))
        marks = np.array(counted, bool)
        values = [number, ids, marks.tobytes(), lengths.tobytes(), hashes.tobytes(), words.tobytes(), int((marks & (lengths > 0)).sum()), len(words), int(lengths[marks].sum())]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, *[pa.int64()] * 3]
        names = [c.split()[0] for c in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)

        def empty() -> tuple[list, list, list, defaultdict]:
            return [], [], [], defaultdict(count().__next__)

        held, (ids, counted, parts, vocabulary) = 0, empty()
        for batch in batches:
            for key, text, mark in zip(*batch.columns, strict=True):
                text = text.as_py()
                found = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes, both only know ASCII
                ids.append(key.as_py())
                counted.append(bool(mark.as_py()))
                parts.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)).astype(np.uint32))
                held += len(found)
                if held >= BLOCK_WORDS or len(ids) >= BLOCK_WORDS:
                    yield packed(next(numbers), ids, counted, parts, vocabulary)
                    held, (ids, counted, parts, vocabulary) = 0, empty()
        if ids:
            yield packed(next(numbers), ids, counted, parts, vocabulary)

    return rows.mapInArrow(run, BLOCK)


def _kind(distinct: int) -> type:
    return np.uint16 if distinct <= 1 << 16 else np.uint32


def _grams(block: dict, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each word of a block, its document's place and, size by size, the hash of the gram that ends with it."""
    lengths, vocabulary = np.frombuffer(block["lengths"], np.int64), np.frombuffer(block["vocabulary"], np.uint64)
    words = np.frombuffer(block["words"], _kind(len(vocabulary)))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(words)) + (order - 1) * (doc + 1)
    gram = np.full(len(words) + (order - 1) * len(lengths), START, np.uint64)
    gram[at] = vocabulary[words]
    sizes = [gram[at]]
    for _ in range(order - 1):
        gram = np.concatenate([np.zeros(1, np.uint64), _mixed(gram[:-1], gram[1:])])
        sizes.append(gram[at])
    return doc, sizes


def _sent(blocks: DataFrame, order: int, shared: bool, ranges: int, part: int, parts: int) -> DataFrame:
    """(``block``, ``size``, ``range``, ``grams``, ``n``, ``low``, ``high``): the distinct grams of each block and how often its counted
    documents have them, for the ranges of one pass; with ``shared``, also the least and the greatest id of those documents."""
    names = ["block", "size", "range", "grams", "n", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in batch.to_pylist()):
            doc, sizes = _grams(block, order)
            marks = np.frombuffer(block["counted"], bool)
            ids = np.array([-(2**63) if i is None else i for i in block["ids"]], np.int64)
            for size, grams in enumerate(sizes, 1):
                columns = list(np.unique(grams, return_counts=True))
                if not marks.all() or (shared and size > 1):
                    mine = marks[doc]
                    place, owner = np.searchsorted(columns[0], grams[mine]), ids[doc[mine]]
                    columns[1] = np.bincount(place, minlength=len(columns[0]))
                if shared and size > 1:
                    columns += [np.full(len(columns[0]), 2**63 - 1, np.int64), np.full(len(columns[0]), -(2**63), np.int64)]
                    np.minimum.at(columns[2], place, owner)
                    np.maximum.at(columns[3], place, owner)
                columns[1] = columns[1].astype(np.int64)
                ends = np.searchsorted(_range_of(columns[0], ranges), np.arange(ranges + 1))
                here = [r for r in range(part, ranges, parts) if ends[r] < ends[r + 1]]
                blobs = [pa.array([c[ends[r] : ends[r + 1]].tobytes() for r in here], pa.binary()) for c in columns]
                blobs += [pa.nulls(len(here), pa.binary())] * (4 - len(blobs))
                fixed = [pa.array([v] * len(here), pa.int64()) for v in (block["block"], size)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(here, pa.int64()), *blobs], names=names)

    return blocks.mapInArrow(run, "block long, size long, range long, grams binary, n binary, low binary, high binary")


def _range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    """The range of hashes, of so many of like width, that each gram is in."""
    return (grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def _counted(table: pa.Table) -> pa.Table:
    """The grams of one size and range with the counts of all blocks, in the order each block has sent them; unknown ones have 0."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in table[name].to_pylist()])
    found, place = np.unique(joined("grams", np.uint64), return_inverse=True)
    whole = np.zeros(len(found), np.int64)
    np.add.at(whole, place, joined("n", np.int64))
    if table["low"][0].is_valid:
        low, high = np.full(len(found), 2**63 - 1, np.int64), np.full(len(found), -(2**63), np.int64)
        np.minimum.at(low, place, joined("low", np.int64))
        np.maximum.at(high, place, joined("high", np.int64))
        whole[low >= high] = 0
    ends = np.cumsum([len(b) // 8 for b in table["grams"].to_pylist()])
    back = [c.tobytes() for c in np.split(whole[place], ends[:-1])]
    return table.select(["block", "size", "range"]).append_column("whole", pa.array(back, pa.binary()))


def scores(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", backoff: float = BACKOFF, passes: int = PASSES, order: int = 2, shared: bool = False, counted: Column | None = None
) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_score`` (natural logarithm, summed) and ``mean_log_score`` (per word) for every document.

    The model has grams of up to ``order`` words; with ``shared``, grams of several words count only if two documents or more have them.
    The documents where ``counted`` holds make the model, by default all; the others are only scored, and a word that no counted document
    has scores like one that they have once. Rows that repeat an id, or have none, make one document, whose words are added up. Documents
    without words score 0 and have no mean. An empty table gives an empty result.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    mark = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    blocks = pin_and_free(_blocks(docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"), mark.alias("counted"))))
    n_blocks, n_docs, n_words, total = blocks.agg(F.count("block"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_docs", "n_words", "n_counted"))).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(tasks, -(-n_words // RANGE_GRAMS))

    def lookup(part: int) -> DataFrame:
        sent = _sent(blocks, order, shared, ranges, part, passes).repartition(max(tasks, -(-ranges // passes)), "range")
        return pin_and_free(sent.groupBy("range", "size").applyInArrow(_counted, "block long, size long, range long, whole binary"))

    def score(block: pa.Table, known: pa.Table) -> pa.Table:
        block = block.to_pylist()[0]
        doc, sizes = _grams(block, order)
        first = np.diff(doc, prepend=-1) > 0
        known = known.sort_by([("size", "ascending"), ("range", "ascending")]).to_pydict()
        at, before = np.zeros(0), np.zeros(0)
        for size, grams in enumerate(sizes, 1):
            whole = b"".join(b for s, b in zip(known["size"], known["whole"], strict=True) if s == size)
            here = np.frombuffer(whole, np.int64)[np.unique(grams, return_inverse=True)[1]]
            if size == 1:
                at = np.log(np.maximum(here, 1) / max(total, 1))
            else:
                context = np.where(first, n_docs, np.roll(before, 1))
                is_known = here > 0
                at = np.where(is_known, np.log(np.where(is_known, here, 1) / np.where(is_known, context, 1)), np.log(backoff) + at)
            before = here
        lengths = np.frombuffer(block["lengths"], np.int64)
        sums = np.bincount(doc, weights=at, minlength=len(lengths))
        return pa.table({"doc_id": pa.array(block["ids"], pa.int64()), "s": sums, "n_words": lengths})

    known = reduce(DataFrame.unionByName, [lookup(part) for part in range(passes)])
    tasks = max(tasks, n_blocks)
    sides = [df.repartition(tasks, "block").groupBy("block") for df in (blocks, known)]
    every = sides[0].cogroup(sides[1]).applyInArrow(score, "doc_id long, s double, n_words long")
    out = every.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("s").alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
