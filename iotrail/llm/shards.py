"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters rows uniformly over buckets that fit into a task's memory, by a seeded hash of the row's key. Pass 2 shuffles every
bucket by Fisher-Yates (``shuffle`` with a seed) and writes it. Buckets in turn give a random order of all rows; each shard takes an
equal stretch of it, so shard sizes differ by one row at most. What is counted over buckets is one number per bucket.

Rows whose key repeats (up to all of them) are kept apart by the number of the input partition, which a retried task finds again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iotrail.llm.common import drop_named, quoted
from iotrail.session import pin

SHARDS = 24
SEED = 9
#: Bytes of text that a bucket should hold.
BUCKET_BYTES = 8 << 20


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (a null has none) and eight for the rest of its row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def scatter(docs: DataFrame, key: list[str], text: str, seed: int, bucket_bytes: int) -> DataFrame:
    """Pass 1: (``bucket``, ``draw``, ``row``), every bucket within one partition, its rows in the order of ``draw``."""
    total = docs.agg(F.sum(byte_size(quoted(text)))).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    draw = F.xxhash64(F.lit(seed), *map(quoted, key), F.spark_partition_id())
    rows = docs.select(draw.alias("draw"), F.struct(*map(quoted, docs.columns)).alias("row"))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("draw")), F.lit(n)).cast("int")
    return rows.select(bucket.alias("bucket"), "draw", "row").repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "draw")


def shuffled_buckets(scattered: DataFrame, seed: int) -> DataFrame:
    """Pass 2: (``bucket``, ``place``, ``row``), the rows of each bucket in random order."""
    lists = scattered.groupBy("bucket").agg(F.collect_list("row").alias("rows"))
    return lists.select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "row"))


def shard(docs: DataFrame, shards: int = SHARDS, key: tuple[str, ...] = ("doc_id", "text"), text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``docs`` with its ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard).

    Shards are equal in rows, at most one apart; fewer rows than shards leave the last ones empty. Null and empty texts, null keys and
    repeated rows are rows like all others. Columns that are called like the new ones are replaced. An empty table stays empty.
    """
    docs = drop_named(docs, ("shard", "slot"))
    done = pin(shuffled_buckets(scatter(docs, list(key), text, seed, bucket_bytes), seed))
    counts = done.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # Where a bucket starts: totals of blocks of buckets first, so that no window holds more than a block or the blocks.
    blocks = counts.groupBy(F.expr("bucket div 4096").alias("block")).agg(F.sum("n").alias("total"))
    blocks = blocks.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("before"))
    counts = counts.withColumn("block", F.expr("bucket div 4096"))
    inner = F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")
    starts = counts.withColumn("inner", inner).join(blocks, "block").select("bucket", (F.col("before") + F.col("inner")).alias("start"))
    total = done.select(F.count(F.lit(1))).first()[0] or 1
    position = F.col("start") + F.col("place")
    own = F.expr(f"(start + place) * {shards} div {total}").cast("int")
    placed = done.join(starts, "bucket").select("row", position.alias("position"), own.alias("shard"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select("row.*", "shard", (F.col("position") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder per shard; ``slot`` is the order within it."""
    sharded.repartition("shard", F.expr("slot div 65536")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
