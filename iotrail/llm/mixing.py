"""Mixing sources to target weights.

Words are added up per source; a source's target divided by its size is its repetition rate. Every document then comes floor(rate)
times, and once more if a number drawn from a hash of a seed and its id is below the fraction. Of ``SEEDS`` seeds each source has the one
whose copies come nearest to its target, which one aggregate over ids and sizes tells: a source of few documents would be far off
with a fixed seed. The draw needs nothing but the row and the line of its source, so emission is one pass, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iotrail.llm.common import drop_named, fresh, quoted, uniform, word_count
from iotrail.session import pin

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = 17
SEEDS = 64


def source_rates(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING, source: str = "source", size: str = "size") -> DataFrame:
    """(``source``, ``source_size``, ``weight``, ``target``, ``rate``) from rows with a source and a size in words.

    Sources in code point order, null last, have the weights in turn and share the sum of all sizes. Targets stop at ``ceiling`` times
    the source's size; what is over goes to the others by weight, until none is above. Sources without words get none.
    """
    sums = docs.groupBy(quoted(source).alias("source")).agg(F.sum(size).alias("source_size"))
    # Ranks of any number of sources: sorted by range, ranked within a range, moved on by the counts of the ranges before.
    ranged = pin(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    before, offsets = 0, {}
    for row in sorted(ranged.groupBy("range").count().collect()):  # one row per partition
        offsets[row["range"]], before = before, before + row["count"]
    if not offsets:
        return ranged.select("source", "source_size", F.lit(0).cast("long").alias("weight"), F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"))
    start = F.element_at(F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair)), F.col("range"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) + start
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    table = pin(ranged.select("source", "source_size", turn.cast("long").alias("weight")))
    # A source is full if the level (words per unit of weight) would lift it over its ceiling. Fuller ones raise the level for the rest.
    exact = "decimal(38,0)"
    words, share = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    total = words
    while True:
        full = F.col("weight").cast(exact) * F.lit(Decimal(words)).cast(exact) > F.col("source_size").cast(exact) * F.lit(Decimal(ceiling * share)).cast(exact)
        row = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * ceiling)), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")
        ).first()
        if (total - row["taken"], row["open"]) == (words, share) or row["open"] == 0:
            break
        words, share = total - row["taken"], row["open"]
    target = F.when(full, (F.col("source_size") * ceiling).cast("double")).otherwise((F.col("weight") * F.lit(words)).cast("double") / F.lit(float(share)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return table.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def nearest_seeds(sized: DataFrame, rates: DataFrame, source: str = "source", size: str = "size", doc_id: str = "doc_id", seed: int = SEED, seeds: int = SEEDS) -> DataFrame:
    """``rates`` with the ``seed`` of every source, the first of ``seeds`` ones from ``seed`` on that brings its words nearest to the target."""
    rows = sized.select(quoted(source).alias("s"), quoted(size).alias("n"), quoted(doc_id).alias("id"))
    joined = rows.join(rates.select(F.col("source").alias("of"), "rate"), F.col("s").eqNullSafe(F.col("of")))
    fraction = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(uniform(seed + k, F.col("id")) < fraction, F.col("n")).otherwise(0)) for k in range(seeds)]
    sums = joined.groupBy(F.col("s").alias("of")).agg(F.array(*extra).alias("extra"))
    off = F.transform("extra", lambda x, k: F.struct(F.abs((F.floor("rate") * F.col("source_size") + x).cast("double") - F.col("target")).alias("off"), k.alias("k")))
    found = rates.join(sums, F.col("source").eqNullSafe(F.col("of")))
    return found.select(*rates.columns, (F.array_min(off)["k"] + seed).alias("seed"))


def with_copies(docs: DataFrame, rates: DataFrame, source: str = "source", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` with ``source_size`` and ``target`` of the row's source and ``copies``, how often the mix takes the row.

    A row draws by the ``seed`` of its source if ``rates`` has one, else by the one given. Rows with the same id draw alike; a null id draws
    like an empty one. Columns that are called like the new ones are replaced.
    """
    new = ("source_size", "target", "copies")
    docs = drop_named(docs, new)
    key, rate, own = (fresh(docs, f"{n} of the source") for n in ("name", "rate", "seed"))
    seeds = F.col("seed") if "seed" in rates.columns else F.lit(seed)
    lines = rates.select(F.col("source").alias(key), "source_size", "target", F.col("rate").alias(rate), seeds.alias(own))
    joined = docs.join(lines, quoted(source).eqNullSafe(quoted(key)))
    whole = F.floor(quoted(rate))
    copies = whole + (uniform(quoted(own), quoted(doc_id)) < quoted(rate) - whole).cast("long")
    return joined.select(*map(quoted, docs.columns), "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ceiling: int = CEILING, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the mix takes it, with its columns as they were. An empty table stays empty."""
    sized = pin(docs.select(quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), word_count(quoted(text)).alias("size")))
    rates = pin(nearest_seeds(sized, source_rates(sized, weights, ceiling), seed=seed))
    row = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), quoted(source).alias("source"), quoted(doc_id).alias("doc_id"))
    taken = with_copies(row, rates).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
