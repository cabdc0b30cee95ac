"""Exact k nearest binary codes by incremental multi-index hashing.

A code is cut into segments of ``WIDTH`` bits, and equal segment values lie in one bin. If all n segments of two codes differ in more
than r bits, the codes differ in at least n * (r + 1). So after all bins within r bits of a query's segments have been looked at,
every code nearer than that has been seen. The radius grows by one per round, only for queries whose k-th distance isn't covered yet.

Codes that many rows share stand once in the index, with their k + 1 smallest ids: more can't be among the k nearest. A code is met in
several bins; it counts in the first one, which the two codes alone decide, so nothing needs to be remembered or compared twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrail.session import pin

BITS = 64
WIDTH = 16
#: Segments of a word.
SEGMENTS = BITS // WIDTH
#: Codes that one row of a bin holds, at most about: bins are split by hash in so many parts that they stay below if they are even.
BIN = 1 << 20


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``vec_id``, ``code``): bit i is set if component i is positive; components that a shorter vector lacks aren't.

    A code is a long if no vector has over 64 components, else an array of as many longs as the longest vector needs. Vectors that are null
    or empty or hold a null or a NaN have no code; neither have rows without id. Rows that repeat an id and a code count once, different
    codes of one id each.
    """
    v = F.col(vector)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    words = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 1) // BITS)

    def word(part: Column) -> Column:
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    code = word(F.col("v")) if words == 1 else F.array(*[word(F.slice("v", k * BITS + 1, BITS)) for k in range(words)])
    return rows.select("vec_id", code.alias("code")).distinct()


def _word(code: str, k: int | str, wide: bool) -> str:
    return f"{code}[{k}]" if wide else code


def _segment(code: str, s: int | str, wide: bool) -> str:
    """Segment ``s`` of a code, a number or the name of a column."""
    word, place = (s // SEGMENTS, s % SEGMENTS) if isinstance(s, int) else (f"cast({s} div {SEGMENTS} as int)", f"({s} % {SEGMENTS})")
    return f"(shiftrightunsigned({_word(code, word, wide)}, {place} * {WIDTH}) & {(1 << WIDTH) - 1})"


def _smallest(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group; all but k per task fall away before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")


def search(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``distance`` (Hamming) of the k nearest rows of ``codes`` for each row of ``queries``.

    Both have vec_id and code, a long or an array of equally many longs in every row. A query never finds its own id; ties go to the smaller vec_id; with fewer than k candidates all are
    returned. Empty tables give an empty result.
    """
    wide = isinstance(codes.schema["code"].dataType, T.ArrayType)
    words = (codes.agg(F.max(F.size("code"))).first()[0] or 1) if wide else 1
    segments = words * SEGMENTS
    apart = " + ".join(f"bit_count({_word('m.code', k, wide)} ^ {_word('q', k, wide)})" for k in range(words))
    first = pin(_smallest(codes.select("code", "vec_id"), "code", ["vec_id"], k + 1))
    index = first.groupBy("code").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    parts = max(1, -(-first.count() // BIN))
    segment = F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("s")
    bins = (
        index.select("code", "least", "n", segment)
        .groupBy("s", F.expr(_segment("code", "s", wide)).alias("value"), F.pmod(F.xxhash64("code"), F.lit(parts)).alias("part"))
        .agg(F.collect_list(F.struct("code", "least", "n")).alias("members"))
    )
    bins = pin(bins)
    active = pin(queries.select(F.col("code").alias("q"), F.lit(None).cast("int").alias("bound")).distinct())
    found = None
    for radius in range(WIDTH + 1):
        flips = F.filter(F.sequence(F.lit(0), F.lit((1 << WIDTH) - 1)), lambda x: F.bit_count(x) == radius)
        probes = active.select("q", "bound", segment).select("q", "bound", "s", F.expr(_segment("q", "s", wide)).alias("own"), F.explode(flips).alias("flip"))
        probes = probes.select("q", "bound", "s", F.col("own").bitwiseXOR(F.col("flip").cast("long")).alias("value"))
        # A code belongs to this radius and segment if no segment is nearer, and none before it is as near.
        away = [f"bit_count(({_segment('m.code', j, wide)}) ^ ({_segment('q', j, wide)}))" for j in range(segments)]
        here = " and ".join(f"({away[j]} > {radius} or ({away[j]} = {radius} and {j} >= s))" for j in range(segments))
        # What lies farther than k + 1 ids already found is not among the nearest.
        here += f" and (bound is null or {apart} <= bound)"
        met = f"transform(filter(members, m -> {here}), m -> struct({apart} as distance, m.least as least, m.code as code, m.n as n))"
        # Of one bin no more than k + 1 codes can be among the nearest; they lead the sorted list.
        near = F.expr(f"slice(array_sort({met}), 1, {k + 1})")
        # Spark sees the few queries, not their many probes: without the hint it would broadcast these.
        new = probes.join(bins.hint("shuffle_hash"), ["s", "value"]).select("q", F.inline(near))
        best = new if found is None else found.unionByName(new)
        found = pin(_smallest(best, "q", ["distance", "least"], k + 1))
        covered = segments * (radius + 1) - 1
        sure = found.where(F.col("distance") <= covered).groupBy("q").agg(F.sum("n").alias("ids")).where(F.col("ids") > k)
        bounds = found.groupBy("q").agg(F.when(F.sum("n") > k, F.max("distance")).alias("bound"))
        active = pin(active.select("q").join(sure, "q", "left_anti").join(bounds, "q", "left"))
        if radius == WIDTH or active.isEmpty():
            break
    named = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).join(found.select("q", "distance", "code"), "q").join(first, "code")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    nearest = named.where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return nearest.select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest sign codes of each row whose id is divisible by ``every``."""
    codes = pin(sign_codes(vectors, vec_id, vector))
    return search(codes, codes.where(F.col("vec_id") % every == 0), k)
