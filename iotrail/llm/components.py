"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iotrail.session import pin


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node of ``edges``, the component being its smallest node.

    Each round every node moves to the neighbour (or itself) whose hash is smallest, and edges are drawn between the places moved to.
    With hashed priorities a constant share of the places empties in every round, chains included, so the number of rounds is
    logarithmic. Minima are combined before the shuffle, joins on a node of high degree are left to the skew handling. Loops, repeated
    edges and edges with a null end are harmless; an empty table has no components.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = pin(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    place = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.select("u", rank("v").alias("r")).unionByName(both.select("u", rank("u").alias("r")))
        moved = pin(near.groupBy("u").agg(F.min("r").alias("r")).select("u", F.col("r.n").alias("to")))
        if place is None:
            place = moved.select(F.col("u").alias("node"), F.col("to").alias("at"))
        else:
            place = place.join(moved, place["at"] == moved["u"], "left").select("node", F.coalesce("to", "at").alias("at"))
        place = pin(place)
        to_u, to_v = moved.select("u", F.col("to").alias("p")), moved.select(F.col("u").alias("v"), F.col("to").alias("q"))
        edges = pin(edges.join(to_u, "u").join(to_v, "v").where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
        if edges.isEmpty():
            break
    smallest = place.groupBy("at").agg(F.min("node").alias("component"))
    return pin(place.join(smallest, "at").select("node", "component"))
