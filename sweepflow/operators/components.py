"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.storage import Rounds
from .joins import join_heavy


def _marks(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a checksum of the set: two equal ones mean that a round changed nothing."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, the smallest node that can be reached, for each node that has an edge to another.

    Rounds of large-star and small-star: every node hands its larger neighbours,
    then its smaller ones, to the smallest one it knows. The minimum of a node
    is a partial aggregate, and a hub's own joins are broadcasts of its minimum
    (join_heavy), so a hub is no hot key; the joins hold nothing but pairs of
    keys. The number of rounds grows with the logarithm of the longest path.
    Each step is stored in the checkpoint folder in place of the one before,
    which cuts the lineage. Nulls and edges from a node to itself are left out;
    an empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    rounds = Rounds("components")
    pairs = rounds.store(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    marks = _marks(pairs)
    while marks[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("__n")).select("u", F.least("u", "m").alias("m"), "__n")
        # Large star: edges (larger neighbour, smallest known).
        large = join_heavy(both.where("v > u"), least, "u", total=marks[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = rounds.store(large.where("u <> v").distinct())
        # Small star: smaller neighbours and the node itself to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n"))
        joined = join_heavy(large, least, "u", total=marks[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = rounds.store(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        last, marks = marks, _marks(pairs)
        if marks == last:
            break
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
