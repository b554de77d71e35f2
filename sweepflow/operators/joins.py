"""Joins on keys of which a few may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_heavy(rows: DataFrame, table: DataFrame, key: str, parts: int = 1000, how: str = "inner", total: int | None = None) -> DataFrame:
    """Joins rows with a table that has one row for each key, and __n, how many of `rows` have it.

    Keys that more than one in `parts` of the rows have, of which there are less
    than `parts`, go to the rows by a broadcast; the others are few enough for
    one task each. `how` may be inner or left. The column __n goes. `total` is
    the number of rows, if it is known.
    """
    if total is None:
        total = table.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    heavy, light = table.where(F.col("__n") > total / parts).drop("__n"), table.where(F.col("__n") <= total / parts).drop("__n")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key, how))


def join_salted(rows: DataFrame, table: DataFrame, key: str, salt: Column, parts: int = 1000) -> DataFrame:
    """Joins rows with a table of large values that has one row for each key.

    A key that more than one in `parts` of the rows have, of which there are
    less than `parts`, has its value copied so often that no task gets more of
    its rows than that; `salt` is a number of each row that deals them out.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    share = rows.count() / parts
    heavy = F.broadcast(counts.where(F.col("__n") > share).select(key, F.ceil(F.col("__n") / F.lit(max(share, 1.0))).cast("int").alias("__copies")))
    dealt = rows.join(heavy, key, "left").withColumn("__salt", F.coalesce(F.pmod(salt, F.col("__copies")), F.lit(0)).cast("int")).drop("__copies")
    copied = table.join(heavy, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__copies")
    return dealt.join(copied, [key, "__salt"]).drop("__salt")
