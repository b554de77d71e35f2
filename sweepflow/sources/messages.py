"""Recorded messages: a selection by topic and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_topics(messages: DataFrame, topic: str, order: list[str], topics: list[str], latched: list[str], start: int, end: int) -> DataFrame:
    """Messages of the topics from start to end, both included, with `latched`: whether it is the last one of a latched topic before the start.

    A latched topic's last message still holds when the span begins. It is found
    by an aggregate over the topic's earlier messages; `order` begins with the
    time and has no ties.
    """
    time = F.col(order[0])
    inside = messages.where(F.col(topic).isin(*topics, *latched) & time.between(start, end)).withColumn("latched", F.lit(False))
    row = F.struct(*order, *[F.col(c) for c in messages.columns if c not in order])
    last = messages.where(F.col(topic).isin(*latched) & (time < start)).groupBy(topic).agg(F.max(row).alias("last"))
    return inside.unionByName(last.select("last.*").select(*messages.columns).withColumn("latched", F.lit(True)))
