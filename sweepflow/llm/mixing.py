"""Mixing sources to target weights by weighted fair queueing.

Every document stands in its source's queue in a shuffled order, MOST times
over, and its virtual finish time is the source's cumulative size up to and
with it, divided by the source's target. All queues together are range-sorted
by finish time and cut where the total budget, the size of all documents, is
used up. A source thus gives words at a rate in proportion to its target, and
all sources reach their targets at the time 1.

Running sums are built in two steps so that no source and no moment is one
task: sums of (source, slot), a slot being a fixed part of the hash range, and
of ranges of finish time, and then rows within them on top of what comes before.

Sizes are numbers of words; null text has size 0. The order of the shuffle is
the MD5 of the id, then the id, then the size: reruns agree, and repeated rows
are queued one after the other. Null ids and the null source (last in order)
are values like any other. Empty tables give empty results, and a corpus
without a word takes nothing. A text of any length is one document. Columns but
id, text and source are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import aside, back, word_array, written

#: Weights, repeated over the sources in order, and how often a document may be taken.
WEIGHTS = (5, 2, 1)
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target. Expects source and size.

    Targets share the total by weight; none is above `most` times its source's
    size, and the excess is shared anew. Sources are capped in the order of
    most * size / weight, so running sums over that order give the level at
    which the rest share. One row for each source; the table of sources, not of
    documents, is sorted as a whole.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    # Strings are compared by their UTF-8 bytes, which is the order of code points.
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumns({"cap": (most * F.col("source_size")).cast("double")}).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = W.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    levels = weighed.withColumns({
        "total": F.sum("source_size").over(every).cast("double"),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    levels = levels.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    # The level is right from the first source on that it doesn't fill.
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"]
    return levels.withColumn("shared", level).select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("shared")), F.col("cap")).alias("target"))


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def size_of(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def queue_up(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str, slot_bits: int, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, source, size, source_size, target, row (a number of its own), and upto: the source's cumulative size in shuffled order, the document's own included."""
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"))
    sized = written(sized.withColumn("key", shuffle_key(F.col("doc_id"), seed)), "sized")
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "t_source")
    slot = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - slot_bits)
    slotted = sized.withColumn("slot", slot)
    starts = slotted.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    before = W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(F.col("source").alias("s_source"), F.col("slot").alias("s_slot"), F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("slot_start"))
    within = W.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = slotted.withColumn("within", F.sum("size").over(within))
    queued = queued.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slot") == F.col("s_slot")))
    queued = queued.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    queued = queued.select("doc_id", "source", "size", "source_size", "target", (F.col("slot_start") + F.col("within")).alias("upto"))
    return written(queued.withColumn("row", F.monotonically_increasing_id()), "queued")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix:", slot_bits: int = 12, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken of each document.

    The queues are dealt out by ranges of finish time and stored with the number
    of their range. Sums of ranges, a row each, are carried over to the next
    ones; within a range a running sum goes on from there, and what goes beyond
    the budget is cut off.
    """
    queued = queue_up(docs, weights, most, seed, slot_bits, doc_id, text, source)
    finish = F.try_divide((F.col("round") * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))
    rounds = queued.where(F.col("size") > 0).withColumn("round", F.explode(F.array(*map(F.lit, range(most))))).withColumn("finish", finish)
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("upto"), F.col("row")]
    ranged = rounds.select("row", "size", "finish", "source", "upto").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "mix-ranges")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = ranged.withColumn("end", F.sum("size").over(within)).join(F.broadcast(starts), "part")  # one row for each range
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    times = summed.where(F.col("start") + F.col("end") <= budget).groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("times"))
    taken = queued.join(times, "row", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return taken.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns.

    Rows are told apart by id and text: of rows that agree in both, one stands
    for all and comes as often as they do together.
    """
    key = F.concat_ws(":", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.xxhash64(F.col(f"`{text}`")).cast("string"))
    keyed = docs.select(*aside(docs.columns), key.alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
    mixed = mix(keyed, doc_id="key", **options)
    times = mixed.groupBy(F.col("doc_id").alias("key")).agg(F.sum("times").cast("int").alias("times")).where("times > 0")
    rows = keyed.drop("text", "source").join(times, "key").dropDuplicates(["key"])
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*back(docs.columns))
