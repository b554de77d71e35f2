"""Running values over a long order, in two steps.

A window over a whole stream is one task. Here the order is cut into blocks:
windows run within a block, sums of blocks are carried over by a window over
the much shorter table of blocks, and a join puts the two together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, kind: str, out: str, block: Column, own: bool = True) -> DataFrame:
    """Adds `out`: the running max, sum or last non-null value along `order` within `keys`; without the row's own value if not `own`.

    `block` must not decrease along the first column of `order`, which must not
    be null. Rows before any value have null (0 for sums). Rows that tie in
    `order` are in no defined sequence: give an order without ties.
    """
    step = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
    frame = (W.unboundedPreceding, W.currentRow) if own else (W.unboundedPreceding, -1)
    rows = df.withColumns({"__block": block, "__value": value})
    within = W.partitionBy(*keys, "__block").orderBy(*order)
    rows = rows.withColumn("__within", step("__value").over(within.rowsBetween(*frame)))
    if kind == "last":
        total = F.max(F.when(F.col("__value").isNotNull(), F.struct(*[F.col(c) for c in order], F.col("__value").alias("__value"))))["__value"]
    else:
        total = step(F.col("__value"))
    blocks = rows.groupBy(*keys, "__block").agg(total.alias("__total"))
    before = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.withColumn("__carried", step("__total").over(before)).drop("__total")
    joined = rows.join(carried, [*keys, "__block"])
    if kind == "max":
        result = F.greatest("__within", "__carried")
    elif kind == "sum":
        result = F.coalesce("__within", F.lit(0)) + F.coalesce("__carried", F.lit(0))
    else:
        result = F.coalesce("__within", "__carried")
    return joined.withColumn(out, result).drop("__block", "__value", "__within", "__carried")
