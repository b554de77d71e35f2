"""A point stream that Spark derives from the table `events`.

Sixteen events are one firing of a sensor with sixteen lasers, 128 firings are
one rotation, and an event's value gives its distance.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the fixture.
ROWS, COLUMNS, STREAMS = 16, 128, 4


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, stream_id, row_index, col, dist, az, inc, x, y, z, intensity, stamp_ns and event_type."""
    e = events(spark, sf_dir)
    base = e.select(
        F.col("event_id").alias("pid"),
        (F.col("user_id") % STREAMS).alias("stream_id"),
        (F.col("event_id") % ROWS).cast("int").alias("row_index"),
        F.floor(F.col("event_id") / ROWS).alias("col"),
        (5 + F.floor(F.col("value") / 25)).cast("double").alias("dist"),
        F.least(F.floor("value"), F.lit(255)).cast("int").alias("intensity"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("stamp_ns"),
        "event_type",
    )
    angled = base.withColumns({"az": F.lit(2 * math.pi) * F.col("col") / COLUMNS, "inc": (7.5 - F.col("row_index")) * 0.02})
    return angled.withColumns({
        "x": F.col("dist") * F.cos("inc") * F.cos(-F.col("az")),
        "y": F.col("dist") * F.cos("inc") * F.sin(-F.col("az")),
        "z": F.col("dist") * F.sin("inc"),
    })
