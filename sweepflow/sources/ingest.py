"""Firings as nested rows, one array of points each, to rows of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import running


def explode_firings(firings: DataFrame, lasers: Column, points: str = "points", stamp: str = "stamp_ns") -> DataFrame:
    """A row for each point: the firing's other columns, row_index, x, y, z and intensity (0 to 255).

    Firings without a stamp, or with the stamp 0, are dropped; one with another
    number of points than `lasers` stops the job. A NaN coordinate is null, as no
    return; intensities are shares of 255. No state is needed, so this serves
    streams as well.
    """
    seen = firings.where(F.col(stamp) != 0)
    wrong = F.raise_error(F.format_string("a firing has %s points, not %s", F.size(points).cast("string"), lasers.cast("string")))
    whole = seen.withColumn(points, F.when(F.coalesce(F.size(points) == lasers, F.lit(False)), F.col(points)).otherwise(wrong))
    rows = whole.select(*[c for c in firings.columns if c != points], F.posexplode(points).alias("row_index", "point"))
    number = lambda c: F.when(~F.isnan(F.col(f"point.{c}")), F.col(f"point.{c}")).cast("double").alias(c)
    strength = F.floor(F.col("point.intensity") * 255).cast("int").alias("intensity")
    return rows.select("*", number("x"), number("y"), number("z"), strength).drop("point")


def firing_points(firings: DataFrame, keys: list[str], order: str, block: Column, points: str = "points", stamp: str = "stamp_ns") -> DataFrame:
    """The points of a table of nested firings, with firing_index, counted from 0 over the firings that aren't dropped, in `order`.

    A stream's first firing tells how many points all have: one row for each
    stream is joined to its firings. `order` has no ties within `keys`.
    """
    seen = firings.where(F.col(stamp) != 0)
    first = seen.groupBy(*keys).agg(F.min_by(F.size(points), order).alias("__lasers"))
    counted = running(seen, keys, [order], F.lit(1), "sum", "firing_index", block, own=False)
    return explode_firings(counted.join(first, keys), F.col("__lasers"), points, stamp).drop("__lasers")
