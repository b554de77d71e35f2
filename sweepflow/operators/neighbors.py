"""Neighbour joins, planned as equi-joins on a bucket."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import TWO_PI


def squared_distance(a: str, b: str) -> Column:
    d = lambda c: F.col(f"{a}.{c}") - F.col(f"{b}.{c}")
    return d("x") * d("x") + d("y") * d("y") + d("z") * d("z")


def column_pairs(points: DataFrame, max_distance: float, columns_back: int, rows_apart: int, keys: list[str] | None = None, field_of_view: float | None = None, among: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of points nearer than max_distance, a the later one: b is at most columns_back columns before a, or above it in the same column.

    With `among`, a table with the same columns, b is one of its points.

    Expects pid, col, row_index, x, y, z, and the columns in `keys`, within
    which points may be neighbours. With field_of_view, the width of a column in
    radians, the search is also bounded by the angle under which max_distance is
    seen from the later point (which needs `dist` and `inc`), as a sensor's own
    search is. Each point looks into its columns_back + 1 columns by an equi-join;
    a column holds no more points than the sensor has rows.
    """
    keys = keys or []
    a = points.withColumn("look", F.explode(F.array(*[F.col("col") - k for k in range(columns_back + 1)]))).alias("a")
    b = (points if among is None else among).alias("b")
    on = F.col("a.look") == F.col("b.col")
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    on &= (F.abs(F.col("a.row_index") - F.col("b.row_index")) <= rows_apart) & ((F.col("b.col") < F.col("a.col")) | (F.col("b.row_index") < F.col("a.row_index")))
    on &= squared_distance("a", "b") < max_distance * max_distance
    if field_of_view is not None:
        angle = F.asin(F.least(F.lit(1.0), F.try_divide(F.lit(max_distance), F.col("a.dist"))))
        on &= (F.col("a.col") - F.col("b.col") <= F.ceil(angle / field_of_view)) & (F.abs(F.col("a.inc") - F.col("b.inc")) <= angle)
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.pid").alias("a"), F.col("b.pid").alias("b"))


def columns_of_view(distance: Column, max_distance: float, num_columns: int, most: int) -> Column:
    """How many columns back a point has to look: as many as max_distance covers, seen from its distance."""
    angle = F.asin(F.least(F.lit(1.0), F.try_divide(F.lit(max_distance), distance)))
    return F.least(F.lit(most), F.ceil(F.coalesce(angle, F.lit(math.pi / 2)) / F.lit(TWO_PI / num_columns))).cast("int")


def view_pairs(points: DataFrame, max_distance: float, num_columns: int, most_back: int, most_rows: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs (a, b) of points nearer than max_distance, as column_pairs, but each point looks into its own number of columns, and at rows within the same angle.

    A band join whose width differs from row to row: a point is copied for the
    columns that max_distance covers from its distance, most_back at most, so
    far points look into few columns. Expects dist and inc too.
    """
    keys = keys or []
    angle = F.asin(F.least(F.lit(1.0), F.try_divide(F.lit(max_distance), F.col("dist"))))
    looks = F.sequence(F.col("col") - columns_of_view(F.col("dist"), max_distance, num_columns, most_back), F.col("col"))
    a = points.withColumn("look", F.explode(looks)).withColumn("view", angle).alias("a")
    b = points.alias("b")
    on = F.col("a.look") == F.col("b.col")
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    on &= (F.abs(F.col("a.row_index") - F.col("b.row_index")) <= most_rows) & ((F.col("b.col") < F.col("a.col")) | (F.col("b.row_index") < F.col("a.row_index")))
    on &= (F.abs(F.col("a.inc") - F.col("b.inc")) <= F.col("a.view")) & (squared_distance("a", "b") < max_distance * max_distance)
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.pid").alias("a"), F.col("b.pid").alias("b"))


def grid_pairs(points: DataFrame, coordinates: Column, dimensions: int, tolerance: float, keys: list[str], point_id: str, cell_dimensions: int = 3) -> DataFrame:
    """Pairs (a < b) with equal keys and a distance below the tolerance.

    The first coordinates, up to cell_dimensions, span a grid of cells as wide
    as the tolerance: neighbours are in the same cell or the next one in each
    direction. Every pair is found in just one of the cells that one of the two
    points looks into.
    """
    n = min(dimensions, cell_dimensions)
    rows = points.select(*keys, F.col(point_id).alias("id"), coordinates.alias("p"))
    cells = rows.withColumn("cell", F.array(*[F.floor(F.col("p")[i] / tolerance) for i in range(n)]))
    steps = [[]]
    for _ in range(n):
        steps = [[*s, d] for s in steps for d in (-1, 0, 1)]
    looked = F.explode(F.array(*[F.array(*[F.col("cell")[i] + d for i, d in enumerate(s)]) for s in steps]))
    a, b = cells.withColumn("look", looked).alias("a"), cells.alias("b")
    on = (F.col("a.look") == F.col("b.cell")) & (F.col("a.id") < F.col("b.id"))
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    squares = F.aggregate(F.zip_with("a.p", "b.p", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return a.join(b, on & (squares < tolerance * tolerance)).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.id").alias("a"), F.col("b.id").alias("b"))
