"""Firings to cells of an endlessly growing range image."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..jobs.storage import checkpointed
from .scans import running


def unwrap_rotations(firings: DataFrame, num_columns: int, keys: list[str], order: str, column: str, block: Column) -> DataFrame:
    """Adds `rotation` and `global_column`: a step back of more than half a turn begins a new rotation, one forward of as much goes back one."""
    previous = running(firings, keys, [order], F.col(column), "last", "previous_column", block, own=False)
    half = num_columns / 2
    diff = F.col(column) - F.col("previous_column")
    turn = F.when(diff < -half, 1).when((diff > half) & (F.col("previous_column") > 0), -1).otherwise(0)
    turned = running(previous, keys, [order], turn, "sum", "rotation", block)
    return turned.withColumn("global_column", F.col("rotation") * num_columns + F.col(column))


def half_turn(difference: Column, num_columns: int) -> Column:
    """A difference of columns, brought to within half a turn either way."""
    half = num_columns / 2
    return F.when(difference < -half, difference + num_columns).when(difference > half, difference - num_columns).otherwise(difference)


def unwrap_points(points: DataFrame, num_columns: int, keys: list[str], firing: str, row: str, column: str, block: Column) -> DataFrame:
    """Adds global_column, first_unfinished (the largest rearmost column of earlier firings), late, bad_start and fell_back to points.

    The points of a firing are placed by their way round from its first one, so
    a firing may lie across the seam. Its rearmost point goes on from that of the
    firing before by the shorter way round. A firing that is longer than half a
    turn is a bad start, and so is a first one across the seam. Where firings
    fall back from the foremost by more than half a turn, the shorter way is no
    longer the one from there: fell_back says so. Points without a column are
    left out; keys and firings must not be null.
    """
    first = W.partitionBy(*keys, firing).orderBy(row).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = points.where(F.col(column).isNotNull()).withColumn("__way", half_turn(F.col(column) - F.first(column).over(first), num_columns))
    bounds = seen.groupBy(*keys, firing).agg(F.min("__way").alias("__least"), F.max("__way").alias("__most"), F.min_by(F.col(column), F.col(row)).alias("__first"), F.min(column).alias("__plain"), F.max(column).alias("__far"))
    bounds = bounds.withColumn("__rear", F.pmod(F.col("__first") + F.col("__least"), F.lit(num_columns)))
    known = running(bounds, keys, [firing], F.col("__rear"), "last", "__before", block, own=False)
    step = F.when(F.col("__before").isNull(), F.col("__rear")).otherwise(half_turn(F.col("__rear") - F.col("__before"), num_columns))
    placed = running(known, keys, [firing], step, "sum", "__at", block)
    placed = running(placed, keys, [firing], F.col("__at"), "max", "first_unfinished", block, own=False)
    long = (F.col("__most") - F.col("__least") > num_columns / 2) | (F.col("__before").isNull() & (F.col("__far") - F.col("__plain") > num_columns / 2))
    placed = placed.select(*keys, firing, "__least", "__at", "first_unfinished", long.alias("bad_start"), F.coalesce(F.col("first_unfinished") - F.col("__at") > num_columns / 2, F.lit(False)).alias("fell_back"))
    joined = seen.join(placed, [*keys, firing]).withColumn("global_column", F.col("__at") + F.col("__way") - F.col("__least"))
    return joined.withColumn("late", F.coalesce(F.col("global_column") < F.col("first_unfinished"), F.lit(False))).drop("__way", "__least", "__at")


def firing_bounds(points: DataFrame, keys: list[str], firing: str, column: str) -> DataFrame:
    """Rearmost and foremost column of each firing, over all its points, late ones too."""
    return points.groupBy(*keys, firing).agg(F.min(column).alias("rearmost"), F.max(column).alias("foremost"))


def late_points(points: DataFrame, keys: list[str], firing: str, column: str, block: Column) -> DataFrame:
    """Adds `first_unfinished`, the largest rearmost column of all earlier firings, and `late`."""
    bounds = firing_bounds(points, keys, firing, column)
    marks = running(bounds, keys, [firing], F.col("rearmost"), "max", "first_unfinished", block, own=False)
    joined = points.join(marks.select(*keys, firing, "first_unfinished"), [*keys, firing])
    return joined.withColumn("late", F.coalesce(F.col(column) < F.col("first_unfinished"), F.lit(False)))


def nearest_in_cell(points: DataFrame, cell: list[str], distance: str, point_id: str) -> DataFrame:
    """The nearest point of each cell and how many it had; of equally near ones the smallest id."""
    best = F.min(F.struct(distance, point_id))
    found = points.groupBy(*cell).agg(best.alias("best"), F.count(F.lit(1)).alias("n_points"))
    return found.select(*cell, F.col(f"best.{point_id}").alias(point_id), F.col(f"best.{distance}").alias(distance), "n_points")


def place_block(own: pd.DataFrame, taken_ahead: float, carry: tuple[int, int, float] | None, first: int, last: int) -> tuple[dict[int, tuple[float, int]], tuple[int, int, float] | None]:
    """Places a row's points of one block of columns; gives its cells and the carry into the column after it.

    `own` has order, pid, column and distance in order. `carry` is (order, pid,
    distance) of the point that the block before moves into the first column;
    `taken_ahead` is when the first point that aims at the column after the block
    arrives. That column is free for a point of this block before then, whatever
    the block ahead does, and taken from then on.
    """
    taken: dict[int, tuple[float, int]] = {}
    out = None
    rows = [(o, p, c, d) for o, p, c, d in zip(own["order"].tolist(), own["pid"].tolist(), own["column"].tolist(), own["distance"].tolist())]
    if carry:
        rows = sorted([*rows, (carry[0], carry[1], first, carry[2])])
    for order, pid, column, distance in rows:
        if column not in taken:
            taken[column] = (distance, pid)
        elif column < last and column + 1 not in taken:
            taken[column + 1] = (distance, pid)
        elif column == last and out is None and order < taken_ahead:
            out = (order, pid, distance)
        elif distance < taken[column][0]:
            taken[column] = (distance, pid)
    return taken, out


def place_in_order(points: DataFrame, keys: list[str], row: str, column: str, order: str, distance: str, span: int) -> DataFrame:
    """Points to cells in the order of arrival: a taken cell sends a point to the next column; if that is taken too the nearer of the two holds the first cell.

    The rows of an image do not touch each other. A row is cut into blocks of
    `span` columns, which are placed side by side. All that a block needs of the
    one before is the point that moves over the border, if there is one (a
    carry), and of the one ahead when its first column is aimed at first. Blocks
    whose carry turned out to be another one are placed again, until none is. A
    carry seldom goes on through a whole block, so that takes few rounds; each
    holds the blocks with a new carry, and no group more than `span` columns.

    Points without a distance (null or NaN) take no cell. Keys and columns must
    not be null; `order` has no ties within a row.
    """
    at = [*keys, row]
    seen = points.where(F.col(distance).isNotNull() & ~F.isnan(distance))
    named = seen.select(*at, F.col("pid"), F.col(order).cast("long").alias("order"), F.col(column).cast("long").alias("column"), F.col(distance).cast("double").alias("distance"))
    source = checkpointed(named.withColumn("block", F.floor(F.col("column") / span)))
    ahead = source.where(F.pmod("column", F.lit(span)) == 0).groupBy(*at, "block").agg(F.min("order").alias("taken_ahead")).withColumn("block", F.col("block") - 1)
    types = {**dict(source.dtypes), "taken_ahead": "long"}
    place = ", ".join(f"`{c}` {types[c]}" for c in at)
    carry_schema = f"{place}, block long, carry_order long, carry_pid long, carry_distance double"
    cell_schema = f"{place}, pid long, cell_column long, `{distance}` double"

    def run(cells: bool):
        def group(key: tuple, own: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
            block = int(key[-1])
            came = side[side["carry_order"].notna()]
            carry = (int(came["carry_order"].iloc[0]), int(came["carry_pid"].iloc[0]), float(came["carry_distance"].iloc[0])) if len(came) else None
            limit = side["taken_ahead"].dropna()
            taken, out = place_block(own.sort_values("order"), float(limit.iloc[0]) if len(limit) else math.inf, carry, block * span, block * span + span - 1)
            where = dict(zip(at, key))
            if cells:
                return pd.DataFrame({**where, "pid": [p for _, p in taken.values()], "cell_column": list(taken), distance: [d for d, _ in taken.values()]})[[*at, "pid", "cell_column", distance]]
            rows = [out] if out else []
            return pd.DataFrame({**where, "block": block + 1, "carry_order": [o for o, _, _ in rows], "carry_pid": [p for _, p, _ in rows], "carry_distance": [d for _, _, d in rows]})

        return group

    def placed(rows: DataFrame, carries: DataFrame, cells: bool) -> DataFrame:
        side = carries.withColumn("taken_ahead", F.lit(None).cast("long")).unionByName(ahead.select(*at, "block", *[F.lit(None).cast(t).alias(c) for c, t in (("carry_order", "long"), ("carry_pid", "long"), ("carry_distance", "double"))], "taken_ahead"))
        if not cells:
            side = side.join(rows.select(*at, "block").distinct(), [*at, "block"], "left_semi")
        pair = rows.groupBy(*at, "block").cogroup(side.groupBy(*at, "block"))
        return pair.applyInPandas(run(cells), cell_schema if cells else carry_schema)

    none = source.sparkSession.createDataFrame([], carry_schema)
    carries = checkpointed(placed(source, none, False))
    before, new = none, carries
    while new.head(1):
        # Blocks that get another carry than the one they were placed with; what they carry on may change, or end.
        again = checkpointed(source.join(new.select(*at, "block").unionByName(before.select(*at, "block")).distinct(), [*at, "block"], "left_semi"))
        redone = placed(again, carries, False)
        kept = carries.join(again.select(*at, (F.col("block") + 1).alias("block")).distinct(), [*at, "block"], "left_anti")
        after = checkpointed(kept.unionByName(redone))
        before, new, carries = carries.subtract(after), after.subtract(carries), after
        if not new.head(1) and before.head(1):
            new = before
    return placed(source, carries, True)


def organize_frame(points: DataFrame, frame: list[str], laser: str, column: str, order: str, width: int, shift: bool = True) -> DataFrame:
    """The range image of whole frames: frame, laser, column, the point's `order`, and whether it had to move.

    A taken cell sends a point to the right, else to the left, else the point
    takes the cell from the one before. Lasers of a frame don't touch each other,
    and a frame is one sweep, so a group has a bound. Points without a column are
    left out.
    """
    types = dict(points.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in [*frame, laser]) + f"`{column}` long, `{order}` {types[order]}, moved boolean"

    def place(group, rows):
        import pandas as pd

        taken: dict[int, tuple[int, bool]] = {}
        for index, own in rows.sort_values(order)[[order, column]].itertuples(index=False):
            at = own = int(own)
            if shift and own in taken:
                at = next((c for c in (own + 1, own - 1) if 0 <= c < width and c not in taken), own)
            taken[at] = (index, at != own)
        out = pd.DataFrame({column: list(taken), order: [i for i, _ in taken.values()], "moved": [m for _, m in taken.values()]})
        for name, value in zip([*frame, laser], group):
            out[name] = value
        return out[[*frame, laser, column, order, "moved"]]

    return points.where(F.col(column).isNotNull()).select(*frame, laser, column, order).groupBy(*frame, laser).applyInPandas(place, schema)


def column_of_frame(x: Column, y: Column, width: int) -> Column:
    """The column of a clockwise sweep; the very end belongs to the last one."""
    return F.least(F.floor((F.lit(math.pi) - F.atan2(y, x)) / F.lit(2 * math.pi / width)), F.lit(width - 1)).cast("long")


def refill(cells: DataFrame, num_columns: int) -> DataFrame:
    """Angles of empty cells: the middle of their column. Expects col and continuous_azimuth."""
    return cells.withColumn("continuous_azimuth", F.coalesce("continuous_azimuth", (F.col("col") + 0.5) * F.lit(2 * math.pi / num_columns)))


def densify(cells: DataFrame, columns: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """All cells of the given columns; those without a point have nulls."""
    full = columns.select(*keys, "col", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row_index"))
    return full.join(cells, [*keys, "col", "row_index"], "left")


def fill_gaps(cells: DataFrame, keys: list[str], order: str, gap: Column, block: Column) -> DataFrame:
    """Adds `gap`, the last known angle between a laser and the one below it, along each row of the image."""
    return running(cells, keys, [order], gap, "last", "gap", block)


def recover_lasers(points: DataFrame, frame: list[str], index: str, angle: Column, jump: float = 0.7, lasers: int = 64) -> DataFrame:
    """Adds `laser_index`: a new laser begins where the growing angle falls by more than `jump`; after the last laser it is 0. A frame is one sweep, so its size has a bound."""
    w = W.partitionBy(*frame).orderBy(index)
    rows = points.withColumn("__angle", angle)
    rows = rows.withColumn("__new", F.when(F.lag("__angle").over(w) - F.col("__angle") > jump, 1).otherwise(0))
    rows = rows.withColumn("__laser", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.withColumn("laser_index", F.when(F.col("__laser") < lasers, F.col("__laser")).otherwise(0).cast("int")).drop("__angle", "__new", "__laser")


def time_jump_sessions(rows: DataFrame, keys: list[str], order: list[str], time: Column, gap: float, block: Column) -> DataFrame:
    """Adds `session`: a new one begins where time jumps by more than `gap` in either direction. What triggers it is dropped, as are its later ties to no row."""
    timed = rows.withColumn("__time", time)
    timed = running(timed, keys, order, F.col("__time"), "last", "__previous", block, own=False)
    timed = timed.withColumn("__jump", F.coalesce(F.abs(F.col("__time") - F.col("__previous")) > gap, F.lit(False)))
    counted = running(timed, keys, order, F.col("__jump").cast("long"), "sum", "session", block)
    return counted.where(~F.col("__jump")).drop("__time", "__previous", "__jump")
