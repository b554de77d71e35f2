"""Poses of a moving sensor, and points put where they were seen from the middle of their frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..jobs.storage import checkpointed

EARTH_RADIUS = 6378137.0


def mercator_pose(lat: Column, lon: Column, alt: Column, roll: Column, pitch: Column, yaw: Column, scale: Column) -> Column:
    """Pose of a GPS and IMU row; scale is the cosine of the first row's latitude."""
    x = scale * EARTH_RADIUS * F.radians(lon)
    y = scale * EARTH_RADIUS * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return F.array(
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, x,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, y,
        -sp, cp * sr, cp * cr, alt,
    )


def gps_poses(rows: DataFrame, keys: list[str], order: str, sensor: Column | None = None) -> DataFrame:
    """Adds m, the pose of each GPS and IMU row, times `sensor`, the IMU's transform from the sensor, if it is given.

    The scale of the projection is that of the first row's latitude: an
    aggregate of one row for each of `keys`, joined to its rows.
    """
    first = rows.groupBy(*keys).agg(F.cos(F.radians(F.min_by("lat", order))).alias("__scale"))
    m = mercator_pose(*[F.col(c) for c in ("lat", "lon", "alt", "roll", "pitch", "yaw", "__scale")])
    return rows.join(first, keys).withColumn("m", m if sensor is None else g.compose(m, sensor)).drop("__scale")


def root_transforms(frames: DataFrame, keys: list[str]) -> DataFrame:
    """root, depth and m, which takes points of a frame to its root, for each named frame.

    Expects frame, parent (null for a root) and m, parent from frame, for each
    frame once. Pointer doubling: in every round a frame jumps to where its
    ancestor has got to and composes the two transforms, so paths of n steps take
    log n rounds. A parent that is no frame is a root of its own, without a row.
    A circle of frames stops the job.
    """
    rows = frames.where("parent IS NOT NULL").select(*keys, "frame", F.col("parent").alias("root"), "m", F.lit(1).cast("long").alias("depth"))
    top = frames.where("parent IS NULL").select(*keys, "frame", F.col("frame").alias("root"), F.array(*[F.lit(float(i % 5 == 0)) for i in range(12)]).alias("m"), F.lit(0).cast("long").alias("depth"))
    rows, limit = checkpointed(rows), frames.count()
    on = rows.select(*keys, F.col("frame").alias("root"), F.col("root").alias("up"), F.col("m").alias("further"), F.col("depth").alias("more"))
    while rows.join(on.select(*keys, "root"), [*keys, "root"], "left_semi").head(1):
        joined = rows.join(on, [*keys, "root"], "left")
        jumped = joined.select(*keys, "frame", F.coalesce("up", "root").alias("root"), F.when(F.col("up").isNull(), F.col("m")).otherwise(g.compose(F.col("further"), F.col("m"))).alias("m"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        rows = checkpointed(jumped)
        if rows.where(F.col("depth") > limit).head(1):
            raise ValueError("frames refer to each other in a circle")
        on = rows.select(*keys, F.col("frame").alias("root"), F.col("root").alias("up"), F.col("m").alias("further"), F.col("depth").alias("more"))
    return rows.unionByName(top.select(*rows.columns))


def between_frames(asked: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Adds m, which takes points of frame `source` to frame `target`, to asked rows; null where the two have no common root.

    Both are named frames of `frames`; a frame that is only a parent is its own root.
    """
    known = root_transforms(frames, keys)
    one = F.array(*[F.lit(float(i % 5 == 0)) for i in range(12)])
    end = lambda name: known.select(*keys, F.col("frame").alias(name), F.col("root").alias(f"{name}_root"), F.col("m").alias(f"{name}_m"))
    both = asked.join(end("source"), [*keys, "source"], "left").join(end("target"), [*keys, "target"], "left")
    root = lambda name: F.coalesce(F.col(f"{name}_root"), F.col(name))
    whole = both.withColumns({"__s": F.coalesce("source_m", one), "__t": F.coalesce("target_m", one)})
    whole = whole.withColumn("__t", g.inverse(F.col("__t"))).withColumn("m", F.when(root("source") == root("target"), g.compose(F.col("__t"), F.col("__s"))))
    return whole.select(*asked.columns, "m")


def relative_to_first(poses: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Poses in the frame of their sequence's first one, which is found by an aggregate and joined: one row for each sequence."""
    first = poses.groupBy(*keys).agg(F.min(F.struct(order, "m"))["m"].alias("first"))
    return poses.join(first, keys).withColumn("m", g.compose(g.inverse(F.col("first")), F.col("m"))).drop("first")


def turn_bin(x: Column, y: Column, bins: int) -> Column:
    """The part of a clockwise turn in which a point was seen; the very end belongs to the last one."""
    fraction = (F.lit(math.pi) - F.atan2(y, x)) / F.lit(2 * math.pi)
    return F.least(F.floor(fraction * bins), F.lit(bins - 1)).cast("long")


def undo_motion(points: DataFrame, bin_poses: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Points as seen at the middle of their frame.

    Points were corrected to the middle pose; what the sensor saw at a bin's
    time is inv(pose of the bin) * middle pose * point. bin_poses has a row
    (keys, bin, m, middle) for each bin of a frame, so the join is on equal keys.
    """
    placed = points.withColumn("bin", turn_bin(F.col("x"), F.col("y"), bins)).join(bin_poses, [*keys, "bin"])
    moved = placed.withColumn("__at", g.transform(F.col("middle"), g.vec("x", "y", "z")))
    back = moved.withColumn("__m", g.inverse(F.col("m"))).withColumn("__at", g.transform(F.col("__m"), F.col("__at")))
    return back.withColumns({c: F.col("__at")[c] for c in "xyz"}).drop("__at", "__m", "m", "middle")


def column_firings(frames: DataFrame, num_columns: int) -> DataFrame:
    """A firing for each column of a frame, its stamp in proportion between start_ns and end_ns."""
    columns = frames.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(num_columns - 1))))
    return columns.withColumn("firing_ns", F.expr(f"start_ns + (end_ns - start_ns) * column div {num_columns - 1}"))


def firing_stamps(points: DataFrame, firing: list[str], stamp: str) -> DataFrame:
    """Points of each firing and its stamp, the middle between its first and last point's."""
    first, last = F.min(stamp), F.max(stamp)
    return points.groupBy(*firing).agg(F.count(F.lit(1)).alias("n_points"), (first + F.shiftright(last - first, 1)).alias("firing_ns"))
