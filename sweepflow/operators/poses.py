"""Poses as a time series: as-of joins and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scans import running


def as_of(rows: DataFrame, poses: DataFrame, stamp: str, values: list[str], keys: list[str], order: str, block: Column) -> DataFrame:
    """Adds before and after, structs of the last pose at or before a row's stamp and of the first one after; null beyond the ends.

    Rows and poses are one table in order of time, over which the last pose is
    carried, once forwards and once backwards, in blocks of time.
    """
    pose = F.struct(F.col(stamp).alias("stamp"), *values)
    a = rows.withColumn("__kind", F.lit(1)).withColumn("__pose", F.lit(None).cast(poses.select(pose.alias("p")).schema["p"].dataType))
    names = [c for c in rows.columns]
    b = poses.select(*keys, F.col(stamp), pose.alias("__pose"), F.lit(0).alias("__kind"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__tie", F.coalesce(F.col(order), F.lit(-1)))
    forward = running(both, keys, [stamp, "__kind", "__tie"], F.col("__pose"), "last", "before", block)
    forward = forward.withColumns({"__back": -F.col(stamp), "__back_kind": -F.col("__kind"), "__back_tie": -F.col("__tie"), "__back_block": -block})
    backward = running(forward, keys, ["__back", "__back_kind", "__back_tie"], F.col("__pose"), "last", "after", F.col("__back_block"))
    return backward.where("__kind = 1").select(*names, "before", "after")


def interpolate(before: Column, after: Column, stamp: Column, value: str) -> Column:
    """Linear in time; the nearer end where one side is missing."""
    share = F.try_divide((stamp - before["stamp"]).cast("double"), (after["stamp"] - before["stamp"]).cast("double"))
    return F.coalesce(before[value] + (after[value] - before[value]) * share, before[value], after[value])


def slerp(a: Column, b: Column, share: Column) -> Column:
    """Between two unit quaternions (arrays w, x, y, z), the short way round; nearly equal ones are mixed linearly."""
    dot = sum((a[i] * b[i] for i in range(1, 4)), a[0] * b[0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    near = F.sin(angle) < 1e-6
    wa = F.when(near, 1 - share).otherwise(F.try_divide(F.sin((1 - share) * angle), F.sin(angle)))
    wb = F.when(near, share).otherwise(F.try_divide(F.sin(share * angle), F.sin(angle))) * sign
    mixed = [wa * a[i] + wb * b[i] for i in range(4)]
    norm = F.sqrt(sum((m * m for m in mixed[1:]), mixed[0] * mixed[0]))
    return F.array(*[m / norm for m in mixed])


def rotation_matrix(q: Column) -> Column:
    w, x, y, z = (q[i] for i in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def quaternion(yaw: Column) -> Column:
    """The unit quaternion (w, x, y, z) of a turn about the vertical axis."""
    return F.array(F.cos(yaw / 2), F.lit(0.0), F.lit(0.0), F.sin(yaw / 2))


def pose_at(rows: DataFrame, poses: DataFrame, stamp: str, place: str, turn: str, keys: list[str], order: str, block: Column) -> DataFrame:
    """Adds m, the pose at each row's stamp: places are mixed in proportion to time, turns (quaternions) by slerp.

    `place` is an array of three numbers and `turn` one of four in `poses`.
    Where a row has no pose on one side, the other side's counts; m is null
    without any. Poses with equal stamps must not occur.
    """
    joined = as_of(rows, poses, stamp, [place, turn], keys, order, block)
    before, after = F.col("before"), F.col("after")
    a, b = F.coalesce(before, after), F.coalesce(after, before)
    share = F.coalesce(F.try_divide((F.col(stamp) - a["stamp"]).cast("double"), (b["stamp"] - a["stamp"]).cast("double")), F.lit(0.0))
    mixed = joined.withColumns({"__turn": slerp(a[turn], b[turn], share), "__place": F.zip_with(a[place], b[place], lambda x, y: x + (y - x) * share)})
    r, t = rotation_matrix(F.col("__turn")), F.col("__place")
    mixed = mixed.withColumn("__r", r)
    m = F.array(*[x for i in range(3) for x in (F.col("__r")[3 * i], F.col("__r")[3 * i + 1], F.col("__r")[3 * i + 2], t[i])])
    return mixed.withColumn("m", F.when(a.isNotNull(), m)).drop("__turn", "__place", "__r", "before", "after")


def frame_bounds(frames: DataFrame, keys: list[str], order: str, stamp: str, edge_ns: int = 50_000_000) -> DataFrame:
    """start_ns and end_ns of each frame: the middles between neighbours' stamps, and a fixed time beyond the first and last. One row for each frame."""
    w = W.partitionBy(*keys).orderBy(order)
    middle = lambda other: F.shiftright(F.col(stamp) + other, 1)
    return frames.withColumns({
        "start_ns": F.coalesce(middle(F.lag(stamp).over(w)), F.col(stamp) - edge_ns),
        "end_ns": F.coalesce(middle(F.lead(stamp).over(w)), F.col(stamp) + edge_ns),
    })
