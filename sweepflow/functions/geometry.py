"""Vectors, rigid transforms and angles as Column expressions.

Vectors are structs of x, y, z; poses arrays of 12 doubles, the rows of [R | t].
Missing returns are null, never NaN: in Spark a NaN is greater than any number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def vec(x, y, z) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))
    return F.struct(lit(x).cast("double").alias("x"), lit(y).cast("double").alias("y"), lit(z).cast("double").alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scale(a: Column, s) -> Column:
    return vec(a["x"] * s, a["y"] * s, a["z"] * s)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def length_squared(a: Column) -> Column:
    return dot(a, a)


def length(a: Column) -> Column:
    return F.sqrt(length_squared(a))


def normed(a: Column) -> Column:
    """Null for the zero vector."""
    n = length(a)
    return vec(F.try_divide(a["x"], n), F.try_divide(a["y"], n), F.try_divide(a["z"], n))


def least(a: Column, b: Column) -> Column:
    return vec(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.least(a["z"], b["z"]))


def greatest(a: Column, b: Column) -> Column:
    return vec(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), F.greatest(a["z"], b["z"]))


def line_distance(p: Column, start: Column, end: Column) -> Column:
    """Distance of a point from the line through two points."""
    d, q = sub(end, start), sub(p, start)
    along = dot(q, d)
    return F.sqrt(F.greatest(F.lit(0.0), length_squared(q) - F.try_divide(along * along, length_squared(d))))


def azimuth_plane(a: Column) -> Column:
    """Distance from the vertical axis, and height."""
    return F.struct(F.sqrt(a["x"] * a["x"] + a["y"] * a["y"]).alias("r"), a["z"].alias("z"))


def is_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def transform(m: Column, p: Column) -> Column:
    """R p + t."""
    row = lambda i: m[4 * i] * p["x"] + m[4 * i + 1] * p["y"] + m[4 * i + 2] * p["z"] + m[4 * i + 3]
    return vec(row(0), row(1), row(2))


def translation(m: Column) -> Column:
    return vec(m[3], m[7], m[11])


def inverse(m: Column) -> Column:
    """The inverse of a rigid transform: R^T and -R^T t."""
    t = lambda i: -(m[i] * m[3] + m[4 + i] * m[7] + m[8 + i] * m[11])
    return F.array(*[x for i in range(3) for x in (m[i], m[4 + i], m[8 + i], t(i))])


def compose(a: Column, b: Column) -> Column:
    cell = lambda i, j: sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 3)), a[4 * i] * b[j]) + (a[4 * i + 3] if j == 3 else F.lit(0.0))
    return F.array(*[cell(i, j) for i in range(3) for j in range(4)])


def increasing_azimuth(azimuth: Column, clockwise: bool = True) -> Column:
    """The azimuth as an angle from 0 to 2 pi that grows as the sensor turns."""
    return math.pi - azimuth if clockwise else azimuth + math.pi


def column_in_rotation(angle: Column, num_columns: int) -> Column:
    """Angles are not negative, so floor() does what truncation would."""
    return F.floor(angle / F.lit(TWO_PI / num_columns)).cast("long")


def continuous_azimuth(rotation: Column, angle: Column) -> Column:
    return rotation * F.lit(TWO_PI) + angle


def inclination(relative: Column) -> Column:
    return F.asin(F.try_divide(relative["z"], length(relative)))


def max_angle(distance: Column, max_distance: float) -> Column:
    """The angle under which max_distance is seen; null nearer than that."""
    return F.when(distance >= max_distance, F.asin(F.try_divide(F.lit(max_distance), distance)))


def pack_id(sequence: Column, frame: Column, index: Column) -> Column:
    """16, 16 and 32 bits. A missing index stands for no point."""
    packed = F.shiftleft(sequence.cast("long"), 48).bitwiseOR(F.shiftleft(frame.cast("long"), 32)).bitwiseOR(index.cast("long"))
    return F.when(index >= 0, packed)


def unpack_id(packed: Column) -> tuple[Column, Column, Column]:
    return (F.shiftrightunsigned(packed, 48).bitwiseAND(F.lit(0xFFFF)).cast("int"), F.shiftrightunsigned(packed, 32).bitwiseAND(F.lit(0xFFFF)).cast("int"), packed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
