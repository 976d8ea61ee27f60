"""Vector and angle functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm2(a: Vector) -> Column:
    return dot(a, a)


def norm(a: Vector) -> Column:
    return F.sqrt(norm2(a))


def normalize(a: Vector) -> Vector:
    """The unit vector; a zero vector stays as it is."""
    n = norm(a)
    n = F.when(n > 0, n).otherwise(1.0)
    return a[0] / n, a[1] / n, a[2] / n


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def spherical(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """(range, azimuth, elevation), angles in degrees; azimuth from north (y) to east (x)."""
    flat = F.sqrt(dx * dx + dy * dy)
    return F.sqrt(dx * dx + dy * dy + dz * dz), F.degrees(F.atan2(dx, dy)), F.degrees(F.atan2(dz, flat))


def half_even(x: Column) -> Column:
    """Rounding to whole numbers with halves to the even one."""
    return F.rint(x)


def above(value: Column, limit: Column | float) -> Column:
    """value > limit, false where the value is missing."""
    return F.coalesce(value > limit, F.lit(False))
