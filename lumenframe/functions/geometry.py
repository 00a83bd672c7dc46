"""Rotations as array columns: matrices by rows, 9 numbers; quaternions w, x, y, z; angles in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def multiply(a: Column, b: Column) -> Column:
    """Product of two 3 x 3 matrices."""
    return F.array(*[sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)])


def apply(m: Column, x: Column, y: Column, z: Column) -> Column:
    """The rotated vector as a struct."""
    return F.struct(*[(m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] * z).alias(n) for i, n in enumerate("xyz")])


def transpose(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


def rotate_z(angle: Column) -> Column:
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.array(c, -s, F.lit(0.0), s, c, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def rotate_y(angle: Column) -> Column:
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.array(c, F.lit(0.0), s, F.lit(0.0), F.lit(1.0), F.lit(0.0), -s, F.lit(0.0), c)


def rotate_x(angle: Column) -> Column:
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), c, -s, F.lit(0.0), s, c)


def from_euler(rot: Column, tilt: Column, psi: Column) -> Column:
    """The matrix that turns the frame about z by rot, about the new y by tilt, about the new z by psi: rows are the new axes.

    The product is written out, so that each entry names each angle once or twice and plans stay small.
    """
    (cr, sr), (ct, st), (cp, sp) = ((F.cos(F.radians(x)), F.sin(F.radians(x))) for x in (rot, tilt, psi))
    return F.array(
        cp * ct * cr - sp * sr, cp * ct * sr + sp * cr, -cp * st,
        -sp * ct * cr - cp * sr, -sp * ct * sr + cp * cr, sp * st,
        st * cr, st * sr, ct,
    )


def to_euler(m: Column) -> Column:
    """The angles of ``from_euler``, tilt from 0 to 180; psi holds the whole turn where tilt is 0 or 180."""
    sine = F.hypot(m[2], m[5])
    flat = sine <= 16 * 2.0**-23
    tilt = F.when(flat, F.when(m[8] > 0, 0.0).otherwise(math.pi)).otherwise(F.atan2(sine, m[8]))
    rot = F.when(flat, 0.0).otherwise(F.atan2(m[7], m[6]))
    psi = F.when(flat, F.when(m[8] > 0, F.atan2(-m[3], m[0])).otherwise(F.atan2(m[3], -m[0]))).otherwise(F.atan2(m[5], -m[2]))
    return F.struct(F.degrees(rot).alias("rot"), F.degrees(tilt).alias("tilt"), F.degrees(psi).alias("psi"))


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Spherical interpolation of two unit quaternions along the shorter way."""
    d = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign, c = F.when(d < 0, -1.0).otherwise(1.0), F.least(F.lit(1.0), F.abs(d))
    angle = F.acos(c)
    near = angle < 1e-6
    p = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    q = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    return F.array(*[a[i] * p + b[i] * q for i in range(4)])


def cyclic_symmetry(n: int) -> list[list[float]]:
    """The matrices of C n; those of D n add a half turn about x to each."""
    return [[math.cos(x), -math.sin(x), 0.0, math.sin(x), math.cos(x), 0.0, 0.0, 0.0, 1.0] for x in (2 * math.pi * k / n for k in range(n))]


def dihedral_symmetry(n: int) -> list[list[float]]:
    turned = [[m[0], -m[1], 0.0, m[3], -m[4], 0.0, 0.0, 0.0, -1.0] for m in cyclic_symmetry(n)]
    return cyclic_symmetry(n) + turned


def upper_hemisphere(rot: Column, tilt: Column) -> Column:
    """The direction, as rot and tilt, or its opposite where it points down."""
    down = tilt > 90
    return F.struct(F.when(down, F.pmod(rot + 180, F.lit(360.0))).otherwise(F.pmod(rot, F.lit(360.0))).alias("rot"), F.when(down, 180 - tilt).otherwise(tilt).alias("tilt"))
