"""Scalar functions of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x), 1 at 0."""
    return F.when(F.abs(x) < 1e-8, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))


def sinc_squared(x: Column) -> Column:
    return F.pow(sinc(x), F.lit(2.0))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def fraction(x: Column) -> Column:
    """What exceeds the whole number at or below."""
    return x - F.floor(x)


def next_multiple(x: Column, of: int) -> Column:
    return (F.ceil(x / F.lit(of)) * of).cast("long")


def cubic_bspline(x: Column) -> Column:
    """The cubic B-spline of width 4 around 0."""
    a = F.abs(x)
    return F.when(a < 1, 2 / 3 - a * a + a * a * a / 2).when(a < 2, F.pow(2 - a, F.lit(3.0)) / 6).otherwise(0.0)


def bessel_i0(x: Column, terms: int = 40) -> Column:
    """Modified Bessel function of order 0, by its power series."""
    q = x * x / 4
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, k: F.struct((a["t"] * q / (k * k)).alias("t"), (a["s"] + a["t"] * q / (k * k)).alias("s")), lambda a: a["s"])


def kaiser_bessel(x: Column, radius: float, alpha: float) -> Column:
    """Kaiser-Bessel window of order 0, 1 in the middle and 0 beyond the radius."""
    inside = 1 - F.pow(x / radius, F.lit(2.0))
    return F.when(inside >= 0, bessel_i0(F.sqrt(inside) * alpha) / bessel_i0(F.lit(float(alpha)))).otherwise(0.0)


def zernike(n: int, m: int, rho: Column, phi: Column) -> Column:
    """Zernike polynomial; m < 0 takes the sine."""
    k = abs(m)
    radial = F.lit(0.0)
    for s in range((n - k) // 2 + 1 if (n - k) % 2 == 0 else 0):
        c = (-1) ** s * math.factorial(n - s) / (math.factorial(s) * math.factorial((n + k) // 2 - s) * math.factorial((n - k) // 2 - s))
        radial = radial + F.lit(float(c)) * F.pow(rho, F.lit(float(n - 2 * s)))
    return radial * (F.cos(phi * k) if m >= 0 else F.sin(phi * k))


def histogram_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Nearest of ``bins`` places from low to high, clamped: the two end bins are half as wide as the others."""
    at = F.when(high > low, (x - low) / (high - low) * (bins - 1) + 0.5).otherwise(0.0)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), at.cast("int")))
