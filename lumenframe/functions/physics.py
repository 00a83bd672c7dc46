"""Electron optics as column expressions: the contrast transfer function and what derives from it.

Units: defocus in micrometres, spherical aberration in millimetres, voltage in kilovolts, phase shift in
units of pi, B factors and pixel sizes in Angstroms, k in 1 / Angstrom.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wavelength(voltage: Column) -> Column:
    """Relativistic wavelength of an electron in Angstroms."""
    v = voltage * 1e3
    return 12.2643247 / F.sqrt(v * (1 + 0.978466e-6 * v))


def ctf_phase(k: Column, defocus: Column, voltage: Column, cs: Column, phase: Column) -> Column:
    l, k2 = wavelength(voltage), k * k
    return math.pi * l * (defocus * -1e4) * k2 + math.pi / 2 * (cs * 1e7) * l * l * l * k2 * k2 - phase * math.pi


def ctf(k: Column, defocus: Column, voltage: Column, cs: Column, amplitude: Column, phase: Column, bfactor: Column, scale: Column, *, absolute: bool = False) -> Column:
    """Value at frequency ``k``, in one dimension; ``absolute``: of its absolute value, what power spectra are fitted with."""
    arg = ctf_phase(k, defocus, voltage, cs, phase)
    value = amplitude * F.cos(arg) - F.sqrt(1 - amplitude * amplitude) * F.sin(arg)
    return (F.abs(value) if absolute else value) * F.exp(bfactor / 4 * k * k) * scale


def ctf_2d(k: Column, angle: Column, defocus: Column, delta: Column, delta_angle: Column, voltage: Column, cs: Column, amplitude: Column, phase: Column, bfactor: Column, scale: Column) -> Column:
    """Value at frequency ``k`` in direction ``angle``, radians, of an astigmatic system."""
    dz = defocus + delta * 0.5 * F.cos(2 * (angle - delta_angle))
    arg = ctf_phase(k, dz, voltage, cs, phase)
    return -F.sin(arg - F.atan(amplitude / F.sqrt(1 - amplitude * amplitude))) * F.exp(bfactor / 4 * k * k) * scale


def frequency_at_phase(phi: Column, defocus: Column, voltage: Column, cs: Column, phase: Column) -> Column:
    """The least positive frequency at which the phase of an underfocused system is ``phi``; null if there is none."""
    l = wavelength(voltage)
    a, b, c = math.pi / 2 * (cs * 1e7) * l * l * l, math.pi * l * (defocus * -1e4), -(phase * math.pi + phi)
    root = F.sqrt(F.when(b * b - 4 * a * c >= 0, b * b - 4 * a * c))
    low, high = F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)
    k2 = F.when(F.abs(a) < 1e-12, F.try_divide(-c, b)).when(low > 0, low).otherwise(high)
    return F.sqrt(F.when(k2 > 0, k2))


def astigmatism(delta: Column, angle: Column) -> Column:
    """Polar astigmatism, its angle in degrees, as a vector of twice the angle."""
    a = 2 * F.radians(angle)
    return F.struct((delta * F.cos(a)).alias("x"), (delta * F.sin(a)).alias("y"))


def defocus_u(defocus: Column, delta: Column) -> Column:
    """In Angstroms, as table writers state it."""
    return (defocus + delta / 2) * 1e4


def defocus_v(defocus: Column, delta: Column) -> Column:
    return (defocus - delta / 2) * 1e4


def read_defocus(u: Column, v: Column) -> Column:
    """What table readers make of U and V. Their difference is halved, the writer's is not: a round trip halves delta."""
    return F.struct(((u + v) * 0.5e-4).alias("defocus"), ((u - v) * 0.5e-4).alias("delta"))


def pixel_size(detector: Column, magnification: Column) -> Column:
    return detector / magnification * 1e4


def dose_weight(k: Column, dose: Column, bfactor_per_dose: float = -4.0) -> Column:
    return F.exp(F.lit(bfactor_per_dose) * dose / 4 * k * k)


def fsc_weight(fsc: Column) -> Column:
    """sqrt(2 f / (1 + f)), 0 where negative."""
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(2 * fsc, 1 + fsc)))
