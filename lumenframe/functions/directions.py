"""Directions on the sphere: equal-area pixels of twelve faces, their centres, and symmetry groups of rotations; angles in degrees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry

# Ring and longitude of the twelve faces, in units of a face.
_FACE_RING = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
_FACE_TURN = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])


def _even_bits(v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for k in range(30):
        out |= ((v >> (2 * k)) & 1) << k
    return out


def centres(order: int, *, nested: bool = True, limit_tilt: float | None = None) -> np.ndarray:
    """(rot, tilt) of the pixels of 12 * 4**order, in nested order or by rings from the pole; with a limit those of at most that tilt."""
    side = 1 << order
    pixel = np.arange(12 * side * side)
    if nested:
        face, within = pixel // (side * side), pixel % (side * side)
        x, y = _even_bits(within), _even_bits(within >> 1)
        ring = _FACE_RING[face] * side - x - y - 1
        cap = np.minimum(ring, 4 * side - ring)
        n = np.minimum(cap, side)  # a fourth of the ring's pixels
        shift = np.where(cap >= side, (ring - side) & 1, 0)
        place = (_FACE_TURN[face] * n + x - y + 1 + shift) // 2
        place = np.where(place > 4 * side, place - 4 * side, np.where(place < 1, place + 4 * side, place))
    else:
        sizes = 4 * np.minimum(np.minimum(np.arange(1, 4 * side), np.arange(4 * side - 1, 0, -1)), side)
        ring = np.repeat(np.arange(1, 4 * side), sizes)
        place = pixel - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        cap = np.minimum(ring, 4 * side - ring)
        n = np.minimum(cap, side)
        shift = np.where(cap >= side, (ring - side) & 1, 0)
    z = np.where(cap < side, 1 - cap**2 / (3 * side**2), (2 * side - np.minimum(ring, 4 * side - ring)) * 2 / (3 * side))
    z = np.where(ring > 2 * side, -z, z)
    out = np.column_stack((((place - (shift + 1) * 0.5) * 90 / n) % 360, np.degrees(np.arccos(np.clip(z, -1, 1)))))
    return out if limit_tilt is None else out[out[:, 1] <= limit_tilt]


def pixel(rot: Column, tilt: Column, order: int) -> Column:
    """The number, by rings, of the pixel that a direction lies in."""
    side = 1 << order
    z, turn = F.cos(F.radians(tilt)), F.pmod(rot / 90, F.lit(4.0))
    belt_a, belt_b = side * (0.5 + turn), side * z * 0.75
    up, down = F.floor(belt_a - belt_b), F.floor(belt_a + belt_b)
    ring = side + 1 + up - down  # from 1 on within the belt
    place = F.pmod(F.floor((up + down - side + F.when(ring % 2 == 0, 1).otherwise(0) + 1) / 2), F.lit(4 * side))
    belt = 2 * side * (side - 1) + 4 * side * (ring - 1) + place
    part, reach = turn - F.floor(turn), side * F.sqrt(F.greatest(F.lit(0.0), 3 * (1 - F.abs(z))))
    cap_ring = F.floor(part * reach) + F.floor((1 - part) * reach) + 1
    cap_place = F.pmod(F.floor(turn * cap_ring), 4 * cap_ring)
    north, south = 2 * cap_ring * (cap_ring - 1) + cap_place, 12 * side * side - 2 * cap_ring * (cap_ring + 1) + cap_place
    return F.when(F.abs(z) <= 2 / 3, belt).when(z > 0, north).otherwise(south).cast("long")


def _vectors(angles: np.ndarray) -> np.ndarray:
    rot, tilt = np.radians(angles[:, 0]), np.radians(angles[:, 1])
    return np.column_stack((np.sin(tilt) * np.cos(rot), np.sin(tilt) * np.sin(rot), np.cos(tilt)))


def angular_bins(rows: DataFrame, rot: str, tilt: str, bins: np.ndarray, oversample: int = 8) -> DataFrame:
    """(bin, rot, tilt, n): how many directions each of the ``bins`` (rot, tilt) of the upper half has; bins without any have no row.

    A direction that points down counts as its opposite. Directions are counted on a grid of 1 / ``oversample`` degrees
    first, which bounds what is compared with all bins: the nearest is taken, of those equally near, to a thousand
    millionth, the first. Rows with a null angle are left out.
    """
    r, t = F.col(rot).cast("double"), F.col(tilt).cast("double")
    r = F.when(r < 0, r + 360).otherwise(r)
    r = F.when(t > 90, r + 180).otherwise(r)
    r = F.when(r > 360, r - 360).otherwise(r)
    t = F.when(t > 90, 180 - t).otherwise(t)
    clamp = lambda x, top: F.greatest(F.lit(0), F.least(F.lit(top * oversample), F.rint(x * oversample).cast("int")))
    cells = rows.filter(F.col(rot).isNotNull() & F.col(tilt).isNotNull()).groupBy(clamp(r, 360).alias("r"), clamp(t, 90).alias("t")).agg(F.count("*").alias("n"))
    centre = _vectors(bins)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 4096):
                part = frame.iloc[k : k + 4096]
                at = _vectors(part[["r", "t"]].to_numpy(dtype=np.float64) / oversample)
                best = np.round(((at[:, None] - centre[None]) ** 2).sum(axis=2), 9).argmin(axis=1)
                yield pd.DataFrame({"bin": best.astype(np.int32), "rot": bins[best, 0], "tilt": bins[best, 1], "n": part["n"].to_numpy()})

    return cells.mapInPandas(nearest, "bin int, rot double, tilt double, n long").groupBy("bin", "rot", "tilt").agg(F.sum("n").alias("n"))


# --- symmetry ----------------------------------------------------------------

_PHI = (1 + math.sqrt(5)) / 2
# Two axes of each group, as (turns that make a whole, direction), which all its rotations are made of.
AXES = {
    "T": [(3, (0, 0, 1)), (2, (0, math.sqrt(2), 1))],
    "O": [(3, (1, 1, 1)), (4, (0, 0, 1))],
    "I1": [(2, (0, 0, 1)), (5, (_PHI, 0, -1))],
    "I2": [(2, (0, 0, 1)), (5, (-1, 0, _PHI))],
    "I3": [(2, (-1, 0, _PHI)), (5, (0, 0, 1))],
    "I4": [(2, (1, 0, _PHI)), (5, (0, 0, -1))],
}


def about(axis: tuple[float, float, float], angle: float) -> np.ndarray:
    """The rotation about an axis by an angle in degrees."""
    x, y, z = np.array(axis, dtype=np.float64) / math.sqrt(sum(v * v for v in axis))
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    a = math.radians(angle)
    return np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * (k @ k)


def symmetry(name: str) -> list[list[float]]:
    """The rotations of C n, D n, T, O, I (as I2), I1 to I4, identity first, as nine numbers by rows each."""
    name = name.strip().upper()
    if name[:1] in ("C", "D") and name[1:].isdigit() and int(name[1:]) > 0:
        return (geometry.cyclic_symmetry if name[0] == "C" else geometry.dihedral_symmetry)(int(name[1:]))
    name = "I2" if name == "I" else name
    if name not in AXES:
        raise ValueError(f"no symmetry {name}")
    made = [np.eye(3)]
    turns = [about(axis, 360 / n) for n, axis in AXES[name]]
    for m in made:  # grows while it is gone through, until products are all known
        for t in turns:
            new = t @ m
            if not any(np.allclose(new, x, atol=1e-9) for x in made):
                made.append(new)
    return [m.ravel().tolist() for m in made]


def expand_symmetry(rows: DataFrame, name: str, *, rot: str = "rot", tilt: str = "tilt", psi: str = "psi", index: str = "copy") -> DataFrame:
    """Each row once for each rotation of the group, with the angles of its orientation after it, and the rotation's number."""
    group = F.array(*[F.array(*map(F.lit, m)) for m in symmetry(name)])
    out = rows.select("*", F.posexplode(group).alias(index, "_turn"))
    # rows of the matrix are the new axes: the group turns what they are written in
    angles = geometry.to_euler(geometry.multiply(geometry.from_euler(F.col(rot), F.col(tilt), F.col(psi)), F.col("_turn")))
    return out.withColumn("_angles", angles).withColumns({rot: F.col("_angles.rot"), tilt: F.col("_angles.tilt"), psi: F.col("_angles.psi")}).drop("_turn", "_angles")
