"""Parameter grids and Fourier shells of many items at once: DataFrame forms of the array kernels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import fits, kernels

#: A grid as item records hold it, x fastest.
GRID = "struct<width: int, height: int, depth: int, duration: int, margins: array<float>, values: array<float>>"


def _array(grid: dict) -> tuple[np.ndarray, tuple[float, ...]]:
    margins = tuple(float(m) for m in grid["margins"]) if grid["margins"] is not None else (0.0, 0.0, 0.0)
    return np.asarray(grid["values"], dtype=np.float64).reshape(grid["depth"], grid["height"], grid["width"]), margins


def grid_values(points: DataFrame, grids: DataFrame, *, key: str, grid: str = "grid", parts: int = 1) -> DataFrame:
    """``points`` (key, x, y, z in the unit cube) with value, the key's grid at each: a natural cubic B-spline through its nodes, axes of one node left out.

    Points of keys without a grid have a null value. A key's points are dealt to ``parts`` tasks, each with the key's grid.
    """
    part = F.pmod(F.xxhash64(key, "x", "y", "z"), F.lit(parts)).cast("int")
    p = points.withColumn("_part", part)
    g = grids.select(key, grid).dropDuplicates([key]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = p.drop("_part").withColumn("value", F.lit(0.0)).schema
    schema["value"].nullable = True
    names = schema.names

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        value = np.full(len(left), np.nan)
        if len(left) and len(right) and right[grid].iloc[0] is not None:
            values, margins = _array(right[grid].iloc[0])
            value = kernels.spline_grid(values, left[["x", "y", "z"]].to_numpy(dtype=np.float64), margins)
        return left.assign(value=pd.Series(value, index=left.index, dtype=object).where(~np.isnan(value), None))[names]

    return p.groupBy(key, "_part").cogroup(g.groupBy(key, "_part")).applyInPandas(run, schema)


def resized_grids(grids: DataFrame, dims: tuple[int, int, int], *, grid: str = "grid") -> DataFrame:
    """``grids`` with each grid sampled anew at ``dims`` (x, y, z) nodes; null stays null."""
    x, y, z = dims
    schema = grids.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for g in frame[grid]:
                if g is not None:
                    values, margins = _array(g)
                    g = {"width": x, "height": y, "depth": z, "duration": None, "margins": list(margins), "values": kernels.resize_grid(values, (z, y, x), margins).astype(np.float32).ravel().tolist()}
                out.append(g)
            yield frame.assign(**{grid: out})

    return grids.mapInPandas(run, schema)


def shell_curves(a: DataFrame, b: DataFrame, *, mask: np.ndarray | None = None, from_shell: int | None = None, seed: int = 42) -> DataFrame:
    """(path, shell, fsc) of the cubic maps whose layers (path, z, width, height, data) both tables have, and with a ``mask`` masked, randomised and corrected.

    randomised: of maps whose phases from ``from_shell`` on are random, masked too; without it, from where fsc first falls
    under 0.8. corrected: what masked has beyond randomised. A pair of maps is held by one task, as its transform needs.
    """

    def volume(frame: pd.DataFrame) -> np.ndarray:
        frame = frame.sort_values("z")
        return np.stack([np.asarray(d, dtype=np.float64).reshape(h, w) for d, h, w in zip(frame["data"], frame["height"], frame["width"], strict=True)])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["path", "shell", "fsc", "masked", "randomised", "corrected"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns, dtype=object)
        u, v = volume(left), volume(right)
        if u.shape != v.shape or len(set(u.shape)) != 1:
            raise ValueError(f"maps of {left['path'].iloc[0]} are no cubes of one size")
        fsc = kernels.shells(u, v)
        out = {"path": left["path"].iloc[0], "shell": np.arange(len(fsc)), "fsc": fsc, "masked": None, "randomised": None, "corrected": None}
        if mask is not None:
            low = np.flatnonzero(fsc < 0.8)
            first = from_shell if from_shell is not None else int(low[0]) if len(low) else len(fsc)
            masked = kernels.shells(u * mask, v * mask)
            noise = kernels.shells(kernels.randomise_phases(u, first, seed) * mask, kernels.randomise_phases(v, first, seed + 1) * mask)
            out |= {"masked": masked, "randomised": noise, "corrected": kernels.corrected_fsc(masked, noise, first)}
        return pd.DataFrame(out)[columns]

    columns = ["path", "z", "width", "height", "data"]
    return a.select(columns).groupBy("path").cogroup(b.select(columns).groupBy("path")).applyInPandas(run, "path string, shell int, fsc double, masked double, randomised double, corrected double")


def resolution(curves: DataFrame, *, threshold: float = 0.143, column: str = "corrected") -> DataFrame:
    """(path, shell): the first shell under the threshold, the number of shells where none is; null values count as above."""
    s = curves.groupBy("path").agg(F.min(F.when(F.col(column) < threshold, F.col("shell"))).alias("first"), (F.max("shell") + 1).alias("n"))
    return s.select("path", F.coalesce("first", "n").alias("shell"))


def b_factors(spectra: DataFrame, keys: Sequence[str], *, resolution: str = "resolution", amplitude: str = "amplitude", low: float = 10.0, high: float = 3.0) -> DataFrame:
    """(keys, b_factor, quality): four times the slope of ln(amplitude) over 1 / d^2 between two resolutions in Angstroms, by sums alone."""
    d, a = F.col(resolution).cast("double"), F.col(amplitude).cast("double")
    inside = spectra.filter((d <= low) & (d >= high) & (a > 0)).select(*keys, (1 / (d * d)).alias("_x"), F.ln(a).alias("_y"))
    f = fits.fit_lines(inside, keys, x="_x", y="_y")
    return f.select(*keys, (4 * F.col("slope")).alias("b_factor"), "quality")


def corrected(masked: Column, randomised: Column, shell: Column, from_shell: Column | int) -> Column:
    """(m - r) / (1 - r) from two shells after the first randomised one on."""
    return F.when(shell >= from_shell + 2, (masked - randomised) / F.when(randomised == 1, F.lit(1e-9)).otherwise(1 - randomised)).otherwise(masked)
