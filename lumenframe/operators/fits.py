"""Lines and planes through points of a key, by sums that Spark adds up, and planes taken off images."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_lines(points: DataFrame, keys: Sequence[str], *, x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """(keys, slope, intercept, quality): weighted least squares; quality is the squared correlation. 0 each where x does not vary; rows with a null count for nothing."""
    w = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(weight) if weight else F.lit(1.0))
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    s = points.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * cx).alias("x"), F.sum(w * cy).alias("y"), F.sum(w * cx * cx).alias("xx"), F.sum(w * cy * cy).alias("yy"), F.sum(w * cx * cy).alias("xy"))
    mx, my = F.try_divide("x", "w"), F.try_divide("y", "w")
    sxx, syy, sxy = F.col("xx") - F.col("w") * mx * mx, F.col("yy") - F.col("w") * my * my, F.col("xy") - F.col("w") * mx * my
    s = s.select(*keys, mx.alias("mx"), my.alias("my"), sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), F.col("xx").alias("all"))
    # what is left of x's spread after the subtraction may be rounding alone
    varies = F.col("sxx") > 1e-12 * F.col("all")

    def fit(value: Column) -> Column:
        return F.when(varies, value).otherwise(F.lit(0.0))

    slope = F.try_divide("sxy", "sxx")
    return s.select(*keys, fit(slope).alias("slope"), fit(F.col("my") - slope * F.col("mx")).alias("intercept"), fit(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))).alias("quality"))


def fit_planes(points: DataFrame, keys: Sequence[str], *, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(keys, a, b, c) of the plane z = a x + b y + c through the points of each key by least squares; null where they lie on a line. Rows with a null count for nothing."""
    good = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    cov = {n: F.covar_pop(F.col(p).cast("double"), F.col(q).cast("double")) for n, (p, q) in {"xx": (x, x), "xy": (x, y), "yy": (y, y), "xz": (x, z), "yz": (y, z)}.items()}
    s = good.groupBy(*keys).agg(*[c.alias(n) for n, c in cov.items()], *[F.avg(F.col(c).cast("double")).alias(n) for n, c in (("mx", x), ("my", y), ("mz", z))])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    flat = det <= 1e-12 * F.col("xx") * F.col("yy")
    a = F.when(~flat, (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det)
    b = F.when(~flat, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det)
    return s.select(*keys, a.alias("a"), b.alias("b"), (F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"))


def image_plane(image: np.ndarray) -> tuple[float, float, float]:
    """The plane through an image's values: x and y of a grid don't go together, so that each slope stands alone."""
    h, w = image.shape
    x, y = np.arange(w) - (w - 1) / 2, np.arange(h) - (h - 1) / 2
    a = float((image.sum(axis=0) * x).sum() / (h * (x**2).sum())) if w > 1 else 0.0
    b = float((image.sum(axis=1) * y).sum() / (w * (y**2).sum())) if h > 1 else 0.0
    return a, b, float(image.mean()) - a * (w - 1) / 2 - b * (h - 1) / 2


def flatten_layers(layers: DataFrame) -> DataFrame:
    """Layers (width, height, data, ...) less the plane through their values, with the plane as plane_a, plane_b and plane_c."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, planes = [], []
            for w, h, data in zip(frame["width"], frame["height"], frame["data"], strict=True):
                image = np.asarray(data, dtype=np.float64).reshape(h, w)
                a, b, c = image_plane(image)
                out.append((image - a * np.arange(w) - b * np.arange(h)[:, None] - c).astype(np.float32).ravel())
                planes.append((a, b, c))
            yield frame.assign(data=out, **{f"plane_{n}": [p[k] for p in planes] for k, n in enumerate("abc")})

    schema = layers.limit(0).select("*", *[F.lit(0.0).alias(f"plane_{n}") for n in "abc"]).schema
    return layers.mapInPandas(run, schema)
