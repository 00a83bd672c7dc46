"""Detector defects: rectangles as pixels, points that lie in them, and images whose defects are filled from sound neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an image that share a key where points meet rectangles.
BAND = 64


def read_rectangles(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, width, height) of the lines of a text file that have four numbers; others are left out, a file without any is an error."""
    cells = F.split(F.trim("value"), r"[ \t]+")
    rows = spark.read.text(path).select(cells.alias("c")).filter("size(c) = 4").select(*[F.get("c", F.lit(k)).cast("int").alias(n) for k, n in enumerate(("x", "y", "width", "height"))])
    if rows.isEmpty():
        raise ValueError(f"no rectangles in {path}")
    return rows


def defect_pixels(rectangles: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y) of the pixels of rectangles, each once; one that leaves the image is an error that names it."""
    outside = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("width") > width) | (F.col("y") + F.col("height") > height)
    checked = rectangles.filter("width > 0 and height > 0").withColumn("x", F.when(outside, F.raise_error(F.format_string("a rectangle leaves the image: %d, %d", "x", "y"))).otherwise(F.col("x")))
    rows = checked.select("x", "width", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("height") - 1)).alias("y"))
    return rows.select(F.explode(F.sequence(F.col("x"), F.col("x") + F.col("width") - 1)).alias("x"), "y").distinct()


def mark_defects(points: DataFrame, rectangles: DataFrame, *, x: str = "x", y: str = "y", name: str = "defect") -> DataFrame:
    """``points`` with whether each lies in a rectangle (x, y, width, height). Rectangles meet the points' places by bands of rows; points without a place lie in none."""
    bands = F.sequence(F.floor(F.col("y") / BAND), F.floor((F.col("y") + F.col("height") - 1) / BAND))
    r = rectangles.filter("width > 0 and height > 0").select(F.explode(bands).alias("_band"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    p = points.select(F.col(x).alias("_px"), F.col(y).alias("_py")).distinct().withColumn("_band", F.floor(F.col("_py") / BAND))
    inside = (F.col("_px") >= F.col("_x")) & (F.col("_px") < F.col("_x") + F.col("_w")) & (F.col("_py") >= F.col("_y")) & (F.col("_py") < F.col("_y") + F.col("_h"))
    hit = p.join(r, "_band").filter(inside).select("_px", "_py").distinct().withColumn("_hit", F.lit(True))
    return points.join(hit, (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py")), "left").drop("_px", "_py").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def neighbours(mask: np.ndarray, radius: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places of the defects of an image and for each those of the sound pixels that it is filled from.

    They lie within ``radius``, the row at that distance below not included; where fewer than a whole disc less two pixels
    are sound, the radius grows, up to half the image's width.
    """
    h, w = mask.shape
    least = round(math.pi * radius * radius) - 1
    discs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    places, found = np.flatnonzero(mask), []
    for at in places.tolist():
        y, x, r, near = at // w, at % w, radius, np.zeros(0, np.int64)
        while r < w / 2:
            if r not in discs:
                dy, dx = np.mgrid[-r:r, -r : r + 1]
                inside = dy**2 + dx**2 <= r * r
                discs[r] = dy[inside], dx[inside]
            yy, xx = y + discs[r][0], x + discs[r][1]
            there = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            near = yy[there] * w + xx[there]
            near = near[~mask.ravel()[near]]
            if len(near) >= least:
                break
            r += 1
        found.append(near)
    return places, found


_FOUND: dict[bytes, tuple[np.ndarray, list[np.ndarray]]] = {}


def correct_defects(layers: DataFrame, pixels: DataFrame, *, radius: int = 3) -> DataFrame:
    """Layers (width, height, data, ...) with the mean of its neighbours in place of each defect (x, y).

    Defects are those of one detector: fewer than it has pixels, which go to all tasks as a bit each. A layer of another size
    than the others is an error; a defect without sound neighbours becomes NaN.
    """
    size = layers.select("width", "height").distinct().limit(2).collect()
    if len(size) > 1:
        raise ValueError("layers differ in size")
    if not size:
        return layers
    w, h = size[0]
    mask = np.zeros(w * h, dtype=bool)
    at = pixels.select((F.col("y") * w + F.col("x")).cast("long").alias("at")).distinct().toArrow().column("at").to_numpy()
    mask[at] = True
    shared = layers.sparkSession.sparkContext.broadcast(np.packbits(mask).tobytes())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = shared.value
        if packed not in _FOUND:
            _FOUND.clear()
            _FOUND[packed] = neighbours(np.unpackbits(np.frombuffer(packed, np.uint8), count=w * h).astype(bool).reshape(h, w), radius)
        places, near = _FOUND[packed]
        for frame in frames:
            out = []
            for data in frame["data"]:
                image = np.array(data, dtype=np.float32)
                image[places] = [np.float32(image[k].astype(np.float64).mean()) if len(k) else np.nan for k in near]
                out.append(image)
            yield frame.assign(data=out)

    return layers.mapInPandas(run, layers.schema)
