"""Connected components of images that lie as tiles: labelled within each tile, joined over tile edges, settled in rounds.

A pixel is in if it is neither 0 nor NaN; pixels are joined by edges, not by corners. A tile's labels are the places of
their first pixels, so that the least label of a component is its first pixel in row order, whatever the tiles. Between
tasks go a row for each component of each tile and the labels along tile edges, no pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import kernels
from lumenframe.plans.shared import dropped, stored

#: Columns of tiles; x0 and y0 are where they begin in their image.
TILES = "path string, x0 int, y0 int, width int, height int, data array<float>"


def tiles_of(layers: DataFrame, size: int = 1024) -> DataFrame:
    """TILES of layers (path, width, height, data), ``size`` pixels wide and high at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, w, h, data in zip(frame["path"], frame["width"], frame["height"], frame["data"], strict=True):
                image = np.asarray(data, dtype=np.float32).reshape(h, w)
                for y in range(0, h, size):
                    for x in range(0, w, size):
                        part = image[y : y + size, x : x + size]
                        yield pd.DataFrame({"path": [path], "x0": x, "y0": y, "width": part.shape[1], "height": part.shape[0], "data": [part.ravel()]})

    return layers.select("path", "width", "height", "data").mapInPandas(run, TILES)


def tiles_from_pixels(pixels: DataFrame, size: int = 1024) -> DataFrame:
    """TILES of the pixels (path, x, y, value) that are not 0; a pixel that comes twice has its greatest value."""
    once = pixels.groupBy("path", "x", "y").agg(F.max("value").alias("value"))
    at = once.withColumns({"x0": (F.floor(F.col("x") / size) * size).cast("int"), "y0": (F.floor(F.col("y") / size) * size).cast("int")})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        tile = np.zeros((size, size), dtype=np.float32)
        tile[frame["y"] - head["y0"], frame["x"] - head["x0"]] = frame["value"]
        return pd.DataFrame({"path": [head["path"]], "x0": [head["x0"]], "y0": [head["y0"]], "width": size, "height": size, "data": [tile.ravel()]})

    return at.groupBy("path", "x0", "y0").applyInPandas(run, TILES)


def _labels(w: int, h: int, x0: int, y0: int, data: np.ndarray) -> np.ndarray:
    """The label of each pixel: y * 2**31 + x of its component's first pixel in the tile, -1 outside."""
    mask = np.nan_to_num(np.asarray(data, dtype=np.float32), nan=0.0).reshape(h, w) != 0
    numbers = kernels.components(mask.astype(np.int8))
    flat = np.flatnonzero(mask.ravel())
    out = np.full(w * h, -1, dtype=np.int64)
    if len(flat):
        _, first, of = np.unique(numbers.ravel()[flat], return_index=True, return_inverse=True)
        y, x = divmod(flat[first], w)
        out[flat] = (((y + y0).astype(np.int64) << 31) + x + x0)[of]
    return out.reshape(h, w)


def _parts(tiles: DataFrame) -> DataFrame:
    """(path, label, n, low_x, high_x, low_y, high_y, sum_x, sum_y, sum_value) for each component of each tile, and (path, label, x, y, side) along tile edges, in one table."""
    schema = "path string, label long, side string, x long, y long, n long, low_x long, high_x long, low_y long, high_y long, sum_x double, sum_y double, sum_value double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                label = _labels(r.width, r.height, r.x0, r.y0, r.data)
                y, x = np.nonzero(label >= 0)
                if not len(x):
                    continue
                values = np.asarray(r.data, dtype=np.float64).reshape(r.height, r.width)[y, x]
                part = pd.DataFrame({"label": label[y, x], "x": x + r.x0, "y": y + r.y0, "v": values})
                g = part.groupby("label").agg(n=("x", "size"), low_x=("x", "min"), high_x=("x", "max"), low_y=("y", "min"), high_y=("y", "max"), sum_x=("x", "sum"), sum_y=("y", "sum"), sum_value=("v", "sum")).reset_index()
                yield g.assign(path=r.path, side=None, x=0, y=0)[[c.split(" ")[0] for c in schema.split(", ")]]
                edges = []
                for side, line, at in (("left", label[:, 0], 0), ("right", label[:, -1], r.width), ("top", label[0], 0), ("bottom", label[-1], r.height)):
                    k = np.flatnonzero(line >= 0)
                    upright = side in ("left", "right")
                    # named by the place just right of or below the edge, where both sides of it meet
                    edges.append(pd.DataFrame({"label": line[k], "side": side, "x": (r.x0 + at if upright else r.x0 + k), "y": (r.y0 + k if upright else r.y0 + at)}))
                yield pd.concat(edges).assign(path=r.path, n=0, low_x=0, high_x=0, low_y=0, high_y=0, sum_x=0.0, sum_y=0.0, sum_value=0.0)[[c.split(" ")[0] for c in schema.split(", ")]]

    return tiles.mapInPandas(run, schema)


def least_labels(edges: DataFrame) -> DataFrame:
    """(path, label, root) for every label of an edge (path, a, b): the least label of the same path that edges reach.

    Each round gives every label the least of its neighbours' roots and then its root's root; it ends when none changes.
    """
    both = edges.filter("a <> b").select("path", "a", "b")
    both = stored(both.unionByName(both.select("path", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = stored(both.groupBy("path", F.col("a").alias("label")).agg(F.least("label", F.min("b")).alias("root")))
    while True:
        near = both.join(roots.select("path", F.col("label").alias("b"), "root"), ["path", "b"]).groupBy("path", F.col("a").alias("label")).agg(F.min("root").alias("low"))
        moved = stored(roots.join(near, ["path", "label"]).select("path", "label", F.least("root", "low").alias("root"), F.col("root").alias("was")))
        on = moved.select("path", F.col("label").alias("root"), F.col("root").alias("next"))
        new = stored(moved.join(on, ["path", "root"]).select("path", "label", F.least("root", "next").alias("root"), "was"))
        changed = not new.filter("root <> was").isEmpty()
        dropped(roots, moved)
        roots = new
        if not changed:
            dropped(both)
            return roots.select("path", "label", "root")


def _settled(parts: DataFrame) -> DataFrame:
    """(path, label, root) of the labels that meet others over a tile edge."""
    edges = parts.filter("side is not null").select("path", "label", "x", "y", "side")
    a, b = edges.filter("side in ('right', 'bottom')"), edges.filter("side in ('left', 'top')")
    kind = F.when(F.col("side").isin("right", "left"), "x").otherwise("y").alias("kind")
    met = a.select("path", kind, "x", "y", F.col("label").alias("a")).join(b.select("path", kind, "x", "y", F.col("label").alias("b")), ["path", "kind", "x", "y"])
    return least_labels(met.select("path", "a", "b").distinct())


def components(tiles: DataFrame) -> DataFrame:
    """(path, component, first_x, first_y, n, low_x, high_x, low_y, high_y, x, y, value): each image's components, numbered from 0 in the order of their first pixels; n pixels, x and y their mean place, value their sum.

    Images without pixels give no rows. Tiles of an image must not overlap.
    """
    parts = stored(_parts(tiles))
    roots = _settled(parts)
    whole = parts.filter("side is null").join(roots, ["path", "label"], "left").groupBy("path", F.coalesce("root", "label").alias("root"))
    total = whole.agg(*[F.sum(c).alias(c) for c in ("n", "sum_x", "sum_y", "sum_value")], *[F.min(c).alias(c) for c in ("low_x", "low_y")], *[F.max(c).alias(c) for c in ("high_x", "high_y")])
    number = (F.row_number().over(Window.partitionBy("path").orderBy("root")) - 1).cast("long")
    return total.select(
        "path", number.alias("component"), F.col("root").bitwiseAND(F.lit((1 << 31) - 1)).alias("first_x"), F.shiftright("root", 31).alias("first_y"), "n", "low_x", "high_x", "low_y", "high_y",
        (F.col("sum_x") / F.col("n")).alias("x"), (F.col("sum_y") / F.col("n")).alias("y"), F.col("sum_value").alias("value"),
    )


def labelled(tiles: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``tiles`` with labels, for each pixel its component's first pixel as y * 2**31 + x, -1 outside: tiles are labelled again and get the few roots that differ."""
    if roots is None:
        roots = _settled(stored(_parts(tiles)))
    # a label lies in the tile of its own place: that is the tile it is looked up by
    own = tiles.select("path", "x0", "y0", "width", "height")
    at = roots.filter("label <> root").select("path", "label", "root", F.col("label").bitwiseAND(F.lit((1 << 31) - 1)).alias("x"), F.shiftright("label", 31).alias("y"))
    width, height = (own.agg(F.max(c)).first()[0] or 1 for c in ("width", "height"))
    # tiles by the cells of a grid of the largest tile's size that they touch: four at most
    grid = own.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor((F.col("x0") + F.col("width") - 1) / width)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / height), F.floor((F.col("y0") + F.col("height") - 1) / height))))
    inside = F.col("x").between(F.col("x0"), F.col("x0") + F.col("width") - 1) & F.col("y").between(F.col("y0"), F.col("y0") + F.col("height") - 1)
    of_tile = at.withColumns({"cx": F.floor(F.col("x") / width), "cy": F.floor(F.col("y") / height)}).join(grid, ["path", "cx", "cy"]).filter(inside).groupBy("path", "x0", "y0").agg(F.collect_list(F.struct("label", "root")).alias("changes"))
    rows = tiles.join(of_tile, ["path", "x0", "y0"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                label = _labels(r.width, r.height, r.x0, r.y0, r.data).ravel()
                if r.changes is not None and len(r.changes):
                    old, new = (np.array([c[k] for c in r.changes]) for k in ("label", "root"))
                    order = np.argsort(old)
                    place = np.minimum(np.searchsorted(old[order], label), len(old) - 1)
                    label = np.where(old[order][place] == label, new[order][place], label)
                out.append(label)
            yield frame.drop(columns="changes").assign(labels=out)[["path", "x0", "y0", "width", "height", "data", "labels"]]

    return rows.select("path", "x0", "y0", "width", "height", "data", "changes").mapInPandas(run, TILES + ", labels array<long>")
