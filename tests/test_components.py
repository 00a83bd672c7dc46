"""Components of tiled images against a plain flood fill."""

import numpy as np

from lumenframe.operators import components


def flood(mask):
    """First pixel (y, x) of each pixel's component."""
    out, h, w = {}, *mask.shape
    for y, x in np.argwhere(mask).tolist():
        if (y, x) in out:
            continue
        todo, out[y, x] = [(y, x)], (y, x)
        while todo:
            a, b = todo.pop()
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < h and 0 <= d < w and mask[c, d] and (c, d) not in out:
                    out[c, d] = (y, x)
                    todo.append((c, d))
    return out


def images():
    rng = np.random.default_rng(5)
    spiral = np.zeros((41, 41), "f4")
    y, x, dy, dx = 0, 0, 0, 1
    for length in [40, *[n for n in range(40, 0, -2) for _ in (0, 1)]]:
        for _ in range(length):
            spiral[y, x] = 2
            y, x = y + dy, x + dx
        spiral[y, x] = 2
        dy, dx = dx, -dy
    comb = np.zeros((30, 45), "f4")
    comb[:, ::2] = 1
    comb[-1] = 1
    return {"noise": (rng.random((50, 37)) < 0.55).astype("f4") * rng.normal(size=(50, 37)).astype("f4"), "sparse": (rng.random((23, 60)) < 0.1).astype("f4"), "spiral": spiral, "comb": comb, "full": np.ones((20, 20), "f4"), "empty": np.zeros((9, 9), "f4"), "nan": np.where(rng.random((12, 12)) < 0.5, np.nan, 1).astype("f4")}


def test_components(spark):
    """Shapes over many tiles of several sizes: numbers, boxes, means, and each pixel's label."""
    given = images()
    layers = spark.createDataFrame([(k, v.shape[1], v.shape[0], v.ravel().tolist()) for k, v in given.items()], "path string, width int, height int, data array<float>")
    want = {}
    for k, v in given.items():
        of = flood(np.nan_to_num(v) != 0)
        for number, first in enumerate(sorted(set(of.values()))):
            pixels = np.array([p for p, f in of.items() if f == first])
            want[k, number] = (first, len(pixels), tuple(pixels.min(0)), tuple(pixels.max(0)), pixels.mean(0), sum(float(v[tuple(p)]) for p in pixels))
    for size in (7, 64):
        tiles = components.tiles_of(layers, size)
        found = {(r["path"], r["component"]): r for r in components.components(tiles).collect()}
        assert set(found) == set(want)
        for key, (first, n, low, high, mean, value) in want.items():
            r = found[key]
            assert ((r["first_y"], r["first_x"]), r["n"], (r["low_y"], r["low_x"]), (r["high_y"], r["high_x"])) == (first, n, low, high)
            assert np.allclose([r["y"], r["x"], r["value"]], [*mean, value], atol=1e-4)
    for r in components.labelled(components.tiles_of(layers, 7)).collect():
        of = flood(np.nan_to_num(given[r["path"]]) != 0)
        for k, label in enumerate(r["labels"]):
            first = of.get((r["y0"] + k // r["width"], r["x0"] + k % r["width"]))
            assert label == (-1 if first is None else (first[0] << 31) + first[1])


def test_components_odd(spark):
    """No tiles, no pixels, one pixel twice."""
    none = spark.createDataFrame([], components.TILES)
    assert components.components(none).count() == 0 and components.labelled(none).count() == 0
    pixels = spark.createDataFrame([("a", 3, 4, 1.0), ("a", 3, 4, 5.0), ("a", 4, 4, 1.0), ("a", 9, 9, 1.0), ("b", 0, 0, 2.0)], "path string, x int, y int, value double")
    rows = components.components(components.tiles_from_pixels(pixels, 4)).collect()
    assert sorted((r["path"], r["component"], r["n"], r["value"]) for r in rows) == [("a", 0, 2, 6.0), ("a", 1, 1, 1.0), ("b", 0, 1, 2.0)]
