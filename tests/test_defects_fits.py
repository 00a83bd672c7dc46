"""Defects against plain loops, fits against numpy."""

import math

import numpy as np
import pytest

from lumenframe.operators import defects, fits


def test_rectangles(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# note\n2 3 4 2\n\n0\t0  1 1\n1 2 3\n5 5 0 3\n3 3 1 2\n")
    r = defects.read_rectangles(spark, str(tmp_path / "r.txt"))
    want = {(x, y) for x0, y0, w, h in ((2, 3, 4, 2), (0, 0, 1, 1), (3, 3, 1, 2)) for x in range(x0, x0 + w) for y in range(y0, y0 + h)}
    rows = defects.defect_pixels(r, 8, 8).collect()
    assert {(p["x"], p["y"]) for p in rows} == want and len(rows) == len(want)
    with pytest.raises(Exception, match="leaves the image: 2, 3"):
        defects.defect_pixels(r, 5, 8).collect()
    (tmp_path / "none.txt").write_text("1 2\n")
    with pytest.raises(ValueError):
        defects.read_rectangles(spark, str(tmp_path / "none.txt"))


def test_marked(spark):
    rng = np.random.default_rng(1)
    rects = [(int(x), int(y), int(w), int(h)) for x, y, w, h in np.column_stack((rng.integers(0, 300, 40), rng.integers(0, 300, 40), rng.integers(0, 30, 40), rng.integers(0, 200, 40)))]
    points = [(k, int(x), int(y)) for k, (x, y) in enumerate(rng.integers(0, 400, (500, 2)))] + [(900, None, 3)]
    df = defects.mark_defects(spark.createDataFrame(points, "id int, x int, y int"), spark.createDataFrame(rects, "x int, y int, width int, height int"))
    found = {r["id"]: r["defect"] for r in df.collect()}
    assert found == {k: x is not None and any(a <= x < a + w and b <= y < b + h for a, b, w, h in rects) for k, x, y in points}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_corrected(spark, radius):
    rng = np.random.default_rng(radius)
    h, w = 24, 30
    mask = rng.random((h, w)) < 0.1
    mask[5:15, 8:20] = True
    mask[0, 0] = mask[h - 1, w - 1] = True
    images = rng.normal(size=(3, h, w)).astype("f4")
    want = images.copy()
    for y, x in np.argwhere(mask).tolist():
        r = radius
        near = []
        while r < w // 2:
            near = [(b, a) for b in range(y - r, y + r) for a in range(x - r, x + r + 1) if 0 <= b < h and 0 <= a < w and (a - x) ** 2 + (b - y) ** 2 <= r * r and not mask[b, a]]
            if len(near) >= round(radius * radius * math.pi) - 1:
                break
            r += 1
        for k in range(3):
            want[k, y, x] = np.mean([images[k, b, a].astype("f8") for b, a in near])
    layers = spark.createDataFrame([(k, w, h, images[k].ravel().tolist()) for k in range(3)], "z int, width int, height int, data array<float>")
    pixels = spark.createDataFrame([(int(x), int(y)) for y, x in np.argwhere(mask)], "x int, y int")
    for r in defects.correct_defects(layers, pixels, radius=radius).collect():
        assert np.allclose(r["data"], want[r["z"]].ravel(), atol=1e-6)
    untouched = defects.correct_defects(layers, pixels.limit(0)).collect()
    assert all(np.array_equal(r["data"], images[r["z"]].ravel()) for r in untouched)
    assert defects.correct_defects(layers.limit(0), pixels).count() == 0


def test_fits(spark):
    rng = np.random.default_rng(2)
    rows = [(k, *(float(v) for v in p)) for k in range(3) for p in np.column_stack((rng.normal(1000, 5, 40), rng.normal(-3, 2, 40), rng.normal(size=40), rng.random(40)))]
    rows += [(7, 2.0, float(k), 1.0, 1.0) for k in range(4)] + [(8, 1.0, 1.0, None, 1.0), (8, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double, z double, w double")
    planes = {r["k"]: r for r in fits.fit_planes(df, ["k"]).collect()}
    lines = {r["k"]: r for r in fits.fit_lines(df, ["k"], weight="w").collect()}
    for k in range(3):
        p = np.array([r[1:] for r in rows if r[0] == k])
        a, *_ = np.linalg.lstsq(np.column_stack((p[:, 0], p[:, 1], np.ones(len(p)))), p[:, 2], rcond=None)
        assert np.allclose([planes[k][c] for c in "abc"], a, rtol=1e-6, atol=1e-7)
        slope, intercept = np.polyfit(p[:, 0], p[:, 1], 1, w=np.sqrt(p[:, 3]))
        assert lines[k]["slope"] == pytest.approx(slope, rel=1e-4) and lines[k]["intercept"] == pytest.approx(intercept, rel=1e-4)
        c = np.cov(p[:, 0], p[:, 1], aweights=p[:, 3])
        assert lines[k]["quality"] == pytest.approx(c[0, 1] ** 2 / (c[0, 0] * c[1, 1]), rel=1e-3)
    assert planes[7]["a"] is None and (lines[7]["slope"], lines[7]["intercept"], lines[7]["quality"]) == (0, 0, 0) and 8 not in planes


def test_flattened(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:9, :13]
    image = (2.5 * x - 1.25 * y + 7 + rng.normal(0, 0.1, (9, 13))).astype("f4")
    layers = spark.createDataFrame([("a", 13, 9, image.ravel().tolist()), ("b", 1, 1, [4.0])], "path string, width int, height int, data array<float>")
    rows = {r["path"]: r for r in fits.flatten_layers(layers).collect()}
    a, *_ = np.linalg.lstsq(np.column_stack((x.ravel(), y.ravel(), np.ones(x.size))), image.ravel().astype("f8"), rcond=None)
    assert np.allclose([rows["a"][f"plane_{n}"] for n in "abc"], a) and np.allclose(rows["a"]["data"], (image - a[0] * x - a[1] * y - a[2]).ravel(), atol=1e-5)
    assert rows["b"]["data"] == [0.0]
