"""Pixels of the sphere and symmetry groups by their own properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import directions


@pytest.mark.parametrize("order", [0, 1, 3])
def test_centres(order):
    """Nested and by rings the same points, evenly spread; four children of a nested pixel surround it."""
    a, b = directions.centres(order), directions.centres(order, nested=False)
    key = lambda x: sorted(map(tuple, np.round(x, 9).tolist()))
    assert len(a) == 12 * 4**order and key(a) == key(b)
    assert np.all(np.diff(b[:, 1]) >= -1e-9) and abs(directions._vectors(a).mean(axis=0)).max() < 1e-12
    v, child = directions._vectors(a), directions._vectors(directions.centres(order + 1))
    near = (child @ v.T).argmax(axis=1)
    assert np.array_equal(near, np.arange(len(child)) // 4)
    upper = directions.centres(order, limit_tilt=91)
    assert len(upper) == (12 * 4**order + 4 * 2**order) // 2 and upper[:, 1].max() <= 90 + 1e-9


def test_pixels(spark):
    """Each centre lies in its own pixel, and pixels have equal areas."""
    rng = np.random.default_rng(3)
    for order in (0, 2, 3):
        c = directions.centres(order, nested=False)
        df = spark.createDataFrame([(k, float(r), float(t)) for k, (r, t) in enumerate(c)], "k int, rot double, tilt double")
        assert df.filter(directions.pixel(F.col("rot"), F.col("tilt"), order) != F.col("k")).count() == 0
        assert df.filter(directions.pixel(F.col("rot") - 720, F.col("tilt"), order) != F.col("k")).count() == 0
    n = 60_000
    points = np.column_stack((rng.uniform(-180, 540, n), np.degrees(np.arccos(rng.uniform(-1, 1, n)))))
    df = spark.createDataFrame(points.tolist(), "rot double, tilt double")
    counts = [r["count"] for r in df.groupBy(directions.pixel(F.col("rot"), F.col("tilt"), 1)).count().collect()]
    assert len(counts) == 48 and max(abs(c - n / 48) for c in counts) < 6 * np.sqrt(n / 48)


def test_angular_bins(spark):
    """Counts of the nearest bins, of directions on either half, against all distances."""
    rng = np.random.default_rng(4)
    bins = directions.centres(2, limit_tilt=91)
    angles = np.column_stack((rng.uniform(-180, 180, 500), rng.uniform(0, 180, 500)))
    df = spark.createDataFrame([*angles.tolist(), (None, 3.0), (1.0, None)], "rot double, tilt double")
    found = {r["bin"]: r["n"] for r in directions.angular_bins(df, "rot", "tilt", bins).collect()}
    want: dict[int, int] = {}
    for rot, tilt in angles:
        rot = rot + 360 if rot < 0 else rot
        rot, tilt = (rot + 180, 180 - tilt) if tilt > 90 else (rot, tilt)
        rot = rot - 360 if rot > 360 else rot
        v = directions._vectors(np.round(np.array([[rot, tilt]]) * 8) / 8)
        k = int(np.round(((v - directions._vectors(bins)) ** 2).sum(axis=1), 9).argmin())
        want[k] = want.get(k, 0) + 1
    assert found == want


@pytest.mark.parametrize("name,size", [("C1", 1), ("C7", 7), ("D3", 6), ("T", 12), ("O", 24), ("I", 60), ("I1", 60), ("I2", 60), ("I3", 60), ("I4", 60)])
def test_groups(name, size):
    """Rotations, all different, of which products and inverses are in the group."""
    g = np.array(directions.symmetry(name)).reshape(-1, 3, 3)
    assert len(g) == size and np.allclose(g[0], np.eye(3)) and np.allclose(np.linalg.det(g), 1) and np.allclose(g @ g.transpose(0, 2, 1), np.eye(3))
    flat = g.reshape(size, 9)
    gap = np.abs(flat[:, None] - flat[None]).max(axis=2)
    assert (gap < 1e-6).sum() == size
    for m in g[: min(size, 8)]:
        assert (np.abs((m @ g).reshape(size, 9)[:, None] - flat[None]).max(axis=2).min(axis=1) < 1e-6).all()
    assert (np.abs(g.transpose(0, 2, 1).reshape(size, 9)[:, None] - flat[None]).max(axis=2).min(axis=1) < 1e-6).all()


def test_expanded(spark):
    df = spark.createDataFrame([(1, 10.0, 50.0, -30.0), (2, 100.0, 120.0, 0.0)], "id int, rot double, tilt double, psi double")
    rows = directions.expand_symmetry(df, "O").collect()
    assert len(rows) == 48 and len({(r["id"], round(r["rot"], 6), round(r["tilt"], 6), round(r["psi"], 6)) for r in rows}) == 48
    first = {r["id"]: r for r in rows if r["copy"] == 0}
    assert first[1]["rot"] == pytest.approx(10) and first[1]["tilt"] == pytest.approx(50) and first[1]["psi"] == pytest.approx(-30)
    turned = [r for r in directions.expand_symmetry(df, "C4").collect() if r["id"] == 1]
    assert sorted(round(r["rot"] % 360, 6) for r in turned) == [10, 100, 190, 280] and {round(r["tilt"], 6) for r in turned} == {50}
    with pytest.raises(ValueError):
        directions.symmetry("Q2")
