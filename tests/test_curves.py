"""Grids and shells of many items against the kernels on each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import curves, kernels


def test_grids(spark):
    rng = np.random.default_rng(1)
    shapes = {"a": (2, 3, 4), "b": (1, 1, 5), "c": (1, 1, 1)}
    given = {k: rng.normal(size=s).astype("f4") for k, s in shapes.items()}
    rows = [(k, (v.shape[2], v.shape[1], v.shape[0], None, [0.0, 0.1, 0.0] if k == "a" else None, v.ravel().tolist())) for k, v in given.items()] + [("none", None)]
    grids = spark.createDataFrame(rows, f"item string, grid {curves.GRID}")
    at = [(k, n, *(float(x) for x in rng.random(3))) for n, k in enumerate(["a"] * 30 + ["b"] * 5 + ["c", "none", "missing"])]
    points = spark.createDataFrame(at, "item string, n int, x double, y double, z double")
    for parts in (1, 4):
        found = {r["n"]: r["value"] for r in curves.grid_values(points, grids, key="item", parts=parts).collect()}
        assert len(found) == len(at)
        for k, n, *p in at:
            if k in given:
                assert found[n] == pytest.approx(kernels.spline_grid(given[k].astype("f8"), np.array([p]), (0.0, 0.1, 0.0) if k == "a" else (0.0, 0.0, 0.0))[0], abs=1e-6)
            else:
                assert found[n] is None
    same = {r["item"]: r["grid"] for r in curves.resized_grids(grids.filter("item in ('b', 'none')"), (5, 1, 1)).collect()}
    assert np.allclose(same["b"]["values"], given["b"].ravel(), atol=1e-5) and same["none"] is None
    more = curves.resized_grids(grids.filter("item = 'a'"), (7, 5, 3)).first()["grid"]
    assert (more["width"], more["height"], more["depth"], len(more["values"])) == (7, 5, 3, 105)


def layers(spark, maps):
    return spark.createDataFrame([(k, z, v.shape[2], v.shape[1], v[z].ravel().tolist()) for k, v in maps.items() for z in range(len(v))], "path string, z int, width int, height int, data array<double>").repartition(5)


def test_shells(spark):
    """Half maps of a smooth signal and noise: equal to the kernels, and the mask's own correlation is taken off."""
    rng = np.random.default_rng(2)
    n = 24
    z, y, x = np.indices((n, n, n)) - n / 2
    r = np.sqrt(x**2 + y**2 + z**2)
    signal, mask = np.exp(-(r**2) / 8), (r < 5).astype(float)
    a = {k: signal + s * rng.normal(size=signal.shape) for k, s in (("m", 0.05), ("n", 0.5))}
    b = {k: signal + s * rng.normal(size=signal.shape) for k, s in (("m", 0.05), ("n", 0.5))}
    plain = curves.shell_curves(layers(spark, a), layers(spark, b | {"alone": signal})).collect()
    assert {r["path"] for r in plain} == {"m", "n"} and plain[0]["masked"] is None
    rows = curves.shell_curves(layers(spark, a), layers(spark, b), mask=mask)
    for k in "mn":
        own = sorted((r for r in rows.collect() if r["path"] == k), key=lambda r: r["shell"])
        fsc = kernels.shells(a[k], b[k])
        assert np.allclose([r["fsc"] for r in own], fsc) and np.allclose([r["masked"] for r in own], kernels.shells(a[k] * mask, b[k] * mask))
        first = int(np.flatnonzero(fsc < 0.8)[0])
        assert [r["corrected"] for r in own[: first + 2]] == [r["masked"] for r in own[: first + 2]]
    again = rows.withColumn("c", curves.corrected(F.col("masked"), F.col("randomised"), F.col("shell"), 3))
    assert again.filter("shell < 5 and c <> masked").count() == 0
    found = {r["path"]: r["shell"] for r in curves.resolution(rows).collect()}
    assert 0 < found["n"] <= found["m"] <= n // 2
    with pytest.raises(Exception, match="no cubes"):
        curves.shell_curves(layers(spark, {"q": signal[:5]}), layers(spark, {"q": signal[:5]})).collect()


def test_b_factors(spark):
    d = 1 / np.linspace(0.05, 0.4, 60)
    rows = [(k, float(x), float(np.exp(b / 4 / x**2 + 3))) for k, b in (("u", -50.0), ("v", -120.0)) for x in d] + [("u", 5.0, 0.0), ("u", 5.0, None), ("w", 99.0, 1.0)]
    found = {r["k"]: r["b_factor"] for r in curves.b_factors(spark.createDataFrame(rows, "k string, resolution double, amplitude double"), ["k"]).collect()}
    assert found == {"u": pytest.approx(-50), "v": pytest.approx(-120)}
