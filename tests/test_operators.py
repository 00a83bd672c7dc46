"""Operators and functions against closed forms and brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import arrays, geometry, hashing, maths, physics, text
from lumenframe.operators import catalog, kernels, matching, quality, ranking, table


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_paths(spark):
    p = F.lit("/a/b.c/d.e.mrc")
    assert one(spark, text.base_name(p)) == "d.e.mrc"
    assert one(spark, text.root_name(p)) == "d.e"
    assert one(spark, text.extension(p)) == ".mrc"
    assert one(spark, text.folder(p)) == "/a/b.c/"
    assert one(spark, text.relative_path(p, F.lit("/a"))) == "b.c/d.e.mrc"
    assert one(spark, text.stack_index(F.lit("0000012@x"))) == 12
    assert one(spark, text.stack_path(F.lit("0000012@x"))) == "x"
    assert one(spark, text.stack_name(F.lit(12), F.lit("x"))) == "0000012@x"
    assert one(spark, text.split_suffixes(F.lit("a, b;;c|"))) == ["a", "b", "c"]
    assert one(spark, text.safe_name(F.lit("a:b?c"))) == "a_b_c"
    assert one(spark, text.shortened(F.lit("abcdefgh"), 6)) == "...fgh"


def test_hash_is_of_utf16(spark):
    import base64
    import hashlib

    want = base64.b64encode(hashlib.sha1("äb".encode("utf-16-le")).digest()).decode().rstrip("=").replace("/", "-").replace("+", "_")
    assert one(spark, hashing.text_hash(F.lit("äb"))) == want


def test_arrays(spark):
    a = F.array(*map(F.lit, (4.0, 1.0, 3.0, 2.0)))
    assert one(spark, arrays.upper_median(a)) == 3.0
    assert one(spark, arrays.first_difference(a)) == [-3.0, 2.0, -1.0]
    assert one(spark, arrays.indices_of(a, lambda x: x > 2)) == [0, 2]
    assert one(spark, arrays.std(a)) == pytest.approx(np.std([4, 1, 3, 2]))
    assert one(spark, arrays.cross_correlation(a, a)) == pytest.approx(1)
    assert one(spark, arrays.convolve(a, F.array(*map(F.lit, (1.0, 0.0, 0.0))))) == [1.0, 3.0, 2.0, 0.0]
    falling = F.array(*map(F.lit, (1.0, 0.8, 0.4, 0.1)))
    assert one(spark, arrays.first_below(falling, 0.5)) == pytest.approx(1.75)
    assert one(spark, arrays.first_below(falling, 0.0)) == 3.0
    assert one(spark, arrays.first_below(falling, 1.0)) == 0.0


def test_scalars(spark):
    assert one(spark, maths.bessel_i0(F.lit(2.0))) == pytest.approx(np.i0(2.0))
    assert one(spark, maths.zernike(2, 0, F.lit(0.5), F.lit(0.0))) == pytest.approx(-0.5)
    assert one(spark, maths.cubic_bspline(F.lit(0.0))) == pytest.approx(2 / 3)
    assert one(spark, maths.histogram_bin(F.lit(10.0), F.lit(0.0), F.lit(10.0), 5)) == 4


def test_ctf_zero_is_where_the_phase_says(spark):
    c = [F.lit(x) for x in (1.0, 300.0, 2.7)]
    k = physics.frequency_at_phase(F.lit(-np.pi), *c, F.lit(0.0))
    value = physics.ctf(k, *c, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert one(spark, value) == pytest.approx(0, abs=1e-9)


def test_round_trip_of_defocus_halves_the_difference(spark):
    back = physics.read_defocus(physics.defocus_u(F.lit(2.0), F.lit(0.4)), physics.defocus_v(F.lit(2.0), F.lit(0.4)))
    got = one(spark, back)
    assert got["defocus"] == pytest.approx(2.0) and got["delta"] == pytest.approx(0.2)


@pytest.mark.parametrize("angles", [(10.0, 20.0, 30.0), (200.0, 90.0, 350.0), (40.0, 0.0, 5.0)])
def test_euler_round_trip(spark, angles):
    m = geometry.from_euler(*map(F.lit, angles))
    back = geometry.to_euler(m)
    again = geometry.from_euler(back["rot"], back["tilt"], back["psi"])
    row = spark.range(1).select(m.alias("a"), again.alias("b")).first()
    assert np.allclose(row["a"], row["b"], atol=1e-9)
    r = np.array(row["a"]).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3))


def test_slerp(spark):
    a, b = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))), F.array(*map(F.lit, (0.0, 1.0, 0.0, 0.0)))
    assert np.allclose(one(spark, geometry.slerp(a, b, F.lit(0.5))), [0.5**0.5, 0.5**0.5, 0, 0])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_optimal_pairs(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    pairs = matching.optimal_pairs(cost)
    k = min(n, m)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == k
    best = min(sum(cost[i, j] for i, j in zip(rows, columns)) for rows in itertools.permutations(range(n), k) for columns in itertools.combinations(range(m), k))
    assert sum(cost[i, j] for i, j in pairs) == best


def test_greedy_pairs_and_limit():
    own, other = np.array([[0.0], [10.0]]), np.array([[1.0], [2.0]])
    assert matching.greedy_pairs(own, other) == [(0, 0, 1.0), (1, 1, 8.0)]
    assert matching.greedy_pairs(own, other, 5.0) == [(0, 0, 1.0)]


def test_keys_of_text_on_one_side_only(spark):
    a = spark.createDataFrame([("p", 1, 0.0), ("q", 2, 5.0)], "k string, id long, x double")
    b = spark.createDataFrame([("q", 3, 6.0), ("r", 4, 1.0)], "k string, id long, x double")
    for how in ("greedy", "optimal"):
        assert [tuple(r) for r in matching.match_particles(a, b, key="k", id_col="id", axes="x", how=how).collect()] == [("q", 2, 3, 1.0)]
    curve = kernels.resample_curves(a.select("k", F.col("x"), F.col("x").alias("y")), b.select("k", "x"), key="k").collect()
    assert [tuple(r) for r in curve] == [("q", 6.0, 5.0)]


def test_curves_by_buckets(spark, monkeypatch):
    """Many curves at once are those of one key each, whatever their number of nodes, also where buckets are many."""
    rng = np.random.default_rng(5)
    curves = {f"k{c}": sorted((float(x), float(y)) for x, y in zip(rng.choice(20, n, replace=False), rng.integers(0, 4, n), strict=True)) for c in range(60) for n in [c % 7 + 1]}
    curves[None] = [(1.0, 2.0), (3.0, 5.0)]
    at = {k: [float(v) for v in rng.uniform(-3, 23, 5)] + [curves[k][0][0], curves[k][-1][0]] for k in curves}
    nodes = spark.createDataFrame([(k, x, y) for k, c in curves.items() for x, y in c + [(c[0][0], c[0][1] + 1)]], "k string, x double, y double")
    points = spark.createDataFrame([(k, x) for k, v in at.items() for x in v] + [("none", 1.0)], "k string, x double")
    expected = sorted((str(k), x, float(v)) for k, c in curves.items() for x, v in zip(at[k], kernels.pchip(*np.array(c).T, np.array(at[k])), strict=True))
    for rows in (1 << 18, 50):
        monkeypatch.setattr(kernels, "BUCKET_ROWS", rows)
        found = kernels.resample_curves(nodes, points, key="k")
        assert "FlatMapCoGroupsInArrow [bucket" in found._jdf.queryExecution().toString()  # no call of Python for each key
        for a, b in zip(sorted((str(r["k"]), r["x"], r["y"]) for r in found.collect()), expected, strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-9)


def test_containment_sends_no_texts_to_the_driver(spark, tmp_path, monkeypatch):
    """Texts that are few bytes in their file, but many rows of stretches, are on the side that is not broadcast."""
    spark.range(3000).select("id", F.concat(F.lit("a word and n"), F.col("id") % 3).alias("label")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    names = rows.select(F.substring("label", 8, 9).alias("word")).union(rows.select(F.lit("a word").alias("word"))).distinct()
    for told in (matching.TOLD, 0):
        monkeypatch.setattr(matching, "TOLD", told)
        found = matching.contains_join(rows, names, "label", "word")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("BuildRight" in plan) == (told > 0)
        assert found.count() == 6000 and found.filter("word = 'a word'").count() == 3000


def test_status_of_an_item_left_out(spark):
    df = spark.createDataFrame([(True, None), (None, None), (None, 1), (None, 2), (False, 1)], "manual boolean, o int")
    s = quality.status(F.col("manual"), F.lit(True), {"ctf": F.col("o")}, {"ctf": (F.lit(True), F.lit(1))}, F.lit(False))
    assert [r[0] for r in df.select(s).collect()] == ["LeaveOut", "Unprocessed", "FilteredOut", "Outdated", "Processed"]


def test_nan_fails_thresholds(spark):
    assert one(spark, quality.at_most(F.lit(float("nan")), 5.0)) is False
    assert one(spark, quality.at_least(F.lit(float("nan")), 5.0)) is False


def test_array_columns_round_trip(spark):
    df = spark.createDataFrame([("1", "2", "3")], ["cX1", "cX2", "other"])
    gathered = table.gather_arrays(df, {"cX": "x"})
    assert gathered.columns == ["other", "x"] and gathered.first()["x"] == [1.0, 2.0]
    assert table.spread_array(gathered, "x", "cX", 2).first()["cX2"] == 2.0


def test_union_with_itself_doubles(spark):
    df = spark.range(5)
    assert table.common_union(df, df).count() == 10
    with pytest.raises(ValueError):
        table.add_column(df, "id", 1)


def test_import_export(spark):
    df = spark.createDataFrame([("10.0", "20.0", "1.0", "2", "a/m.mrc")], ["rlnCoordinateX", "rlnCoordinateY", "rlnOriginX", "rlnRandomSubset", "rlnMicrographName"])
    row = table.import_particles(df, 2.0).first()
    assert (row["x"], row["y"], row["half"], row["source_name"]) == (18.0, 40.0, 1, "m.mrc")
    assert table.export_particles(table.import_particles(df, 2.0), 2.0).first()["rlnCoordinateX"] == 9.0


def test_random_subset_is_stable(spark):
    df = spark.range(100)
    a, b = (sorted(r[0] for r in ranking.random_subset(d, "id", 10).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 10


def test_descendants_end_in_a_cycle(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "n int, p int")
    assert catalog.descendants(df, "n", "p").count() == 9


def test_missing_reference_raises(spark):
    rows, cat = spark.createDataFrame([(1,), (2,)], "r int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no such entry"):
        catalog.resolve(rows, "r", cat, "k").collect()


def test_versions_of_changed_content(spark, tmp_path):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    first = catalog.commit(now, spark.createDataFrame([], "k int, version string"), "k", F.col("c"), str(tmp_path)).cache()
    assert first.count() == 2
    assert catalog.changed(now, first, "k", F.col("c")).count() == 0


def test_pchip_and_grids():
    x = np.array([0.0, 1.0, 2.0, 4.0])
    assert np.allclose(kernels.pchip(x, 2 * x + 1, np.array([-1.0, 0.5, 3.0, 5.0])), [-1, 2, 7, 11])
    v = np.arange(27.0).reshape(3, 3, 3)
    at = np.array([[0.5, 0.5, 0.5], [0.0, 0.0, 0.0], [1.0, 0.5, 0.0]])
    assert np.allclose(kernels.spline_grid(v, at), [13, 0, 5])
    assert np.allclose(kernels.resize_grid(v, (3, 3, 3)), v)


def test_fsc_of_a_map_with_itself():
    v = np.random.default_rng(0).normal(size=(16, 16, 16))
    assert np.allclose(kernels.shells(v, v), 1)
    assert np.allclose(abs(np.fft.rfftn(kernels.randomise_phases(v, 3, 1)))[0, 0, 0], abs(np.fft.rfftn(v))[0, 0, 0])
    r = 1 / np.linspace(0.1, 0.3, 20)
    assert kernels.guinier(r, np.exp(-50 / 4 / r**2), 10, 3.4) == pytest.approx(-50)


def test_peaks_and_components():
    image = np.zeros((8, 8))
    image[2, 2], image[2, 3], image[6, 6] = 5, 4, 3
    assert kernels.local_peaks(image, 2, 1).tolist() == [[2, 2], [6, 6]]
    assert kernels.components(image).max() == 2 and (kernels.components(image) > 0).sum() == 3


def test_defocus_is_found(spark):
    f = np.linspace(0.02, 0.2, 200)
    row = spark.range(1).select(F.array(*[physics.ctf(F.lit(float(k)), *[F.lit(v) for v in (1.23, 300.0, 2.7, 0.07, 0.0, 0.0, 1.0)], absolute=True) for k in f]).alias("p")).first()["p"]
    df = spark.createDataFrame([("a", f.tolist(), row)], "k string, f array<double>, p array<double>")
    got = kernels.fit_defocus(df, key="k", frequency="f", power="p", voltage=300.0, cs=2.7, amplitude=0.07, low=0.5, high=2.0).first()
    assert got["defocus"] == pytest.approx(1.23, abs=0.02)


def test_components_of_variance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [5, 1, 0.2]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    c = kernels.principal_components(df, vector="v", n=2, rounds=10)
    assert abs(c[0, 0]) > 0.98 and abs(c[0] @ c[1]) < 1e-6


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_ids_over_many_ranges(spark, adaptive):
    """Every number from 0 on once, in order, whatever columns a reader asks for; ties and a hot key included."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 600_000
        df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("k"), F.col("id").alias("v"), F.repeat(F.lit("x"), 40).alias("_part"))
        out = table.with_row_id(df, ["k"])
        assert out.columns == ["k", "v", "_part", "row_id"]
        r = out.agg(F.count("*"), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id"), F.count_distinct("v")).first()
        assert tuple(r) == (n, n, 0, n - 1, n)
        low = out.groupBy("k").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"), F.count("*").alias("n"))
        assert low.filter("b - a + 1 <> n").count() == 0
        keys = [x["k"] for x in low.orderBy("a").collect()]
        assert keys == sorted(keys)
        joined = matching.positional_join(spark.range(n).select(F.xxhash64("id").alias("a")), spark.range(n).select(F.xxhash64("id").alias("b"), F.lit("wide").alias("c")), ["a"], ["b"])
        assert joined.filter("a = b").count() == n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_euler_rows_are_the_new_axes(spark):
    a = one(spark, geometry.from_euler(F.lit(30.0), F.lit(40.0), F.lit(50.0)))
    r, t, p = np.radians([30.0, 40.0, 50.0])
    assert a[2] == pytest.approx(-np.cos(p) * np.sin(t)) and a[6] == pytest.approx(np.sin(t) * np.cos(r)) and a[5] == pytest.approx(np.sin(p) * np.sin(t))
    back = one(spark, geometry.to_euler(geometry.from_euler(F.lit(30.0), F.lit(0.0), F.lit(50.0))))
    assert (back["rot"], back["tilt"], back["psi"]) == pytest.approx((0.0, 0.0, 80.0))
