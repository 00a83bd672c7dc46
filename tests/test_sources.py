"""Files: round trips and edge cases."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumenframe.sources import maps, star, text_formats

STAR = """
data_general
_key  7
_other text

data_shift

loop_
_a #1
_b #2
1\t2
3   4e-1
ragged
5 6

data_shift2
loop_
_c
9
"""


def test_star_blocks(spark, tmp_path):
    (tmp_path / "x.star").write_text(STAR)
    p = str(tmp_path / "x.star")
    assert star.tables(spark, p) == ["general", "shift", "shift2"]
    rows = star.read(spark, p, "shift").orderBy("_row").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", "2"), ("3", "4e-1")]
    assert star.read(spark, p, "shift2").first()["c"] == "9"
    assert star.read(spark, p, "general").first()["other"] == "text"
    assert star.read(spark, p, "shift", limit=1).count() == 1
    assert star.count_rows(spark, p, "shift") == 2
    assert star.read(spark, p, "shift", columns=["a", "zzz"]).first()["zzz"] is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(), st.text("abc.-_", min_size=1, max_size=6)), max_size=5))
def test_star_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([(k, str(a), b) for k, (a, b) in enumerate(rows)], "_k int, x string, y string")
    p = str(tmp_path / "out")
    star.write({"t": df, "u": df}, p, order=["_k"])
    for name in ("t", "u"):
        back = star.read(spark, p, name, columns=["x", "y"]).orderBy("_row").collect()
        assert [(r["x"], r["y"]) for r in back] == [(str(a), b) for a, b in rows]


def test_maps(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(3, 4, 5)).astype("f4")
    (tmp_path / "a.mrc").write_bytes(maps.to_mrc(v, 1.5))
    (tmp_path / "b.em").write_bytes(maps.to_em(v))
    (tmp_path / "c.dat").write_bytes(b"1234" + v.tobytes())
    rows = maps.read(spark, str(tmp_path), raw=(5, 4, 4, "<f4")).collect()
    assert len(rows) == 9
    for r in rows:
        assert np.allclose(r["data"], v[r["z"]].ravel())
    assert maps.read(spark, str(tmp_path), glob="*.mrc", layers=[1]).collect()[0]["pixel_size"] == pytest.approx(1.5)
    mrc = maps.read(spark, str(tmp_path), glob="*.mrc")
    assert bytes(maps.as_mrc(mrc).first()["content"])[1024:] == v.tobytes()
    assert np.allclose(maps.reduce_slices(mrc).first()["data"], v.sum(axis=0).ravel(), atol=1e-5)


def test_mdoc(spark, tmp_path):
    (tmp_path / "s.mdoc").write_text("Tilt axis angle = 85.3, binning = 1\n[ZValue = 0]\nTiltAngle = -3.04\nExposureDose = 2.5\nSubFramePath = X:\\f\\m1.tif\nDateTime = 05-Jan-21  10:11:12\n[ZValue = 1]\nTiltAngle = 0.01\n")
    (tmp_path / "s.xf").write_text("1 0 0 1 2.5 -3\n\n1 0 0 1 0 0\n")
    rows = text_formats.read_mdoc(spark, str(tmp_path / "s.mdoc")).orderBy("zvalue").collect()
    assert (rows[0]["axis"], rows[0]["angle"], rows[0]["dose"], rows[0]["movie"]) == (85.3, -3.0, 2.5, "m1.tif")
    assert rows[0]["time"].hour == 10 and rows[1]["dose"] is None and rows[1]["time"] is None
    both = text_formats.series_tilts(text_formats.read_mdoc(spark, str(tmp_path / "s.mdoc")), text_formats.read_xf(spark, str(tmp_path / "s.xf")))
    assert both.orderBy("angle").first()["dx"] == 2.5
    (tmp_path / "s.xf").write_text("1 0 0 1 2.5 -3\n1 0 0 1 0 0\n1 0 0 1 7 0\n")
    both = text_formats.series_tilts(text_formats.read_mdoc(spark, str(tmp_path / "s.mdoc")), text_formats.read_xf(spark, str(tmp_path / "s.xf")))
    assert both.count() == 3 and both.filter("zvalue is null").first()["dx"] == 7.0


def test_items(spark, tmp_path):
    (tmp_path / "m1.xml").write_text('<?xml version="1.0"?><Movie UnselectManual="null" CTFResolutionEstimate="4.2" MaskPercentage="1"><PS1D>0|1;0.5|2</PS1D><CTF><Param Name="Defocus" Value="1.5"/></CTF><PickingThresholds><Threshold Suffix="box" Value="0.4"/></PickingThresholds></Movie>')
    (tmp_path / "m2.xml").write_text("not xml")
    rows = text_formats.read_items(spark, str(tmp_path / "*.xml")).collect()
    r = next(r for r in rows if r["root_name"] == "m1")
    assert r["manual"] is None and r["resolution"] == 4.2 and r["ctf"] == {"Defocus": "1.5"} and r["picking_thresholds"] == {"box": 0.4}
    assert r["spectrum"][1]["y"] == 2.0 and r["options_movement"] is None


def test_pdb(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("ATOM      1  CA  ALA A   7      11.104   6.134  -6.504  1.00  0.00           C\nEND\n")
    r = text_formats.read_pdb(spark, str(tmp_path / "a.pdb")).first()
    assert (r["name"], r["residue"], r["number"], r["x"], r["z"], r["element"]) == ("CA", "ALA", 7, 11.104, -6.504, "C")
