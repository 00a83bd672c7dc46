"""Item and series records both ways, and populations with their identities."""

import decimal

import pytest
from pyspark.sql.types import StructType

from lumenframe.sources import item_xml

D = decimal.Decimal


def grid(values, w=1, h=1, d=1, t=None, margins=None):
    return {"width": w, "height": h, "depth": d, "duration": t, "margins": margins, "values": [float(v) for v in values]}


def record(**given):
    return {"options": {}, "grids": {}} | given


ITEMS = [
    record(root_name="bare", kind="Movie"),
    record(
        root_name="full", kind="Movie", unselect_filter=True, unselect_manual=False, resolution=D("4.250000"), motion=D("0.125000"), mask=D("12.500000"), bfactor=-1.5, weight=0.75, magnification="1, 0, 0, 1",
        spectrum=[(0.0, 1.5), (0.5, -2.25)], background=[(0.1, 0.2)], scale=[(1e-7, 3e8)],
        ctf={"Defocus": "1.5", "Odd & <name>": 'a "quoted" value'}, options={"OptionsCTF": {"BinTimes": "1.00"}, "OptionsMovement": {}}, picking_thresholds={"_box": D("0.500000"), "": D("1.000000")},
        grids={"GridCTF": grid(range(12), 2, 3, 2, margins=[0.0, 0.5, 1.0]), "GridMovementX": grid([7])}, pyramid_x=[grid([1, 2], 2), grid([3])], pyramid_y=[grid([4])],
    ),
    record(
        root_name="series", kind="TiltSeries", unselect_manual=True, angles_inverted=True, plane_normal="0, 0, 1", grids={"GridVolumeWarpX": grid(range(24), 2, 1, 3, 4)}, ctf={},
        tilts=[(-60.0, 0.0, True, 85.3, 0.5, -0.5, "../a.mrc"), (0.0, 3.1, False, 85.3, 0.0, 0.0, ""), (60.5, 6.2, True, 85.3, 1.0, 1.0, "c.tif")], tilt_spectra=[[(0.0, 1.0)], [(0.5, 2.0), (0.6, 3.0)]], tilt_scales=[[(1.0, 1.0)]],
    ),
    record(root_name="one tilt", kind="TiltSeries", tilts=[(1.5, 0.0, True, 0.0, 0.0, 0.0, "m.mrc")]),
]


def plain(row):
    d = row.asDict(recursive=True)
    d.pop("path")
    return d


def test_round_trip(spark, tmp_path):
    """read(write(x)) = x for items and series, bare and full."""
    schema = StructType.fromDDL(item_xml.SCHEMA)
    df = spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in ITEMS], schema)
    done = item_xml.write(df.repartition(3), str(tmp_path / "out")).collect()
    assert sorted(r["root_name"] for r in done) == sorted(r["root_name"] for r in ITEMS)
    raw = (tmp_path / "out" / "full.xml").read_bytes()
    assert raw[:2] == b"\xff\xfe" and "<Node X=\"1\" Y=\"2\" Z=\"1\" Value=\"11.0\"/>" in raw.decode("utf-16")
    back = {r["root_name"]: plain(r) for r in item_xml.read(spark, str(tmp_path / "out")).collect()}
    want = {r["root_name"]: plain(r) for r in df.collect()}
    assert back == want
    again = item_xml.write(item_xml.read(spark, str(tmp_path / "out")), str(tmp_path / "again")).count()
    assert again == 4 and all((tmp_path / "again" / p.name).read_bytes() == p.read_bytes() for p in (tmp_path / "out").glob("*.xml"))
    with pytest.raises(Exception, match="two records named"):
        item_xml.write(df.union(df), str(tmp_path / "out")).collect()


def test_odd_records(spark, tmp_path):
    """Lone and many parameters, repeats, nodes out of order, missing lists, cells that don't parse, files that are no records; an empty file is no row."""
    (tmp_path / "a.xml").write_text(
        '<?xml version="1.0"?><Movie UnselectManual="null" CTFResolutionEstimate="oops" Bfactor="-2"><PS1D>0|1;x|2;3</PS1D><CTF><Param Name="Defocus" Value="1.5"/></CTF>'
        '<OptionsCTF><Param Name="A" Value="1"/><Param Name="B" Value="2"/><Param Name="A" Value="3"/></OptionsCTF>'
        '<GridCTF Width="2" Height="2"><Node X="1" Y="1" Z="0" Value="4"/><Node X="0" Y="0" Z="0" Value="1"/><Node X="0" Y="0" Z="0" Value="9"/><Node X="7" Y="0" Z="0" Value="5"/></GridCTF><GridCTFPhase/>'
        '<PickingThresholds><Threshold Suffix="box" Value="0.4"/><Threshold Suffix="bad" Value="z"/></PickingThresholds></Movie>'
    )
    (tmp_path / "b.xml").write_bytes(("﻿" + '<TiltSeries UnselectManual="True"><Angles>-1.5\r\n 2</Angles><Dose>1\n2</Dose><TiltPS1D ID="1">5|6</TiltPS1D><TiltPS1D ID="0">7|8</TiltPS1D></TiltSeries>').encode())
    (tmp_path / "c.xml").write_text("not xml")
    (tmp_path / "d.xml").write_text("<Movie><CTF>")
    (tmp_path / "e.xml").write_bytes(b"")
    (tmp_path / "f.xml").write_bytes("<Movie Weight='0.5'><CTF><Param Name='Ö' Value='µ'/></CTF></Movie>".encode("utf-16-be").join([b"\xfe\xff", b""]))
    rows = {r["root_name"]: r for r in item_xml.read(spark, str(tmp_path)).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["kind"], a["unselect_manual"], a["resolution"], a["bfactor"], a["weight"]) == ("Movie", None, None, -2.0, None)
    assert [tuple(p) for p in a["spectrum"]] == [(0.0, 1.0), (None, 2.0), (3.0, None)]
    assert a["ctf"] == {"Defocus": "1.5"} and a["options"] == {"OptionsCTF": {"A": "3", "B": "2"}} and a["picking_thresholds"] == {"box": D("0.400000")}
    assert a["grids"]["GridCTF"]["values"] == [9.0, 0.0, 0.0, 4.0] and a["tilts"] is None
    assert [tuple(t) for t in b["tilts"]] == [(-1.5, 1.0, True, 0.0, 0.0, 0.0, ""), (2.0, 2.0, True, 0.0, 0.0, 0.0, "")]
    assert [[tuple(p) for p in c] for c in b["tilt_spectra"]] == [[(7.0, 8.0)], [(5.0, 6.0)]] and b["unselect_manual"] is True
    assert sorted(rows) == list("abcdf") and rows["c"]["kind"] is None and rows["d"]["grids"] in ({}, None)
    assert rows["f"]["ctf"] == {"Ö": "µ"} and rows["f"]["weight"] == 0.5


G = ["11111111-1111-1111-1111-11111111111%d" % k for k in range(4)]


def population(tmp_path, species, sources):
    entries = lambda tag, xs: "".join(f'<{tag} GUID="{g}" Path="{p}"/>' for g, p in xs)
    (tmp_path / "p").mkdir(exist_ok=True)
    (tmp_path / "s").mkdir(exist_ok=True)
    (tmp_path / "p" / "all.population").write_bytes(f'<?xml version="1.0" encoding="utf-16"?>\n<Population><Param Name="Name" Value="x"/><Species>{entries("Species", species)}</Species><Sources>{entries("Source", sources)}</Sources></Population>'.encode("utf-16"))
    (tmp_path / "s" / "a.species").write_text(f'<Species><Param Name="GUID" Value="{G[0]}"/><Param Name="Name" Value="ribosome"/><UsedDataSources><DataSource GUID="{G[1]}" Version="ab"/><DataSource GUID="{G[3]}" Version="cd"/></UsedDataSources></Species>')
    (tmp_path / "s" / "b.source").write_text(f'<DataSource><Param Name="GUID" Value="{{{G[1].upper()}}}"/><Param Name="Name" Value="day 1"/><UsedSpecies><Species GUID="{G[0]}" Version="1"/></UsedSpecies><Files><File Hash="h1" Name="m1.tif"/></Files></DataSource>')
    return str(tmp_path / "p"), str(tmp_path / "s")


def test_population(spark, tmp_path):
    p, s = population(tmp_path, [(G[0], "..\\s\\a.species")], [(G[1], "../s/./b.source")])
    listed, species, sources = item_xml.read_population(spark, p), item_xml.read_species(spark, s), item_xml.read_sources(spark, s)
    (a,), (b,) = item_xml.checked(listed, species, "species").collect(), item_xml.checked(listed, sources, "source").collect()
    assert (a["name"], a["guid"], b["name"], b["guid"]) == ("ribosome", G[0], "day 1", G[1])
    assert [tuple(f) for f in b["files"]] == [("h1", "m1.tif")] and [tuple(u) for u in b["used_species"]] == [(G[0], "1")]
    assert [r["guid"] for r in item_xml.unresolved(species, sources, "used_sources").collect()] == [G[3]]
    assert item_xml.unresolved(sources, species, "used_species").count() == 0


def test_population_mismatch(spark, tmp_path):
    """Another identity, or a file that is not there, fails the job and names the entry."""
    p, s = population(tmp_path, [(G[2], "../s/a.species")], [(G[1], "../s/gone.source")])
    listed = item_xml.read_population(spark, p)
    with pytest.raises(Exception, match="stored identity of species .*a.species"):
        item_xml.checked(listed, item_xml.read_species(spark, s), "species").collect()
    with pytest.raises(Exception, match="no file of source .*gone.source"):
        item_xml.checked(listed, item_xml.read_sources(spark, s), "source").collect()
    (tmp_path / "s" / "bad.species").write_text("<Other/>")
    with pytest.raises(Exception, match="no Species"):
        item_xml.read_species(spark, s).collect()
