"""Range reads of maps, every sample type both ways, and reductions."""

import struct

import numpy as np
import pytest

from lumenframe.sources import maps


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, file, counts):
        self.file, self.counts = file, counts

    def read(self, n=-1):
        raw = self.file.read(n)
        self.counts.append(len(raw))
        return raw

    def seek(self, *a):
        return self.file.seek(*a)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def test_one_layer_reads_one_layer(tmp_path, monkeypatch):
    """A layer of a stack of 64 costs the header and that layer, and no file is opened to plan."""
    v = np.arange(64 * 50 * 40, dtype="f4").reshape(64, 50, 40)
    (tmp_path / "big.mrc").write_bytes(maps.to_mrc(v))
    counts, opened = [], maps.open_file
    monkeypatch.setattr(maps, "open_file", lambda p: Counted(opened(p), counts))
    reader = maps.MapReader({"path": str(tmp_path / "big.mrc"), "layers": "17", "split": "1000"})
    parts = reader.partitions()
    assert not counts and len(parts) == 1
    (batch,) = list(reader.read(parts[0]))
    assert sum(counts) == 1024 + 50 * 40 * 4
    assert np.array_equal(batch.column("data")[0].values.to_numpy(), v[17].ravel())
    # without layers the parts share them out, each once
    reader = maps.MapReader({"path": str(tmp_path / "big.mrc"), "split": "100000"})
    zs = [b.column("z")[0].as_py() for p in reader.partitions() for b in reader.read(p)]
    assert len(reader.partitions()) == 6 and sorted(zs) == list(range(64))


def test_conditions_on_z(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    v = np.random.default_rng(1).normal(size=(20, 3, 4)).astype("f4")
    (tmp_path / "a.mrcs").write_bytes(maps.to_mrc(v))
    counts, opened = [], maps.open_file
    monkeypatch.setattr(maps, "open_file", lambda p: Counted(opened(p), counts))
    for given, kept, rest in (([EqualTo(("z",), 3)], [3], 0), ([In(("z",), (1, 5, 99))], [1, 5], 0), ([GreaterThan(("z",), 4), LessThanOrEqual(("z",), 7)], [5, 6, 7], 0), ([StringContains(("path",), "a")], list(range(20)), 1)):
        reader = maps.PushingReader({"path": str(tmp_path)})
        assert len(list(reader.pushFilters(given))) == rest
        counts.clear()
        assert [b.column("z")[0].as_py() for p in reader.partitions() for b in reader.read(p)] == kept
        assert sum(counts) == 1024 + 48 * len(kept)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    for on in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
        rows = maps.read(spark, str(tmp_path)).filter("z in (2, 4) and width = 4").collect()
        assert sorted(r["z"] for r in rows) == [2, 4] and all(np.allclose(r["data"], v[r["z"]].ravel()) for r in rows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


@pytest.mark.parametrize("ext,mode", [("mrc", m) for m in maps.MRC_MODES] + [("em", m) for m in maps.EM_MODES])
def test_every_sample_type(spark, tmp_path, ext, mode):
    """Each mode is read as it was written, by layers and as whole bytes, in both byte orders."""
    kind, samples = (maps.MRC_MODES if ext == "mrc" else maps.EM_MODES)[mode]
    rng = np.random.default_rng(mode)
    v = rng.integers(0, 255, (3, 4, 5 * samples)).astype("f4") if kind[0] in "iu" else rng.normal(size=(3, 4, 5 * samples)).astype("f4")
    if kind in ("i2", "i4"):
        v -= 100
    (tmp_path / "in").mkdir()
    raw = (maps.to_mrc if ext == "mrc" else maps.to_em)(v, 1.25, mode)
    (tmp_path / "in" / f"a.{ext}").write_bytes(raw)
    rows = maps.read(spark, str(tmp_path / "in"))
    assert all(np.array_equal(r["data"], v[r["z"]].ravel()) and (r["width"], r["height"], r["depth"], r["samples"], r["pixel_size"]) == (5, 4, 3, samples, 1.25) for r in rows.collect())
    (done,) = maps.write(rows, str(tmp_path / "out"), mode=mode, ext=ext).collect()
    again = (tmp_path / "out" / done["file"]).read_bytes()
    assert len(again) == done["bytes"] and again[1024 if ext == "mrc" else 512 :] == raw[1024 if ext == "mrc" else 512 :]
    assert again[:28] == raw[:28]
    # the same in the other order
    words = {"mrc": range(0, 1024, 4), "em": range(4, 512, 4)}[ext]
    head = bytearray(raw[: 1024 if ext == "mrc" else 512])
    for k in words:
        head[k : k + 4] = head[k : k + 4][::-1]
    (tmp_path / "be").mkdir()
    (tmp_path / "be" / f"b.{ext}").write_bytes(bytes(head) + np.frombuffer(raw[len(head) :], "<" + kind).astype(">" + kind).tobytes())
    assert all(np.array_equal(r["data"], v[r["z"]].ravel()) for r in maps.read(spark, str(tmp_path / "be")).collect())
    assert maps.read_headers(spark, str(tmp_path / "be")).first()["big_endian"] == (kind != "u1" or None) or kind == "u1"


def test_headers(spark, tmp_path):
    """Tilt angles and exposures of sections, without reading layers; odd files fail with a reason."""
    v = np.zeros((3, 2, 2), "f4")
    raw = bytearray(maps.to_mrc(v, 2.0))
    sections = b"".join(struct.pack("<hf", round(100 * a), e) for a, e in ((-3.5, 1.5), (0, 2.5), (60.25, 3.5)))
    struct.pack_into("<i", raw, 92, len(sections))
    struct.pack_into("<h", raw, 130, 1 | 32)
    (tmp_path / "s.st").write_bytes(bytes(raw[:1024]) + sections + bytes(raw[1024:]))
    (r,) = maps.read_headers(spark, str(tmp_path)).collect()
    assert r["tilts"] == [-3.5, 0.0, 60.25] and r["exposures"] == [1.5, 2.5, 3.5] and r["begin"] == 1024 + 18 and r["depth"] == 3
    (tmp_path / "cut.mrc").write_bytes(maps.to_mrc(v)[:-1])
    with pytest.raises(Exception, match="cut off"):
        maps.read(spark, str(tmp_path), glob="cut*").collect()
    (tmp_path / "x.unknown").write_bytes(b"1")
    with pytest.raises(Exception, match="unknown map format"):
        maps.read(spark, str(tmp_path), glob="*.unknown").collect()
    with pytest.raises(Exception, match="two maps named"):
        both = maps.read(spark, str(tmp_path), glob="s.st")
        maps.write(both.union(both.replace({str(tmp_path / "s.st"): "/other/s.mrc"}, subset=["path"])), str(tmp_path / "out")).collect()


def test_reductions(spark, tmp_path):
    """Along each axis, over several tasks, against numpy; the centre of mass too."""
    rng = np.random.default_rng(4)
    shapes = {"a": (7, 90, 80), "b": (1, 3, 2), "c": (5, 1, 6)}
    given = {k: rng.normal(2, 1, s).astype("f4") for k, s in shapes.items()}
    for k, v in given.items():
        (tmp_path / f"{k}.mrc").write_bytes(maps.to_mrc(v))
    df = maps.read(spark, str(tmp_path), split=40_000)
    for how, f in (("sum", np.sum), ("mean", np.mean), ("min", np.min), ("max", np.max)):
        for r in maps.reduce_slices(df, how).collect():
            assert np.allclose(r["data"], f(given[r["path"][-5]].astype("f8"), axis=0).ravel())
        for axis, n in (("y", 0), ("x", 1)):
            rows = maps.reduce_slices(df, how, axis).collect()
            assert len(rows) == 13 and all(np.allclose(r["data"], f(given[r["path"][-5]][r["z"]].astype("f8"), axis=n)) for r in rows)
    for r in maps.centre_of_mass(df).collect():
        v = given[r["path"][-5]].astype("f8")
        z, y, x = np.indices(v.shape)
        assert np.allclose([r["mass"], r["x"], r["y"], r["z"]], [v.sum(), (v * x).sum() / v.sum(), (v * y).sum() / v.sum(), (v * z).sum() / v.sum()])
    assert maps.centre_of_mass(df.limit(1).selectExpr("path", "z", "width", "height", "transform(data, x -> 0f) AS data")).first()["x"] is None
