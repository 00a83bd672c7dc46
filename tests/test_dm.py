"""Nested tags of both versions and orders."""

import struct

import numpy as np
import pytest

from lumenframe.sources import dm, maps

CODES = {"i2": 2, "i4": 3, "u2": 4, "u4": 5, "f4": 6, "f8": 7, "i1": 9, "u1": 10}


def made(tree, version, order):
    wide = ">q" if version == 4 else ">i"

    def value(v):
        if isinstance(v, np.ndarray):
            return [20, CODES[v.dtype.str[1:]], v.size], v.astype(order + v.dtype.str[1:]).tobytes()
        if isinstance(v, str):
            raw = v.encode("utf-16-le" if order == "<" else "utf-16-be")
            return [20, 4, len(raw) // 2], raw
        if isinstance(v, tuple):
            return [15, 0, len(v), *[x for _ in v for x in (0, 7)]], b"".join(struct.pack(order + "d", x) for x in v)
        return ([3], struct.pack(order + "i", v)) if isinstance(v, int) else ([6], struct.pack(order + "f", v))

    def group(entries):
        out = b"\0\0" + struct.pack(wide, len(entries))
        for name, v in entries:
            if isinstance(v, list):
                kind, body = 20, group(v)
            else:
                info, raw = value(v)
                kind, body = 21, b"%%%%" + struct.pack(wide, len(info)) + b"".join(struct.pack(wide, x) for x in info) + raw
            out += struct.pack(">BH", kind, len(name)) + name.encode() + (struct.pack(">q", len(body)) if version == 4 else b"") + body
        return out

    body = group(tree)
    return struct.pack(">i", version) + struct.pack(wide, len(body)) + struct.pack(">i", 1 if order == "<" else 0) + body


def image(v, scale=0.25, units="nm"):
    dims = [("", int(n)) for n in reversed(v.shape)]
    return [("ImageData", [("Calibrations", [("Dimension", [("", [("Scale", scale), ("Units", units)])])]), ("Data", v.ravel()), ("Dimensions", dims)]), ("Name", "x")]


@pytest.mark.parametrize("version", [3, 4])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", sorted(CODES))
def test_images(tmp_path, version, order, kind):
    v = np.arange(2 * 3 * 4).reshape(2, 3, 4).astype(kind)
    tree = [("Point", (1.0, 2.0)), ("ImageList", [("", image(np.zeros((2, 2), "u1"))), ("", image(v))]), ("After", 5)]
    (tmp_path / f"a.dm{version}").write_bytes(made(tree, version, order))
    reader = maps.MapReader({"path": str(tmp_path), "layers": "1"})
    (batch,) = [b for p in reader.partitions() for b in reader.read(p)]
    row = batch.to_pylist()[0]
    assert (row["width"], row["height"], row["depth"], row["pixel_size"]) == (4, 3, 2, 2.5) and row["data"] == v[1].ravel().tolist()
    with open(tmp_path / f"a.dm{version}", "rb") as f:
        found = dm.tags(f)
    assert found["Point",] == (1.0, 2.0) and found["After",] == 5 and found["ImageList", 1, "Name"] == "x"


def test_odd(tmp_path):
    v = np.zeros((2, 2), "f4")
    for tree, why in (([("x", 1)], "no image"), ([("ImageList", [("", [("ImageData", [("Data", v.ravel()), ("Dimensions", [("", 9), ("", 9)])])])])], "fewer samples")):
        (tmp_path / "a.dm3").write_bytes(made(tree, 3, "<"))
        with pytest.raises(ValueError, match=why), open(tmp_path / "a.dm3", "rb") as f:
            dm.dm(f)
    for raw, why in ((b"\0\0\0\7" + bytes(20), "no file"), (made([("ImageList", [("", image(v))])], 4, "<")[:60], "cut off|mark")):
        (tmp_path / "a.dm3").write_bytes(raw)
        with pytest.raises(ValueError, match=why), open(tmp_path / "a.dm3", "rb") as f:
            dm.dm(f)
