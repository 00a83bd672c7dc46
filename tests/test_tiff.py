"""TIFF stacks of every sample type and packing, and event files, against what they were made of."""

import struct
import zlib

import numpy as np
import pytest

from lumenframe.sources import maps, tiff


def pack_lzw(raw):
    """Codes of 9 to 12 bits, the table begun anew before it is full."""
    out, held, bits = bytearray(), 0, 0
    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""

    def put(code):
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
            held &= (1 << bits) - 1

    put(256)
    free = 258
    for k in raw:
        c = bytes([k])
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = free
        free += 1
        if free > (1 << width) - 1:
            width += 1
        if free >= 4094:
            put(256)
            table, width, free = {bytes([k]): k for k in range(256)}, 9, 258
        word = c
    if word:
        put(table[word])
        free += 1
        if free > (1 << width) - 1:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def pack_bits(raw):
    return b"".join(bytes([len(raw[k : k + 100]) - 1]) + raw[k : k + 100] for k in range(0, len(raw), 100)) + bytes([128])


def stack(pages, order="<", big=False, compression=1, rows_a_strip=2, predictor=1, samples=1, extra=None):
    """A file of pages (height, width * samples), rows from top to bottom."""
    room, ptr = (8, "Q") if big else (4, "I")
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for page in pages:
        h, w = page.shape
        code = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        offsets, counts = [], []
        body = page
        if predictor == 2:
            cells = page.reshape(h, -1, samples)
            body = np.concatenate((cells[:, :1], cells[:, 1:] - cells[:, :-1]), axis=1).reshape(h, w)
        for k in range(0, h, rows_a_strip):
            raw = body[k : k + rows_a_strip].astype(page.dtype.newbyteorder(order)).tobytes()
            raw = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}.get(compression, bytes)(raw)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        tags = {256: (4, [w // samples]), 257: (4, [h]), 258: (3, [8 * page.dtype.itemsize] * samples), 259: (3, [compression]), 273: (4, offsets), 277: (3, [samples]), 278: (4, [rows_a_strip]), 279: (4, counts), 317: (3, [predictor]), 339: (3, [code] * samples)}
        tags |= extra or {}
        cells = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{tiff.FIELDS[kind]}", *values)
            if len(raw) > room:
                at = len(out)
                out += raw
                raw = struct.pack(order + ptr, at)
            cells.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(values)) + raw.ljust(room, b"\0"))
        struct.pack_into(order + ptr, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(cells)) + b"".join(cells)
        link = len(out)
        out += bytes(room)
    return bytes(out)


def read(path):
    reader = maps.MapReader({"path": str(path)})
    return {b.column("z")[0].as_py(): b.column("data")[0].values.to_numpy() for p in reader.partitions() for b in reader.read(p)}


@pytest.mark.parametrize("kind", sorted(set(tiff.KINDS.values())))
def test_sample_types(tmp_path, kind):
    rng = np.random.default_rng(1)
    pages = [(rng.normal(size=(5, 7)) * 50).astype(kind) if kind[0] != "u" else rng.integers(0, 200, (5, 7)).astype(kind) for _ in range(3)]
    for k, (order, big, compression) in enumerate([("<", False, 1), (">", True, 5), (">", False, 8), ("<", True, 32773)]):
        (tmp_path / f"{k}.tif").write_bytes(stack(pages, order, big, compression))
        found = read(tmp_path / f"{k}.tif")
        assert sorted(found) == [0, 1, 2] and all(np.array_equal(found[z], p[::-1].astype("f4").ravel()) for z, p in enumerate(pages))


def test_packings(tmp_path):
    """Long strips through every table size, differences of rows, colours, and what is refused."""
    rng = np.random.default_rng(2)
    page = np.repeat(rng.integers(0, 9, (60, 50)), 2, axis=1).astype("u2") * 7
    colours = rng.integers(0, 255, (6, 12)).astype("u1")
    for name, raw, want in (("a", stack([page], compression=5, rows_a_strip=60), page), ("b", stack([page], compression=8, predictor=2), page), ("c", stack([colours], samples=3, compression=5, predictor=2), colours)):
        (tmp_path / f"{name}.tiff").write_bytes(raw)
        assert np.array_equal(read(tmp_path / f"{name}.tiff")[0], want[::-1].astype("f4").ravel())
    noise = rng.integers(0, 255, 30_000).astype("u1").tobytes()
    assert tiff.unpack_lzw(pack_lzw(noise)) == noise and tiff.unpack_lzw(pack_lzw(b"a" * 9000)) == b"a" * 9000
    for raw, why in ((stack([page], compression=7), "compression 7"), (stack([page, page[:4]]), "another size"), (stack([page])[:900], "cut off|unpack"), (b"no", "no TIFF"), (stack([page.astype("u1")], extra={258: (3, [4])}), "not supported")):
        (tmp_path / "bad.tif").write_bytes(raw)
        with pytest.raises(Exception, match=why):
            read(tmp_path / "bad.tif")


def test_layer_reads_its_strips(tmp_path, monkeypatch):
    from test_maps import Counted

    pages = [np.full((100, 100), k, "f4") for k in range(30)]
    (tmp_path / "s.tif").write_bytes(stack(pages, rows_a_strip=10))
    counts, opened = [], maps.open_file
    monkeypatch.setattr(maps, "open_file", lambda p: Counted(opened(p), counts))
    reader = maps.MapReader({"path": str(tmp_path), "layers": "29"})
    (batch,) = [b for p in reader.partitions() for b in reader.read(p)]
    assert set(batch.column("data")[0].values.to_numpy()) == {29.0} and sum(counts) < 40_000 + 30 * 40 + 2000


@pytest.mark.parametrize("mode", list(tiff.MODES))
def test_written_stacks(spark, tmp_path, mode, monkeypatch):
    kind = tiff.MODES[mode]
    v = np.random.default_rng(3).integers(0, 100, (4, 3, 5)).astype("f4")
    (tmp_path / "a.mrc").write_bytes(maps.to_mrc(v))
    for big in (False, True):
        if big:
            if mode != 2:
                continue
            monkeypatch.setattr(tiff, "_total", lambda *a: 1 << 40)
            done = tiff.head(5, 3, 4, kind) + b"".join(tiff.directory(5, 3, 4, kind, z) + np.ascontiguousarray(v[z][::-1]).astype("<" + kind).tobytes() for z in range(4))
            (tmp_path / "out" / "a.tif").write_bytes(done)
        else:
            maps.write(maps.read(spark, str(tmp_path), glob="*.mrc"), str(tmp_path / "out"), mode=mode, ext="tif").collect()
        found = read(tmp_path / "out" / "a.tif")
        assert sorted(found) == [0, 1, 2, 3] and all(np.array_equal(found[z], v[z].ravel()) for z in range(4))


def pack_events(at, place, pixels, seven):
    """Electrons at sorted pixels, with their four bits, as run lengths."""
    top, width = (127, 7) if seven else (255, 8)
    bits, n, now = [], 0, 0

    def put(value, size):
        bits.extend((value >> k) & 1 for k in range(size))

    for p, s in [*zip(at.tolist(), place.tolist(), strict=True), (pixels, None)]:
        gap = p - now
        while gap >= top:
            put(top, width)
            if not seven:
                put(0, 4)
            gap -= top
        put(gap, width)
        if s is None:
            break
        put(s ^ 10, 4)
        now, n = p + 1, n + 1
    bits += [0] * (-len(bits) % 24)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


@pytest.mark.parametrize("seven", [False, True])
def test_events(spark, tmp_path, seven):
    """Sums of frames at each zoom, and rows of electrons, for sparse, dense, empty and full frames."""
    rng = np.random.default_rng(7)
    w, h = 32, 24
    frames, want = [], []
    for k, density in enumerate([0.3, 0.002, 0.0, 1.0, 0.05, 0.001, 0.9]):
        at = np.flatnonzero(rng.random(w * h) < density)
        if k == 5:
            at = np.array([300, w * h - 1])
        place = rng.integers(0, 16, len(at))
        frames.append(pack_events(at, place, w * h, seven))
        want.append((at, place))
    # frames as one strip each, of a compression that is that of events
    raw = stack([np.frombuffer(f, "u1")[None] for f in frames], compression=65001 if seven else 65000, rows_a_strip=1, extra={256: (4, [w]), 257: (4, [h])})
    (tmp_path / "m.eer").write_bytes(raw)
    for zoom in (1, 2, 3):
        rows = maps.read(spark, str(tmp_path), frames=2, zoom=zoom).collect()
        assert sorted(r["z"] for r in rows) == [0, 1, 2] and rows[0]["width"] == w << (zoom - 1)
        for r in rows:
            image = np.zeros((h << (zoom - 1), w << (zoom - 1)))
            for at, place in want[2 * r["z"] : 2 * r["z"] + 2]:
                x, y = (at % w) * 4 + (place & 3), (at // w) * 4 + (place >> 2)
                np.add.at(image, (y >> (3 - zoom), x >> (3 - zoom)), 1)
            assert np.array_equal(r["data"], image.ravel())
    events = tiff.read_events(spark, str(tmp_path), frames=2)
    assert events.count() == sum(len(a) for a, _ in want)
    k, (at, place) = 4, want[4]
    found = sorted((r["y"], r["x"]) for r in events.filter(f"frame = {k}").collect())
    assert found == sorted(zip(((at // w) * 4 + (place >> 2)).tolist(), ((at % w) * 4 + (place & 3)).tolist(), strict=True))
    assert {r["frame"] for r in tiff.read_events(spark, str(tmp_path), first=3, last=5).select("frame").distinct().collect()} == {3, 4}
    with pytest.raises(ValueError, match="does not end"):
        tiff.unpack_events(frames[0][:30], w * h, seven)
    with pytest.raises(ValueError):
        tiff.eer(2, 4)
