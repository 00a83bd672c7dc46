"""TIFF stacks and event files for the map source, by their directories: a layer is read by its strips alone.

Rows of images are from bottom to top, as other formats have them. Event files hold, for each frame, the gaps between
electrons as run lengths and a position within the pixel as four bits more; a layer is the sum of some frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lumenframe.sources.maps import Stack, list_files, open_file

# Tags, field types by number, sample types by (bits, format), compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339
FIELDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (64, 1): "u8", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (64, 2): "i8", (32, 3): "f4", (64, 3): "f8"}
NONE, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE, EVENTS_8, EVENTS_7 = 1, 5, 8, 32773, 32946, 65000, 65001
#: Sample types that ``maps.write`` knows by mode, for files that end in tif.
MODES = {0: "u1", 1: "i2", 2: "f4", 3: "u2", 4: "i4", 5: "u4", 6: "i8", 7: "u8", 8: "f8"}


@dataclass
class Directories:
    """Where the directories of a file lie, found by walking from each to the next without reading entries."""

    order: str
    big: bool
    places: list[int]

    @classmethod
    def of(cls, file: BinaryIO) -> Directories:
        file.seek(0)
        head = file.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else 0
        if version not in (42, 43):
            raise ValueError("no TIFF file")
        big = version == 43
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)
        places: list[int] = []
        while at:
            if at in places[-1:] or len(places) > 1 << 24:
                raise ValueError("directories that lead in a circle")
            places.append(at)
            file.seek(at)
            (n,) = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))
            file.seek(at + (8 + 20 * n if big else 2 + 12 * n))
            (at,) = struct.unpack(order + ("Q" if big else "I"), file.read(8 if big else 4))
        return cls(order, big, places)

    def entries(self, file: BinaryIO, k: int) -> dict[int, tuple]:
        """The tags of directory k; values too long for their entry are read where they lie."""
        file.seek(self.places[k])
        (n,) = struct.unpack(self.order + ("Q" if self.big else "H"), file.read(8 if self.big else 2))
        size, room = (20, 8) if self.big else (12, 4)
        raw, out = file.read(size * n), {}
        for e in range(n):
            tag, kind, count = struct.unpack_from(self.order + ("HHQ" if self.big else "HHI"), raw, e * size)
            if kind in FIELDS:
                form = f"{self.order}{count}{FIELDS[kind]}"
                place = e * size + size - room
                if struct.calcsize(form) > room:
                    file.seek(struct.unpack_from(self.order + ("Q" if self.big else "I"), raw, place)[0])
                    out[tag] = struct.unpack(form, file.read(struct.calcsize(form)))
                else:
                    out[tag] = struct.unpack_from(form, raw, place)
        return out


def strips(file: BinaryIO, tags: dict[int, tuple]) -> Iterator[bytes]:
    for at, n in zip(tags[OFFSETS], tags[COUNTS], strict=True):
        file.seek(at)
        raw = file.read(n)
        if len(raw) < n:
            raise ValueError("a strip is cut off")
        yield raw


def unpack_bits(raw: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(raw):
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += n + 2
        elif n > 128:
            out += raw[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first; 256 begins a new table, 257 ends."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    out, table, width, last = bytearray(), list(single), 9, None
    held, bits = 0, 0
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(single), 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


_UNPACK: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: unpack_lzw, ADOBE_DEFLATE: zlib.decompress, DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def tiff(file: BinaryIO) -> Stack:
    """A stack of directories of one size and sample type; strips of one plane, plain or packed without loss."""
    directories = Directories.of(file)
    first = directories.entries(file, 0)
    samples = first.get(SAMPLES, (1,))[0]
    bits, kind = first.get(BITS, (1,)), first.get(FORMAT, (1,))
    if len(set(bits)) != 1 or (bits[0], kind[0]) not in KINDS:
        raise ValueError(f"TIFF samples of {bits} bits and format {kind} are not supported")
    dtype = np.dtype(directories.order + KINDS[bits[0], kind[0]])
    width, height = first[WIDTH][0], first[HEIGHT][0]

    def layer(file: BinaryIO, z: int) -> np.ndarray:
        tags = first if z == 0 else directories.entries(file, z)
        if (tags[WIDTH][0], tags[HEIGHT][0], tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]) != (width, height, bits[0], kind[0]):
            raise ValueError(f"layer {z} has another size or type")
        pack = tags.get(COMPRESSION, (NONE,))[0]
        if pack not in _UNPACK or OFFSETS not in tags or (samples > 1 and tags.get(PLANAR, (1,))[0] != 1):
            raise ValueError(f"TIFF compression {pack}, tiles or planes are not supported")
        raw = b"".join(map(_UNPACK[pack], strips(file, tags)))
        rows = np.frombuffer(raw[: width * height * samples * dtype.itemsize], dtype).reshape(height, width * samples)
        if tags.get(PREDICTOR, (1,))[0] == 2:
            rows = np.cumsum(rows.reshape(height, width, samples), axis=1, dtype=dtype.newbyteorder("=")).reshape(height, -1)
        elif tags.get(PREDICTOR, (1,))[0] != 1:
            raise ValueError("predictors of floats are not supported")
        return rows[::-1]

    return Stack(width, height, len(directories.places), dtype, directories.places[0], samples, layer=layer)


def head(width: int, height: int, depth: int, kind: str) -> bytes:
    """The head of a stack that ``directory`` and the layers' samples follow; of more than 4 GB in its large form."""
    big = _total(width, height, depth, kind) >= 1 << 32
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)


def _total(width: int, height: int, depth: int, kind: str) -> int:
    return 16 + depth * (width * height * np.dtype(kind).itemsize + 256)


def directory(width: int, height: int, depth: int, kind: str, z: int) -> bytes:
    """The directory of layer z, whose one strip follows it: each lies where sizes alone tell."""
    t, big = np.dtype(kind), _total(width, height, depth, kind) >= 1 << 32
    size = width * height * t.itemsize
    code = {"u": 1, "i": 2, "f": 3}[t.kind]
    own = 8 + 20 * 9 + 8 if big else 2 + 12 * 9 + 4
    at = (16 if big else 8) + z * (own + size)
    tags = [(WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, 8 * t.itemsize), (COMPRESSION, 3, NONE), (PHOTOMETRIC, 3, 1), (OFFSETS, 16 if big else 4, at + own), (ROWS, 4, height), (COUNTS, 16 if big else 4, size), (FORMAT, 3, code)]
    after = at + own + size if z + 1 < depth else 0
    if big:
        return struct.pack("<Q", 9) + b"".join(struct.pack("<HHQQ", tag, form, 1, v) for tag, form, v in tags) + struct.pack("<Q", after)
    return struct.pack("<H", 9) + b"".join(struct.pack("<HHII", tag, form, 1, v) for tag, form, v in tags) + struct.pack("<I", after)


# --- events ------------------------------------------------------------------


def unpack_events(raw: bytes, pixels: int, seven: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pixel of each electron of a frame, and its four bits within it: row and column of a grid of four, as yyxx.

    A code is a run length of 8 or 7 bits and 4 bits of position; the greatest run length counts as a gap only. With 7 bits
    such a gap has no position, so that codes differ in size: those between two of them are taken at once.
    """
    b = np.frombuffer(raw + bytes(8), np.uint8).astype(np.uint32)
    if not seven:
        n = len(raw) // 3
        x = b[: 3 * n].reshape(-1, 3)
        gap = np.column_stack((x[:, 0], (x[:, 1] >> 4) | ((x[:, 2] & 15) << 4))).ravel().astype(np.int64)
        place = np.column_stack((x[:, 1] & 15, x[:, 2] >> 4)).ravel()
        top = 255
    else:
        gaps, places, at, end, top = [], [], 0, 8 * len(raw), 127
        step = 4096
        while at + 7 <= end:
            bits = np.arange(at, min(end - 6, at + 11 * step), 11)
            k = bits >> 3
            code = (b[k] | (b[k + 1] << np.uint32(8)) | (b[k + 2] << np.uint32(16))) >> (bits & 7).astype(np.uint32)
            gap = code & 127
            stop = np.flatnonzero(gap == top)
            m = int(stop[0]) if len(stop) else len(bits)
            gaps.append(gap[:m])
            places.append((code[:m] >> 7) & 15)
            at += 11 * m
            if len(stop):
                gaps.append(np.array([top], np.uint32))
                places.append(np.zeros(1, np.uint32))
                at += 7
        gap = np.concatenate(gaps).astype(np.int64) if gaps else np.zeros(0, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.uint32)
    electron = gap < top
    where = np.cumsum(gap) + np.cumsum(electron) - electron
    ends = np.flatnonzero(where == pixels)
    if not len(ends):
        raise ValueError("a frame does not end with its last pixel")
    kept = electron[: ends[0]]
    return where[: ends[0]][kept], (place[: ends[0]][kept] ^ 10).astype(np.uint8)


def _events(file: BinaryIO, directories: Directories, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Columns and rows, in sixteenths of a pixel's area, of the electrons of frame k, and the frame's size."""
    tags = directories.entries(file, k)
    pack = tags.get(COMPRESSION, (NONE,))[0]
    if pack not in (EVENTS_8, EVENTS_7):
        raise ValueError(f"compression {pack} is not one of events")
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    at, place = unpack_events(b"".join(strips(file, tags)), width * height, pack == EVENTS_7)
    return (at % width) * 4 + (place & 3), (at // width) * 4 + (place >> 2), width, height


def eer(frames: int = 10, zoom: int = 1) -> Callable[[BinaryIO], Stack]:
    """Event files whose layers are sums of ``frames`` frames each, frames left over at the end none; zoom 1, 2 or 3: pixels whole, halved or quartered."""
    if zoom not in (1, 2, 3) or frames < 1:
        raise ValueError("zoom must be 1, 2 or 3, frames 1 or more")

    def read(file: BinaryIO) -> Stack:
        directories = Directories.of(file)
        first = directories.entries(file, 0)
        width, height = first[WIDTH][0] << (zoom - 1), first[HEIGHT][0] << (zoom - 1)

        def layer(file: BinaryIO, z: int) -> np.ndarray:
            image = np.zeros(width * height, dtype=np.int64)
            for k in range(z * frames, (z + 1) * frames):
                x, y, *_ = _events(file, directories, k)
                image += np.bincount((y >> (3 - zoom)) * width + (x >> (3 - zoom)), minlength=width * height)
            return image

        return Stack(width, height, len(directories.places) // frames, np.dtype("<f4"), directories.places[0], layer=layer)

    return read


def read_events(spark: SparkSession, path: str, *, glob: str = "*.eer", first: int = 0, last: int | None = None, frames: int = 16) -> DataFrame:
    """(path, frame, x, y): a row for each electron of frames ``first`` to before ``last``, in quarters of a pixel. A task reads ``frames`` frames.

    Tasks walk the files' directories to find the ranges of frames, which are then dealt to tasks anew.
    """
    files = list_files(path, glob)
    parts = spark.createDataFrame([(p,) for p, _ in files] or [], "path string").repartition(max(1, len(files)))

    def count(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for p in frame["path"]:
                with open_file(p) as file:
                    n = len(Directories.of(file).places)
                starts = np.arange(first, n if last is None else min(last, n), frames)
                yield pd.DataFrame({"path": p, "start": starts, "end": np.minimum(starts + frames, n if last is None else min(last, n))})

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples(index=False):
                with open_file(r.path) as file:
                    directories = Directories.of(file)
                    for k in range(r.start, r.end):
                        x, y, *_ = _events(file, directories, k)
                        yield pd.DataFrame({"path": r.path, "frame": np.full(len(x), k, np.int32), "x": x.astype(np.int32), "y": y.astype(np.int32)})

    ranges = parts.mapInPandas(count, "path string, start int, end int")
    return ranges.repartition("path", "start").mapInPandas(run, "path string, frame int, x int, y int")
