"""Files of nested tags, versions 3 and 4: lengths are big-endian, values in the order that the head names.

The tree is walked once; arrays are stepped over, so that an image's samples are read by layers like those of other formats.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import numpy as np

from lumenframe.sources.maps import Stack

# Kinds of tags, of what holds more than one value, and sample types by number.
GROUP, DATA = 20, 21
STRUCT, STRING, ARRAY = 15, 18, 20
KINDS = {2: "i2", 3: "i4", 4: "u2", 5: "u4", 6: "f4", 7: "f8", 8: "u1", 9: "i1", 10: "u1", 11: "i8", 12: "u8"}
UNITS = {"nm": 10.0, "A": 1.0, "Å": 1.0, "pm": 0.01, "µm": 1e4, "um": 1e4}
#: Bytes of an array up to which it is read as a value.
SMALL, DEEP = 4096, 64


@dataclass
class Samples:
    """Where an array lies, of which type, and how many samples it has."""

    begin: int
    kind: np.dtype
    count: int


class Tags:
    def __init__(self, file: BinaryIO):
        self.file = file
        file.seek(0)
        (self.version,) = struct.unpack(">i", file.read(4))
        if self.version not in (3, 4):
            raise ValueError("no file of nested tags")
        self.wide = ">q" if self.version == 4 else ">i"
        self.number(self.wide)
        self.order = "<" if self.number(">i") == 1 else ">"

    def number(self, form: str) -> int:
        raw = self.file.read(struct.calcsize(form))
        if len(raw) < struct.calcsize(form):
            raise ValueError("the tags are cut off")
        return struct.unpack(form, raw)[0]

    def walk(self, path: tuple = ()) -> Iterator[tuple[tuple, Any]]:
        """(path, value) of all values; entries of a group without a name are told by their place."""
        if len(path) > DEEP:
            raise ValueError("tags nested too deep")
        self.file.read(2)
        for k in range(self.number(self.wide)):
            kind, length = self.number(">B"), self.number(">H")
            name = self.file.read(length).decode("latin-1") or k
            end = self.number(">q") + self.file.tell() if self.version == 4 else None
            if kind == GROUP:
                yield from self.walk((*path, name))
            elif kind == DATA:
                yield (*path, name), self.value(name)
            else:
                raise ValueError(f"unknown tag {kind}")
            if end is not None:
                self.file.seek(end)

    def value(self, name: str | int) -> Any:
        if self.file.read(4) != b"%%%%":
            raise ValueError("a value without its mark")
        info = [self.number(self.wide) for _ in range(self.number(self.wide))]
        if info[0] == ARRAY:
            return self.array(info[1:], name)
        if info[0] == STRING:
            return self.file.read(2 * info[1]).decode("utf-16-le" if self.order == "<" else "utf-16-be", "replace")
        if info[0] == STRUCT:
            return tuple(self.simple(t) for t in info[4::2])
        return self.simple(info[0])

    def simple(self, kind: int) -> Any:
        if kind not in KINDS:
            raise ValueError(f"unknown type {kind}")
        t = np.dtype(self.order + KINDS[kind])
        return np.frombuffer(self.file.read(t.itemsize), t)[0].item()

    def array(self, info: list[int], name: str | int) -> Any:
        count = info[-1]
        if info[0] == STRUCT:
            size = sum(np.dtype(KINDS[t]).itemsize for t in info[4:-1:2])
            self.file.seek(self.file.tell() + size * count)
            return None
        t = np.dtype(self.order + KINDS[info[0]])
        at = self.file.tell()
        if info[0] == 4 and name != "Data" and count * t.itemsize <= SMALL:  # texts are arrays of 16 bits
            raw = self.file.read(count * t.itemsize)
            return raw.decode("utf-16-le" if self.order == "<" else "utf-16-be", "replace") if count else ""
        self.file.seek(at + count * t.itemsize)
        return Samples(at, t, count)


def tags(file: BinaryIO) -> dict[tuple, Any]:
    return dict(Tags(file).walk())


def dm(file: BinaryIO) -> Stack:
    """The last image of the file; those before it are previews."""
    found = tags(file)
    images = [p[:-1] for p in found if p[:1] == ("ImageList",) and p[-2:] == ("ImageData", "Data") and p[:-1] + ("Dimensions", 0) in found]
    if not images:
        raise ValueError("no image among the tags")
    at = images[-1]
    dims = [found.get((*at, "Dimensions", k), 1) for k in range(3)]
    data = found[*at, "Data"]
    if not isinstance(data, Samples) or data.count < dims[0] * dims[1] * dims[2]:
        raise ValueError("the image has fewer samples than its size")
    scale, unit = found.get((*at, "Calibrations", "Dimension", 0, "Scale"), 1.0), found.get((*at, "Calibrations", "Dimension", 0, "Units"), "")
    return Stack(dims[0], dims[1], dims[2], data.kind, data.begin, 1, float(scale) * UNITS.get(unit, 1.0))
