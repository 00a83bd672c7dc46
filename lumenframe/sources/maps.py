"""Image maps as a Spark data source: one row a layer, files read by ranges, and written layer by layer.

A scan's partitions are pairs of a file and a part of its layers. Tasks read the header and, by seeking, the layers that are
asked for; no header is read to plan. ``layers``, and conditions on z where Spark hands them down, are kept by the tasks
before they read. Files are opened by Arrow's file systems, so that they may lie on local disks or in an object store.
Formats are told by extension; a format is a function from an open file to a ``Stack``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# Sample types and samples a pixel by mode number.
MRC_MODES = {0: ("u1", 1), 1: ("i2", 1), 2: ("f4", 1), 3: ("i2", 2), 4: ("f4", 2), 6: ("u2", 1), 16: ("u1", 3)}
EM_MODES = {1: ("u1", 1), 2: ("i2", 1), 3: ("i2", 2), 4: ("i4", 1), 5: ("f4", 1), 8: ("f4", 2), 9: ("f8", 1), 10: ("f8", 2)}
#: Most layers that a header may name; more are taken as a sign of the other byte order.
MOST_LAYERS = 9_999_999
#: Bytes of a file that a task reads, where it may be divided.
SPLIT_BYTES = 128 << 20

SCHEMA = "path string, width int, height int, depth int, samples int, pixel_size float, z int, data array<float>"
HEADER_SCHEMA = "path string, format string, mode int, width int, height int, depth int, samples int, pixel_size float, big_endian boolean, begin long, tilts array<float>, exposures array<float>"


@dataclass
class Stack:
    """What a header says: size, samples a pixel, pixel size in Angstroms, and how to read a layer."""

    width: int
    height: int
    depth: int
    kind: np.dtype
    begin: int
    samples: int = 1
    pixel_size: float = 1.0
    mode: int = -1
    tilts: list[float] | None = None
    exposures: list[float] | None = None
    layer: Callable[[BinaryIO, int], np.ndarray] | None = field(default=None, repr=False)

    def read(self, file: BinaryIO, z: int) -> np.ndarray:
        """Layer z as floats, samples of a pixel beside each other; a file that ends before is an error."""
        if self.layer:
            return self.layer(file, z).astype(np.float32).ravel()
        n = self.width * self.height * self.samples
        file.seek(self.begin + z * n * self.kind.itemsize)
        raw = file.read(n * self.kind.itemsize)
        if len(raw) < n * self.kind.itemsize:
            raise ValueError(f"layer {z} is cut off")
        return np.frombuffer(raw, self.kind).astype(np.float32)


def _in_either_order(file: BinaryIO, header: Callable[[BinaryIO, str], Stack]) -> Stack:
    """Little-endian, unless that gives no sizes."""
    try:
        found = header(file, "<")
        if min(found.width, found.height, found.depth) >= 0 and not (found.width * found.height > 1 and found.depth > MOST_LAYERS):
            return found
    except (ValueError, struct.error):
        pass
    file.seek(0)
    return header(file, ">")


def mrc(file: BinaryIO) -> Stack:
    return _in_either_order(file, _mrc)


def _mrc(file: BinaryIO, order: str) -> Stack:
    raw = file.read(1024)
    x, y, z, mode = struct.unpack_from(order + "4i", raw)
    (cell,) = struct.unpack_from(order + "f", raw, 40)
    (extended,) = struct.unpack_from(order + "i", raw, 92)
    (flags,) = struct.unpack_from(order + "h", raw, 130)
    if mode not in MRC_MODES:
        raise ValueError(f"MRC mode {mode} is not supported")
    kind, samples = MRC_MODES[mode]
    out = Stack(x, y, z, np.dtype(order + kind), 1024 + extended, samples, cell / x if x else 1.0, mode)
    # Fields of a section of the extended header by flag, as (flag, bytes).
    fields = ((1, 2), (2, 6), (4, 4), (8, 2), (16, 2), (32, 4))
    size = sum(n for flag, n in fields if flags & flag)
    if size and 0 < size * z <= extended <= 1 << 27:
        sections, at = np.frombuffer(file.read(size * z), np.uint8).reshape(z, size), 0
        for flag, n in fields:
            if flags & flag:
                if flag == 1:
                    out.tilts = (np.ascontiguousarray(sections[:, at : at + 2]).view(order + "i2")[:, 0] / 100).tolist()
                if flag == 32:
                    out.exposures = np.ascontiguousarray(sections[:, at : at + 4]).view(order + "f4")[:, 0].tolist()
                at += n
    return out


def em(file: BinaryIO) -> Stack:
    return _in_either_order(file, _em)


def _em(file: BinaryIO, order: str) -> Stack:
    raw = file.read(512)
    mode = raw[3]
    x, y, z = struct.unpack_from(order + "3i", raw, 4)
    (pixel,) = struct.unpack_from(order + "i", raw, 120)
    if mode not in EM_MODES:
        raise ValueError(f"EM mode {mode} is not supported")
    kind, samples = EM_MODES[mode]
    return Stack(x, y, z, np.dtype(order + kind), 512, samples, pixel / 1000, mode)


def raw_layers(width: int, height: int, begin: int, kind: str) -> Callable[[BinaryIO], Stack]:
    """Files without a header; how many layers there are follows from their size."""

    def read(file: BinaryIO) -> Stack:
        size = file.seek(0, 2)
        return Stack(width, height, (size - begin) // (width * height * np.dtype(kind).itemsize), np.dtype(kind), begin)

    return read


#: Formats by extension.
FORMATS: dict[str, Callable[[BinaryIO], Stack]] = {"mrc": mrc, "mrcs": mrc, "st": mrc, "rec": mrc, "em": em}


def format_of(path: str, options: dict[str, str]) -> Callable[[BinaryIO], Stack]:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in FORMATS:
        return FORMATS[ext]
    if ext in ("dm3", "dm4"):
        from lumenframe.sources import dm

        return dm.dm
    if "raw" in options:
        width, height, begin, kind = options["raw"].split(",")
        return raw_layers(int(width), int(height), int(begin), kind)
    if ext in ("tif", "tiff", "eer"):
        from lumenframe.sources import tiff

        return tiff.eer(int(options.get("frames", 10)), int(options.get("zoom", 1))) if ext == "eer" else tiff.tiff
    raise ValueError(f"unknown map format of {path}")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, or of a URI such as file:, s3: or hdfs:, and the path in it."""
    if path.startswith("file:"):
        path = path[5:] if not path.startswith("file://") else path[7:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_file(path: str) -> BinaryIO:
    system, place = file_system(path)
    return system.open_input_file(place)


@dataclass
class Part(InputPartition):
    """The share ``part`` of ``parts`` of a file's layers, or of those listed."""

    path: str
    part: int
    parts: int
    layers: tuple[int, ...] | None


def plan(files: list[tuple[str, int]], layers: list[int] | None, split: int, whole: Callable[[str], bool]) -> list[Part]:
    """Parts of about ``split`` bytes. A listed layer may lie anywhere, so that each is taken to be a part of its own in large files."""
    out = []
    for path, size in files:
        parts = 1 if whole(path) else max(1, -(-size // split))
        if layers is None:
            out += [Part(path, k, parts, None) for k in range(parts)]
        else:
            parts = min(parts, max(1, len(layers)))
            out += [Part(path, 0, 1, tuple(layers[k::parts])) for k in range(parts)]
    return out


def list_files(path: str, glob: str, recursive: bool = False) -> list[tuple[str, int]]:
    """(path, size) of a file, or of those of a folder that the pattern names, sorted; nothing is opened."""
    from fnmatch import fnmatch

    system, place = file_system(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=recursive))
    head = path[: -len(place)] if path.endswith(place) else ""
    return sorted((head + x.path, x.size) for x in infos if x.type == fs.FileType.File and (len(infos) == 1 or fnmatch(x.base_name, glob)))


class MapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        given = self.options.get("layers")
        self.layers = None if given is None else sorted({int(x) for x in given.split(",") if x})
        self.bounds = [0, MOST_LAYERS]

    def partitions(self) -> list[Part]:
        files = list_files(self.options["path"], self.options.get("glob", "*"), self.options.get("recursive", "false") == "true")
        header_only = self.options.get("headers") == "true"
        return plan(files, None if header_only else self.layers, int(self.options.get("split", SPLIT_BYTES)), lambda _: header_only)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with open_file(part.path) as file:
            stack = format_of(part.path, self.options)(file)
            if self.options.get("headers") == "true":
                ext = part.path.rsplit(".", 1)[-1].lower()
                row = {"path": part.path, "format": ext, "mode": stack.mode, "width": stack.width, "height": stack.height, "depth": stack.depth, "samples": stack.samples, "pixel_size": stack.pixel_size, "big_endian": stack.kind.byteorder == ">", "begin": stack.begin, "tilts": stack.tilts, "exposures": stack.exposures}
                yield pa.RecordBatch.from_pylist([row], _arrow(HEADER_SCHEMA))
                return
            if part.layers is not None:
                wanted = [z for z in part.layers if 0 <= z < stack.depth]
            else:
                wanted = range(stack.depth * part.part // part.parts, stack.depth * (part.part + 1) // part.parts)
            for z in wanted:
                if self.bounds[0] <= z <= self.bounds[1]:
                    data = pa.array(stack.read(file, z), pa.float32())
                    data = pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), data)
                    cells = [part.path, stack.width, stack.height, stack.depth, stack.samples, stack.pixel_size, z]
                    yield pa.RecordBatch.from_arrays([*(pa.array([c], t) for c, t in zip(cells, (pa.string(), *[pa.int32()] * 4, pa.float32(), pa.int32()), strict=True)), data], schema=_arrow(SCHEMA))


class PushingReader(MapReader):
    """Where Spark hands conditions down."""

    def pushFilters(self, filters):
        """Conditions on z are met by reading no other layers."""
        for f in filters:
            if getattr(f, "attribute", None) == ("z",) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, In)):
                    wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    wanted = {z for z in wanted if z is not None}
                    self.layers = sorted(wanted if self.layers is None else wanted & set(self.layers))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.bounds[0] = max(self.bounds[0], f.value + isinstance(f, GreaterThan))
                else:
                    self.bounds[1] = min(self.bounds[1], f.value - isinstance(f, LessThan))
            else:
                yield f


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


class MapSource(DataSource):
    """``spark.read.format("maps")``; options: path, glob, recursive, layers (commas between), raw (width,height,offset,type), headers, split, pushdown, and frames and zoom of event files."""

    @classmethod
    def name(cls) -> str:
        return "maps"

    def schema(self) -> str:
        return HEADER_SCHEMA if self.options.get("headers") == "true" else SCHEMA

    def reader(self, schema) -> MapReader:
        return (PushingReader if self.options.get("pushdown") == "true" else MapReader)(dict(self.options))


def read(spark: SparkSession, path: str, *, glob: str = "*", layers: list[int] | None = None, raw: tuple[int, int, int, str] | None = None, recursive: bool = False, split: int = SPLIT_BYTES, **options: str | int) -> DataFrame:
    """A row for each layer of each map of a file or folder; ``layers``: of these z only.

    data has the samples of a pixel beside each other: two of complex modes, three of colours. raw: width, height, offset and
    numpy sample type of files whose extension is no format's. Conditions on z are handed to the source where
    spark.sql.python.filterPushdown.enabled is set. An unknown extension, mode or a cut-off file is an error.
    """
    spark.dataSource.register(MapSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    scan = spark.read.format("maps").option("glob", glob).option("recursive", str(recursive).lower()).option("split", split).option("pushdown", pushdown).options(**options)
    if layers is not None:
        scan = scan.option("layers", ",".join(map(str, layers)))
    if raw is not None:
        scan = scan.option("raw", ",".join(map(str, raw)))
    return scan.load(path)


def read_headers(spark: SparkSession, path: str, *, glob: str = "*", recursive: bool = False, **options: str | int) -> DataFrame:
    """A row for each map with what its header says; of stacks that have them with tilt angles and exposures by layer."""
    spark.dataSource.register(MapSource)
    return spark.read.format("maps").option("glob", glob).option("recursive", str(recursive).lower()).option("headers", "true").options(**options).load(path)


def mrc_head(width: int, height: int, depth: int, mode: int = 2, pixel_size: float = 1.0, low: float = 0, high: float = 0, mean: float = 0) -> bytes:
    head = bytearray(1024)
    struct.pack_into("<10i6f3i3f", head, 0, width, height, depth, mode, 0, 0, 0, width, height, depth, width * pixel_size, height * pixel_size, depth * pixel_size, 90, 90, 90, 1, 2, 3, low, high, mean)
    head[208:216] = b"MAP \x44\x44\x00\x00"
    return bytes(head)


def em_head(width: int, height: int, depth: int, mode: int = 5, pixel_size: float = 1.0) -> bytes:
    head = bytearray(512)
    head[0], head[3] = 6, mode
    struct.pack_into("<3i", head, 4, width, height, depth)
    struct.pack_into("<i", head, 120, round(pixel_size * 1000))
    return bytes(head)


def as_samples(values: np.ndarray, kind: str) -> bytes:
    """Values as little-endian samples; whole numbers are rounded half to even and held within the type."""
    t = np.dtype("<" + kind)
    if t.kind in "iu":
        values = np.clip(np.rint(values), np.iinfo(t).min, np.iinfo(t).max)
    return values.astype(t).tobytes()


def to_mrc(volume: np.ndarray, pixel_size: float = 1.0, mode: int = 2) -> bytes:
    """A volume (z, y, x), with the samples of a pixel as x's last axis where there are more, as an MRC file."""
    z, y, x = volume.shape
    kind, samples = MRC_MODES[mode]
    return mrc_head(x // samples, y, z, mode, pixel_size, float(volume.min()), float(volume.max()), float(volume.mean())) + as_samples(volume, kind)


def to_em(volume: np.ndarray, pixel_size: float = 1.0, mode: int = 5) -> bytes:
    z, y, x = volume.shape
    kind, samples = EM_MODES[mode]
    return em_head(x // samples, y, z, mode, pixel_size) + as_samples(volume, kind)


def as_mrc(slices: DataFrame) -> DataFrame:
    """(path, content): the layers of each path as one MRC file of floats; for maps that fit into a row, others ``write``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("z")
        head = frame.iloc[0]
        volume = np.stack([np.asarray(d, dtype=np.float32).reshape(head["height"], -1) for d in frame["data"]])
        return pd.DataFrame({"path": [head["path"]], "content": [to_mrc(volume, float(head["pixel_size"]))]})

    return slices.groupBy("path").applyInPandas(run, "path string, content binary")


def write(slices: DataFrame, folder: str, *, mode: int = 2, ext: str = "mrc") -> DataFrame:
    """Writes each path's layers to ``folder``, as base name and ``ext`` (mrc, mrcs, st, rec, em, or tif by its own modes), and returns (path, file, layers, bytes).

    A file is written by the task that has its layers in order, one at a time: memory is that of a layer. It gets its name
    when it is whole, so that a task that is run again replaces what a lost one left. Layers are numbered anew without gaps;
    two paths of one base name are an error.
    """
    from lumenframe.sources import tiff

    tif = ext in ("tif", "tiff")
    kind, samples = (tiff.MODES[mode], 1) if tif else EM_MODES[mode] if ext == "em" else MRC_MODES[mode]
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    stats = slices.select("path", base.alias("_base"), F.size("data").alias("_n"), F.array_min("data").alias("_low"), F.array_max("data").alias("_high"), F.aggregate("data", F.lit(0.0).cast("double"), lambda a, x: a + x).alias("_sum"))
    stats = stats.groupBy("path", "_base").agg(F.count("*").alias("_layers"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), (F.sum("_sum") / F.greatest(F.lit(1), F.sum("_n"))).alias("_mean"))
    names = stats.groupBy("_base").agg(F.count("*").alias("_paths"))
    stats = stats.join(names, "_base").withColumn("_base", F.when(F.col("_paths") == 1, F.col("_base")).otherwise(F.raise_error(F.concat(F.lit("two maps named "), "_base"))))
    rows = slices.select("path", "width", "height", "pixel_size", "z", "data").join(stats, "path").repartition("path").sortWithinPartitions("path", "z")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        now, out, done = None, None, 0

        def close() -> pd.DataFrame:
            out.close()
            system.move(f"{place}/.{now}.{ext}.part", f"{place}/{now}.{ext}")
            return pd.DataFrame({"path": [path], "file": [f"{now}.{ext}"], "layers": [layers], "bytes": [done]})

        for frame in frames:
            for r in frame.itertuples(index=False):
                if out is None or r.path != path:
                    if out is not None:
                        yield close()
                    path, now, layers, done = r.path, r[frame.columns.get_loc("_base")], 0, 0
                    depth, low, high, mean = (r[frame.columns.get_loc(c)] for c in ("_layers", "_low", "_high", "_mean"))
                    if tif:
                        head = tiff.head(r.width, r.height, depth, kind)
                    else:
                        head = em_head(r.width, r.height, depth, mode, r.pixel_size) if ext == "em" else mrc_head(r.width, r.height, depth, mode, r.pixel_size, low, high, mean)
                    out = system.open_output_stream(f"{place}/.{now}.{ext}.part")
                    out.write(head)
                    done = len(head)
                if len(r.data) != r.width * r.height * samples:
                    raise ValueError(f"layer {r.z} of {r.path} has {len(r.data)} samples")
                body = as_samples(np.asarray(r.data).reshape(r.height, -1)[::-1] if tif else np.asarray(r.data), kind)
                if tif:
                    body = tiff.directory(r.width, r.height, depth, kind, layers) + body
                out.write(body)
                layers, done = layers + 1, done + len(body)
        if out is not None:
            yield close()

    return rows.mapInPandas(run, "path string, file string, layers int, bytes long")


#: Pixels whose partial results travel together.
BLOCK = 4096
_PARTIAL = {"sum": np.add, "mean": np.add, "min": np.minimum, "max": np.maximum}


def reduce_slices(slices: DataFrame, how: str = "sum", axis: str = "z") -> DataFrame:
    """Sum, mean, least or greatest of each map along an axis; sums are of doubles.

    z: (path, data), one value a pixel. Tasks reduce the layers they have; blocks of these results are merged by key. y or x:
    (path, z, data), one value a column or row of each layer, without a shuffle.
    """
    f = _PARTIAL[how]
    if axis in ("y", "x"):

        def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                data = [f.reduce(np.asarray(d, np.float64).reshape(h, -1), axis=0 if axis == "y" else 1) for d, h in zip(frame["data"], frame["height"], strict=True)]
                if how == "mean":
                    data = [d / (h if axis == "y" else w) for d, h, w in zip(data, frame["height"], frame["width"], strict=True)]
                yield pd.DataFrame({"path": frame["path"], "z": frame["z"], "data": data})

        return slices.select("path", "z", "width", "height", "data").mapInPandas(lines, "path string, z int, data array<double>")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, total, n = None, None, 0

        def blocks() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(total), BLOCK):
                yield pa.RecordBatch.from_pydict({"path": [path], "block": pa.array([k // BLOCK], pa.int32()), "n": [n], "part": [total[k : k + BLOCK].tolist()]})

        for batch in batches:
            for p, row in zip(batch.column(0).to_pylist(), range(batch.num_rows), strict=True):
                data = batch.column(1).slice(row, 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if total is not None and p == path:
                    total, n = f(total, data), n + 1
                else:
                    if total is not None:
                        yield from blocks()
                    path, total, n = p, data, 1
        if total is not None:
            yield from blocks()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        data, n = f.reduce(np.stack(frame["part"].to_list())), int(frame["n"].sum())
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "block": [frame["block"].iloc[0]], "part": [data / n if how == "mean" else data]})

    parts = slices.select("path", "data").mapInArrow(partial, "path string, block int, n long, part array<double>")
    merged = parts.groupBy("path", "block").applyInPandas(merge, "path string, block int, part array<double>")
    return merged.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"])).alias("data"))


def centre_of_mass(slices: DataFrame) -> DataFrame:
    """(path, mass, x, y, z): of each map the sum of its values and their mean position in pixels; null where the sum is 0. Four sums a layer travel."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for d, w, h, z in zip(frame["data"], frame["width"], frame["height"], frame["z"], strict=True):
                image = np.asarray(d, np.float64).reshape(h, w)
                mass = image.sum()
                out.append((mass, (image.sum(axis=0) * np.arange(w)).sum(), (image.sum(axis=1) * np.arange(h)).sum(), mass * z))
            part = pd.DataFrame(out, columns=["m", "mx", "my", "mz"], dtype="float64")
            yield part.assign(path=frame["path"].to_numpy()).groupby("path", as_index=False).sum()[["path", "m", "mx", "my", "mz"]]

    total = slices.select("path", "z", "width", "height", "data").mapInPandas(sums, "path string, m double, mx double, my double, mz double").groupBy("path").agg(*[F.sum(c).alias(c) for c in ("m", "mx", "my", "mz")])
    return total.select("path", F.col("m").alias("mass"), *[F.try_divide(F.col(f"m{a}"), F.col("m")).alias(a) for a in "xyz"])
