"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenframe.operators.table import with_row_id  # noqa: F401
from lumenframe.plans.shared import cut, dropped, stored  # noqa: F401

#: Text bytes that a Python task works on at once.
SLICE_BYTES = 1 << 20
#: Bytes whose prefix sums are held at once to hash spans.
HASH_BYTES = 1 << 20


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores before it as long as there is such a column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def extended(schema: StructType, ddl: str) -> StructType:
    """``schema`` with more columns at its end."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def with_number(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """``df`` with a long in the order of the ids: the id itself if it is a whole number, else its place; null is the least."""
    if df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return df.withColumn(name, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))))
    places = with_row_id(df.select(F.col(f"`{id_col}`").alias("_of")).dropna().distinct(), ["_of"], "_place")
    of = fresh(df.columns, "_of")
    return df.join(places.withColumnsRenamed({"_of": of, "_place": name}), F.col(f"`{id_col}`") == F.col(of), "left").drop(of).withColumn(name, F.coalesce(name, F.lit(-(1 << 63))))


def remainder(key: Column, n: int) -> Column:
    """crc32 of an id's text, modulo ``n``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes in ``column``; one row at least."""
    n = batch.num_rows
    if not n:
        return
    text = batch.column(column)
    sizes = np.diff(offsets(text)).cumsum()
    start = 0
    while start < n:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def offsets(text: pa.Array) -> np.ndarray:
    """Byte offsets of a string array's rows, from its first row on; a null row is empty."""
    width = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    raw = np.frombuffer(text.buffers()[1], dtype=width)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    if text.null_count:
        lengths = np.diff(raw)
        if lengths[np.asarray(text.is_null())].any():
            raise ValueError("a null row with bytes")
    return raw


def flat_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end, and the rows' offsets in them."""
    off = offsets(text)
    buffer = text.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[off[0] : off[-1]] if buffer is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[str, np.ndarray] = {}
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n + 1 each."""
    have = len(_POWERS["base"]) if _POWERS else 0
    if have <= n:
        size = max(n + 1, 1 << 16)
        for name, b in (("base", _BASE), ("inverse", _INVERSE)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["base"], _POWERS["inverse"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they lie. Starts and ends are sorted.

    Spans are taken in pieces of about HASH_BYTES, so that memory does not follow the length of ``data``.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        low = int(starts[k])
        m = max(k + 1, int(np.searchsorted(ends, low + HASH_BYTES, side="right")))
        out[k:m] = _piece_hashes(data[low : int(ends[m - 1])], starts[k:m] - low, ends[k:m] - low)
        k = m
    return out


def _piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    base, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    # bytes are spread first so that short strings do not share low bits
    np.cumsum(_SPREAD[data] * base[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(h ^ mix64((ends - starts).astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))


_SPREAD = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that no row boundary crosses."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    start = inside & (first[:n] | ~np.concatenate(([False], inside[:-1])))
    end = inside & (first[1:] | ~np.concatenate((inside[1:], [False])))
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def space_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    return runs(~_SPACE[data], off)


#: Bits of a table that tells which 64-bit hashes are worth a row.
FILTER_BITS = 1 << 26


def bit_table(hashes: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """A bit for each hash, by its lowest bits: a table of that fixed size whatever the number of hashes, which may let others through and stops none of them."""
    bits = bits or FILTER_BITS
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.shiftright(place, 6).alias("w"), place.bitwiseAND(F.lit(63)).cast("int").alias("b")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits"))
    words = stored(words)  # whose shuffle files then go at once
    rows = words.toArrow()  # bits / 64 rows at most
    dropped(words)
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[rows.column("w").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(len(table) * 64 - 1)
    return ((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
