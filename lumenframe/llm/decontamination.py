"""Benchmark decontamination with an FM-index for each training shard.

A shard is what a task reads at once. Its words become numbers of the benchmark's vocabulary; runs of such words
that are long enough to hold a window are indexed: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet
matrix with bit-vector ranks, and sampled suffix positions. Every window of every item is searched backwards in
all at once, its occurrences are located by walking to a sampled position, and the hit words are merged to spans.
Words outside the vocabulary can't be part of a window, so leaving them out loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import extended, flat_bytes, fresh, lower_ascii, runs, slices, span_hashes, stored

WINDOW = 13
#: Text bytes of the benchmark that go to the workers at once; a larger benchmark is taken in several such blocks.
BLOCK_BYTES = 16 << 20
#: Distance of the sampled suffix positions.
SAMPLE = 16

_WORD = np.ones(256, dtype=bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the starts and ends of their words."""
    low = lower_ascii(data)
    return (low, *runs(_WORD[low], off))


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, dtype=np.uint8)
        b = np.packbits(bits, bitorder="little")
        packed[: len(b)] = b
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix over small integers: a bit vector for each bit, the highest first."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = ((seq >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int((~bit).sum())))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i."""
        base = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.rank(base), bits.rank(i)
            base, i = np.where(one, zeros + a, base - a), np.where(one, zeros + b, i - b)
        return i - base

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i)
            a = bits.rank(i)
            out |= one.astype(i.dtype) << shift
            i = np.where(one, zeros + a, i - a)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; each 0 is a separator of its own, less than all else, so no order looks past one."""
    n = len(text)
    gaps = text == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, text + gaps.sum()).astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        s = rank[order]
        fresh = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if not n or fresh[-1] == n - 1:
            return order
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + ahead
        # only tied suffixes move
        tied = np.zeros(n, dtype=bool)
        same = fresh[1:] == fresh[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        part = order[at]
        order[at] = part[np.argsort(key[part], kind="stable")]
        rank = key
        k *= 2


class FMIndex:
    """Over a text of numbers from 1 to ``symbols`` - 1, whose 0s separate."""

    def __init__(self, text: np.ndarray, symbols: int):
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.wavelet = Wavelet(bwt, symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        # the symbol after a separator is always sampled: a walk need not cross one
        keep = (sa % SAMPLE == 0) | (bwt == 0) | (sa == 0)
        self.sampled, self.positions = Bits(keep), sa[keep]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of ``phrases``."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            c = phrases[alive, k].astype(np.int64)
            lo[alive], hi[alive] = self.first[c] + self.wavelet.rank(c, lo[alive]), self.first[c] + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        dead = np.ones(len(phrases), dtype=bool)
        dead[alive] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix row."""
        out, walking, at, steps = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(walking):
            done = self.sampled.get(at)
            out[walking[done]] = self.positions[self.sampled.rank(at[done])] + steps
            walking, at = walking[~done], at[~done]
            if len(walking):
                c = self.wavelet.get(at)
                at = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The windows of a block of items: by length, rows of vocabulary numbers and the item of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        text = pa.array([t or "" for _, t in items], pa.string())
        data, off = flat_bytes(text)
        low, starts, ends = words(data, off)
        h = span_hashes(low, starts, ends)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        found: dict[int, dict[bytes, set[int]]] = {}
        cut = np.searchsorted(starts, off)
        for (name, _), a, b in zip(items, cut[:-1], cut[1:], strict=True):
            size = min(window, b - a)
            for k in range(a, b - size + 1 if size else a):
                found.setdefault(int(size), {}).setdefault(ids[k : k + size].tobytes(), set()).add(number[str(name)] if name is not None else -1)
        self.by_length = {n: (np.frombuffer(b"".join(w), np.int64).reshape(-1, n), [sorted(x) for x in w.values()]) for n, w in sorted(found.items())}

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def _find(phrases: Phrases, text: pa.Array, off_words: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hit words of a shard as a mask, and sorted unique pairs row * items + item."""
    hit = np.zeros(len(ids) + 1, dtype=np.int64)
    pairs: list[np.ndarray] = []
    if phrases.by_length and len(ids):
        s, e = runs(ids > 0, off_words)
        long = e - s >= min(phrases.by_length)
        s, e = s[long], e[long]
        if len(s):
            size = e - s + 1
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            tokens = np.zeros(int(size.sum()), dtype=np.int64)
            origin = np.repeat(s - begin, size) + np.arange(len(tokens))
            inside = np.ones(len(tokens), dtype=bool)
            inside[begin + size - 1] = False
            tokens[inside] = ids[origin[inside]]
            index = FMIndex(tokens, len(phrases.vocabulary) + 1)
            for n, (rows, items) in phrases.by_length.items():
                lo, hi = index.search(rows)
                found = np.flatnonzero(hi > lo)
                count = (hi - lo)[found]
                step = 1 << 20
                which = np.repeat(found, count)
                at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[found], count)
                n_items = max(1, len(phrases.names))
                for a in range(0, len(at), step):
                    word = origin[index.locate(at[a : a + step])]
                    np.add.at(hit, word, 1)
                    np.add.at(hit, word + n, -1)
                    row = np.searchsorted(off_words, word, side="right") - 1
                    pair = np.unique(row * np.int64(len(rows)) + which[a : a + step])
                    names = [items[k] for k in (pair % len(rows)).tolist()]
                    sizes = [len(x) for x in names]
                    flat = np.array([y for x in names for y in x], dtype=np.int64)
                    r = np.repeat(pair // len(rows), sizes)
                    pairs.append(np.unique((r * n_items + flat)[flat >= 0]))
    return np.cumsum(hit[:-1]) > 0, np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, spans (start and end of hit words, in characters) and contaminated.

    A text is contaminated if it has hits and they are a twentieth of its words or more. Null texts and items have no
    words. An item with a null id hits, but has no name to be counted by; items of one id are one item. Repeated rows
    stay; columns of docs so named are replaced, all others kept. A benchmark of more than BLOCK_BYTES is taken in blocks,
    one after the other: the driver and a task hold one block at a time, and what a block hits is stored before the next.
    """
    spark = docs.sparkSession
    names = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    kept = docs.drop(*names)
    given = kept.columns
    final = extended(kept.schema, "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:bigint,end:bigint>>, contaminated boolean")
    items = benchmark.select(F.col(item_id).cast("string").alias("_item"), F.col(item_text).alias("_text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    part_of = F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks))

    def shared(block: int):
        rows = [(r["_item"], r["_text"]) for r in items.filter(part_of == block).toLocalIterator()]
        return spark.sparkContext.broadcast(Phrases(rows, window))

    def found_in(phrases: Phrases, batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Where each row's words begin among all, which words are hit, and the rows' items."""
        of, ids = _word_ids(phrases, batch, column)
        mask, pairs = _find(phrases, batch.column(column), of, ids)
        n_items = max(1, len(phrases.names))
        cut = np.searchsorted(pairs // n_items, np.arange(batch.num_rows + 1))
        return of, mask, [[phrases.names[k] for k in (pairs[a:b] % n_items).tolist()] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    if blocks == 1:
        only = shared(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield _told(batch, given, names, text_col, *found_in(only.value, batch, text_col))

        return kept.mapInArrow(run, final)
    row, hits, more = (fresh(given, x) for x in ("_row", "_hits", "_found"))
    keyed = stored(kept.withColumn(row, F.monotonically_increasing_id()))
    texts = keyed.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text"))
    parts = []
    for block in range(blocks):
        now = shared(block)

        def search(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    of, mask, found = found_in(now.value, batch, "text")
                    marks = [np.flatnonzero(mask[a:b]).tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
                    hit = [k for k, m in enumerate(marks) if m]
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(hit, pa.int64())), pa.array([marks[k] for k in hit], pa.binary()), pa.array([found[k] for k in hit], pa.list_(pa.string()))], names=["row", "hits", "found"])

        parts.append(stored(texts.mapInArrow(search, "row long, hits binary, found array<string>")))
        now.destroy()
    every = reduce(DataFrame.unionAll, parts).groupBy(F.col("row").alias(row)).agg(F.collect_list("hits").alias(hits), F.flatten(F.collect_list("found")).alias(more))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = Phrases([], window)
        for batch in batches:
            if batch.num_rows:
                of, _ = _word_ids(nothing, batch, text_col)
                mask = np.zeros(int(of[-1]), dtype=bool)
                for k, lists in enumerate(batch.column(hits).to_pylist()):
                    for x in lists or []:
                        mask[np.frombuffer(x, np.int64) + of[k]] = True
                yield _told(batch, given, names, text_col, of, mask, [x or [] for x in batch.column(more).to_pylist()])

    return keyed.join(every, row, "left").drop(row).mapInArrow(merge, final)


def _word_ids(phrases: Phrases, batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's words begin among all of the batch, and the words' numbers."""
    ids, ends = [], [0]
    for part in slices(batch, column):
        data, off = flat_bytes(part.column(column))
        low, s, e = words(data, off)
        ids.append(phrases.numbers(span_hashes(low, s, e)))
        ends += (ends[-1] + np.searchsorted(s, off)[1:]).tolist()
    return np.array(ends, dtype=np.int64), np.concatenate(ids)


def _told(batch: pa.RecordBatch, given: list[str], names: list[str], column: str, of: np.ndarray, mask: np.ndarray, found: list[list[str]]) -> pa.RecordBatch:
    """The batch's rows with what was found in them."""
    found = [sorted(set(x)) for x in found]
    n_words = np.diff(of)
    n_hit = np.diff(np.concatenate(([0], np.cumsum(mask)))[of])
    s, e = runs(mask, of)
    rows = np.searchsorted(of, s, side="right") - 1
    spans: list[list] = [[] for _ in range(batch.num_rows)]
    for r in np.unique(rows):
        data, off = flat_bytes(batch.column(column).slice(int(r), 1))
        _, ws, we = words(data, off)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        spans[r] = [{"start": int(chars[ws[a - of[r]]]), "end": int(chars[we[b - 1 - of[r]]])} for a, b in zip(s[rows == r], e[rows == r], strict=True)]
    columns = [batch.column(c) for c in given]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array((n_hit > 0) & (20 * n_hit >= n_words))], names=[*given, *names])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
