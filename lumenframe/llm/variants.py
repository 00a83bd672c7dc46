"""Spelling variants grouped through a variable-length gram index.

The dictionary holds grams of QMIN letters and more; one is made longer only where it is frequent, up to the longest that
any word has room for twice. Each place of a word has its gram: the shortest from there on that is not frequent. What that
gram is depends on its own letters alone, so that an edit can change it only from within: of two grams of a word that do
not overlap one always survives, with the letters to its left or those to its right as they were. Each word so needs the
lists of two grams only, those that are expected to be shortest, at the same distance from the left or the right end;
the union of both is verified by edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import dropped, flat_bytes, lower_ascii, runs, slices, stored

#: Least letters of a gram, and most frequent grams that the dictionary holds beyond those of QMIN letters.
QMIN, MOST_GRAMS = 2, 1 << 16
#: Text bytes that a task reads at once; bytes of a run up to which checksums of all runs are made together.
SLICE_BYTES, TOGETHER = 4 << 20, 64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of A-Z, a-z and U+00C0 to U+00FF, which are 0xC3 and one byte more."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return runs(inside, off)


def checksums(data: np.ndarray, s: np.ndarray, e: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of data[s:e], each carried on from the checksum ``before``."""
    crc = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = e - s
    order = np.argsort(-np.minimum(size, TOGETHER + 1), kind="stable")
    sizes, at, state = size[order], s[order], crc[order]
    n_long = int(np.searchsorted(-np.minimum(sizes, TOGETHER + 1), -TOGETHER, side="left"))
    for k in range(min(TOGETHER, int(sizes[n_long])) if n_long < len(sizes) else 0):
        m = int(np.searchsorted(-sizes[n_long:], -k, side="left"))
        part = state[n_long : n_long + m]
        state[n_long : n_long + m] = _CRC[(part ^ data[at[n_long : n_long + m] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out = np.empty(len(s), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:n_long].tolist():
        out[k] = zlib.crc32(data[s[k] : e[k]].tobytes(), int(before[k]))
    return out


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", damage: int | None = 199, letters: int = 6, least: int = 5) -> DataFrame:
    """(word, n): words of at least ``letters`` code points that occur ``least`` times or more in all texts.

    ``damage``: of a run whose crc32 of ``<id>:<run>`` it divides, the code point at that number modulo the run's length is
    deleted first; None leaves all as they are. A null id counts as the text '', a null text has no words.
    """
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, off = flat_bytes(part.column("text"))
                data = lower_ascii(data)
                s, e = letter_runs(data, off)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                size = points[e] - points[s]
                long = size >= letters
                s, e, size = s[long], e[long], size[long]
                if not len(s):
                    continue
                changed: dict[str, int] = {}
                plain = np.ones(len(s), dtype=bool)
                if damage:
                    prefix = np.array([zlib.crc32(f"{x}:".encode()) for x in part.column("id").to_pylist()], dtype=np.uint32)
                    h = checksums(data, s, e, prefix[np.searchsorted(off, s, side="right") - 1])
                    plain = h % damage != 0
                    for k in np.flatnonzero(~plain & (size > letters)).tolist():
                        word, at = data[s[k] : e[k]].tobytes().decode(), int(h[k]) % int(size[k])
                        word = word[:at] + word[at + 1 :]
                        changed[word] = changed.get(word, 0) + 1
                # words and what is between them by turns
                bounds = np.column_stack((s[plain], e[plain])).ravel()
                found = pa.Array.from_buffers(pa.large_binary(), max(0, len(bounds) - 1), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
                n = np.bincount(np.asarray(found.indices)[::2], minlength=len(found.dictionary))
                used = np.flatnonzero(n)
                words = found.dictionary.take(pa.array(used)).cast(pa.large_string()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(n[used].astype(np.int64))], names=["word", "n"])
                if changed:
                    yield pa.RecordBatch.from_arrays([pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent_grams(words: DataFrame, longest: int, most: int = MOST_GRAMS) -> tuple[dict[str, int], int]:
    """The grams of QMIN to ``longest`` letters that more words' places have than a threshold, and the threshold.

    It is so high that there can't be more than ``most`` such grams: each takes up more than it of all places.
    """
    places = words.agg(F.sum(F.expr(f"aggregate(sequence({QMIN}, {longest}), 0L, (x, q) -> x + greatest(0, char_length(word) - q + 1))"))).first()[0] or 0
    threshold = max(16, -(-int(places) // most))
    every = f"flatten(transform(sequence({QMIN}, {longest}), q -> transform(sequence(1, char_length(word) - q + 1), i -> substring(word, i, q))))"
    grams = words.select(F.explode(F.expr(every)).alias("g")).groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > threshold)
    return {r["g"]: r["n"] for r in grams.toLocalIterator()}, threshold


def decompose(word: str, frequent: dict[str, int], longest: int) -> list[str]:
    """The gram of each place of a word: the shortest of QMIN letters or more that is not frequent, has ``longest`` letters or ends the word."""
    out = []
    for p in range(len(word) - QMIN + 1):
        q = QMIN
        while q < longest and p + q < len(word) and word[p : p + q] in frequent:
            q += 1
        out.append(word[p : p + q])
    return out


def cheapest(grams: list[str], frequent: dict[str, int], threshold: int) -> tuple[int, int]:
    """Two places whose grams don't overlap and whose lists are expected to be shortest; one edit can't reach both."""
    cost = [frequent.get(g) or min(threshold, frequent.get(g[:-1], threshold) // 4) for g in grams]
    best, left = None, 0  # the cheapest gram that ends before a place
    ends = sorted(range(len(grams)), key=lambda p: p + len(grams[p]))
    k, before = 0, None
    for p in range(len(grams)):
        while k < len(ends) and ends[k] + len(grams[ends[k]]) <= p:
            if before is None or cost[ends[k]] < cost[before]:
                before = ends[k]
            k += 1
        if before is not None and (best is None or cost[before] + cost[p] < best):
            best, left, right = cost[before] + cost[p], before, p
    if best is None:
        raise ValueError("a word too short for two grams")
    return left, right


def near_pairs(words: DataFrame, *, letters: int = 6) -> DataFrame:
    """(a, a_n, b, b_n): each pair of distinct words (word, n) of ``letters`` code points or more that one inserted, deleted or replaced code point makes equal, once."""
    longest = letters - QMIN
    if longest < QMIN:
        raise ValueError(f"words need {2 * QMIN} letters at least")
    spark = words.sparkSession
    frequent, threshold = frequent_grams(words, longest)
    shared = spark.sparkContext.broadcast((frequent, threshold))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, threshold = shared.value
        for frame in frames:
            key, word, n, probe = [], [], [], []
            for w, c in zip(frame["word"], frame["n"], strict=True):
                grams, size = decompose(w, frequent, longest), len(w)
                for p, g in enumerate(grams):
                    key += [f"{size}<{p}{g}", f"{size}>{size - p - len(g)}{g}"]
                a, b = cheapest(grams, frequent, threshold)
                r = size - b - len(grams[b])
                asked = [f"{size}<{a}{grams[a]}", f"{size}<{b}{grams[b]}"]  # replaced: what is on both sides stays
                if size > letters:  # deleted: after the left gram, or before the right one
                    asked += [f"{size - 1}<{a}{grams[a]}", f"{size - 1}>{r}{grams[b]}"]
                key += asked
                rows = 2 * len(grams) + len(asked)
                word += [w] * rows
                n += [c] * rows
                probe += [False] * (2 * len(grams)) + [True] * len(asked)
            yield pd.DataFrame({"key": key, "word": word, "n": n, "probe": probe})

    rows = stored(words.mapInPandas(index, "key string, word string, n long, probe boolean"))
    asks = rows.filter("probe").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    held = rows.filter("not probe").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # words of equal length ask for each other: one of both answers is enough
    found = asks.join(held, "key").filter("char_length(a) > char_length(b) OR a > b").filter("levenshtein(a, b, 1) = 1")
    pairs = stored(found.select("a", "a_n", "b", "b_n").distinct())
    dropped(rows)
    return pairs


def group_variants(words: DataFrame, *, letters: int = 6, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words (word, n).

    form: the near word of largest n, of equal ones the first in code-point order, if it has ``times`` the word's n, else null;
    root: the last form from word to form to form, word itself without one. An empty table gives no rows.
    """
    pairs = near_pairs(words, letters=letters)
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")).alias("near"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("word")).alias("near")))
    near = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    has = -F.col("near.less") >= times * F.col("n")
    near = stored(near.select("word", "n_near", F.when(has, F.col("near.word")).alias("form"), F.when(has, -F.col("near.less")).alias("form_n")))
    # a form has times the count, so that paths are short; each round doubles what they have gone
    forms = near.filter("form is not null").select("word", "form")
    roots = forms.select("word", F.col("form").alias("root"))
    most, length = words.agg(F.max("n")).first()[0] or 1, 0
    while most >= times:
        most, length = most // times, length + 1
    for _ in range(max(0, length - 1).bit_length()):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    out = words.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", damage: int | None = 199, letters: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """``group_variants`` of the ``word_counts`` of all texts; columns besides id and text are not read."""
    words = stored(word_counts(docs, id_col=id_col, text_col=text_col, damage=damage, letters=letters, least=least))
    return group_variants(words, letters=letters, times=times)
