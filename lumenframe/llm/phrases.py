"""Phrase collocations from an FM-index over word numbers for each shard.

A shard is what a task reads at once, by language. Its words become numbers, pieces are parted by 0, and the sequence is
indexed in both directions: suffixes in the order of their first ``depth`` words, which is all that phrases of that length
need, and the Burrows-Wheeler transform of either. A phrase is a pair of intervals, one for each direction. Going through
the transform's symbols in an interval gives all words that extend it on that side, how often each does, and both
intervals of each extended phrase: words grow to the left, pairs to the right, and so on. Counts are summed over shards.

A phrase that is to be counted ``least`` times holds only words and pairs of words that are. A first pass adds up a hash
of each; the hashes that reach ``least`` set bits in a table of FILTER_BITS, which tells the second pass what it need not
return or extend. A hash or bit that several share lets more through and loses none, so that all counts stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import bit_table, flat_bytes, lower_ascii, mix64, runs, slices, span_hashes, stored, with_row_id

#: Text bytes of a shard, bits of the table of frequent words and pairs, and parts that a language's list is dealt in.
SHARD_BYTES, FILTER_BITS, PARTS = 2 << 20, 1 << 26, 64
_SHORT = np.uint64((1 << 32) - 1)

_END = np.zeros(256, dtype=bool)
_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _END.copy()
_GAP[[0x20, 0x09]] = True


def suffix_order(seq: np.ndarray, depth: int, symbols: int) -> np.ndarray:
    """The suffixes of ``seq`` in the order of their first ``depth`` symbols."""
    bits = max(1, int(symbols - 1).bit_length())
    each = 63 // bits
    padded = np.concatenate((seq, np.zeros(depth, dtype=np.int64)))
    keys = []
    for first in range(0, depth, each):
        key = np.zeros(len(seq), dtype=np.int64)
        for k in range(first, min(depth, first + each)):
            key = (key << bits) | padded[k : k + len(seq)]
        keys.append(key)
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


class Direction:
    """The transform of a sequence for phrases of up to ``depth`` symbols; 0 stands before and after the sequence's pieces."""

    def __init__(self, seq: np.ndarray, depth: int, symbols: int):
        order = suffix_order(seq, depth, symbols)
        self.bwt = seq[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=symbols))))
        self.back = np.empty(len(seq), dtype=np.int64)  # where the suffix that is one symbol longer stands
        self.back[np.argsort(self.bwt, kind="stable")] = np.arange(len(seq))

    def extend(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols before the phrases at [lo, lo + size): phrase, symbol, the longer phrase's interval here and in the other direction, its count."""
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(len(of)) + np.repeat(lo - begin, size)
        symbol = self.bwt[rows]
        key = of * np.int64(len(self.first)) + symbol
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate((start, [len(key)])))
        at = order[start]
        of, symbol = of[at], symbol[at]
        inside = start - begin[of]  # what comes before this symbol in the phrase's interval of the other direction
        words = symbol > 0
        return tuple(x[words] for x in (of, symbol, self.back[rows[at]], other[of] + inside, count))


class BiIndex:
    """Both directions of a sequence of numbers from 1 to ``symbols`` - 1, whose 0s part pieces; it begins and ends with 0."""

    def __init__(self, seq: np.ndarray, depth: int, symbols: int):
        self.ahead, self.reverse = Direction(seq, depth, symbols), Direction(seq[::-1], depth, symbols)
        self.depth = depth

    def phrases(self, keep=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 on: the phrases, a row of numbers each, and their counts. ``keep`` (a, b) says which pairs may be in one."""
        first = self.ahead.first
        words = np.flatnonzero(np.diff(first) > 0)
        words = words[words > 0]
        phrase, size = words[:, None], np.diff(first)[words]
        lo, lo_reverse = first[words], self.reverse.first[words]
        for n in range(1, self.depth + 1):
            yield phrase, size
            if n == self.depth or not len(size):
                return
            if n % 2:
                of, symbol, a, b, count = self.ahead.extend(lo, size, lo_reverse)
                phrase = np.column_stack((symbol, phrase[of]))
                pair = phrase[:, :2]
            else:
                of, symbol, b, a, count = self.reverse.extend(lo_reverse, size, lo)
                phrase = np.column_stack((phrase[of], symbol))
                pair = phrase[:, -2:]
            if keep is not None:
                kept = keep(pair[:, 0], pair[:, 1])
                phrase, a, b, count = phrase[kept], a[kept], b[kept], count[kept]
            lo, lo_reverse, size = a, b, count


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Of each shard and language: its name, the numbers of its words, which of them begin a piece, the words' hashes and the words."""
    for batch in batches:
        for part in slices(batch, "text", SHARD_BYTES):
            data, off = flat_bytes(part.column("text"))
            data = lower_ascii(data)
            s, e = runs(~_GAP[data], off)
            if not len(s):
                continue
            piece = np.cumsum(_END[data], dtype=np.int64)[s] + np.searchsorted(off, s, side="right")
            begins = np.concatenate(([True], piece[1:] != piece[:-1]))
            # words and what is between them by turns, so that they are numbered without a copy
            bounds = np.column_stack((s, e)).ravel()
            names = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
            ids = np.asarray(names.indices)[::2].astype(np.int64)
            raw, at = flat_bytes(names.dictionary)
            hashes = span_hashes(raw, at[:-1], at[1:])
            langs = part.column("lang").dictionary_encode()
            row = np.searchsorted(off, s, side="right") - 1
            lang = np.asarray(langs.indices)[row]
            for k, name in enumerate(langs.dictionary.to_pylist()):
                own = lang == k
                if own.any():
                    yield name, ids[own], begins[own], hashes, names.dictionary


def _seed(lang: str) -> np.ndarray:
    name = np.frombuffer(lang.encode() or b"\0", dtype=np.uint8)
    return span_hashes(name, np.zeros(1, np.int64), np.array([len(name)]))


def _pair_hash(lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a + _seed(lang)) + b * np.uint64(0x9E3779B97F4A7C15))


def _word_hash(lang: str, a: np.ndarray) -> np.ndarray:
    return mix64(a ^ _seed(lang))


def _hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each shard has each hash of a word or pair. 32 bits of it are enough for the table, and half as long."""
    for lang, ids, begins, hashes, _ in _shards(batches):
        inside = np.flatnonzero(~begins[1:])
        n = np.bincount(ids)
        used = np.flatnonzero(n)
        pair = np.sort(_pair_hash(lang, hashes[ids[inside]], hashes[ids[inside + 1]]) & _SHORT)
        start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate((start, [len(pair)])))
        for h, c in ((_word_hash(lang, hashes[used]) & _SHORT, n[used]), (pair[start], count)):
            for k in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + (1 << 16)].astype(np.int64)), pa.array(c[k : k + (1 << 16)].astype(np.int64))], names=["h", "c"])


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", depth: int = 3, least: int = 10) -> DataFrame:
    """(lang, words, phrase, f): stored; all phrases of up to ``depth`` words that occur ``least`` times or more, space-joined, and with 0 words each language's number of all words.

    A-Z count as a-z; a null text has no words, a null language is ``und``; each row counts, equal ones too.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    frequent = texts.mapInArrow(_hash_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)
    shared = spark.sparkContext.broadcast(bit_table(frequent, "h", FILTER_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value

        def told(h: np.ndarray) -> np.ndarray:
            at = h & np.uint64(FILTER_BITS - 1)
            return ((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)

        for lang, ids, begins, hashes, names in _shards(batches):
            seq = np.zeros(len(ids) + int(begins.sum()) + 1, dtype=np.int64)
            seq[np.arange(len(ids)) + np.cumsum(begins)] = ids + 1

            def keep(a: np.ndarray, b: np.ndarray, lang=lang, hashes=hashes) -> np.ndarray:
                return told(_pair_hash(lang, hashes[a - 1], hashes[b - 1]))

            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([len(ids)], pa.int64())], names=["lang", "words", "phrase", "f"])
            text = names.cast(pa.large_string())
            for phrase, size in BiIndex(seq, depth, len(names) + 1).phrases(keep):
                if phrase.shape[1] == 1:
                    kept = told(_word_hash(lang, hashes[phrase[:, 0] - 1]))
                    phrase, size = phrase[kept], size[kept]
                for k in range(0, len(size), 1 << 16):
                    part = phrase[k : k + (1 << 16)]
                    cells = [text.take(pa.array(part[:, j] - 1)) for j in range(part.shape[1])]
                    joined = pc.binary_join_element_wise(*cells, pa.scalar(" ", pa.large_string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), pa.repeat(pa.scalar(part.shape[1], pa.int32()), len(part)), joined, pa.array(size[k : k + (1 << 16)], pa.int64())], names=["lang", "words", "phrase", "f"])

    found = texts.mapInArrow(count, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return stored(found.filter((F.col("f") >= least) | (F.col("words") == 0)))


def score() -> Column:
    """floor(1000000 a a / (l r)) of columns a, l and r, exact up to counts of 15 digits."""
    square, product = "CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))", "CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({square})) div ({product})")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", depth: int = 3, least: int = 10, part_of: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``depth`` words.

    a: the phrase's count, ``least`` or more; score: the least over all cuts of floor(1000000 a a / (l r)), where l and r are
    the counts of what is before and after the cut, of equal cuts the first; n: the language's words. A phrase goes if a longer
    one that holds it has ``part_of`` hundredths of its count. Sorted by score and a descending, then phrase.
    An empty table, and texts without repeated phrases, give no rows. Columns besides text and language are not read.
    """
    counts = phrase_counts(docs, text_col=text_col, lang_col=lang_col, depth=depth, least=least)
    phrases = counts.filter("words > 0").select("lang", "words", "phrase", "f")
    candidates = phrases.filter("words > 1")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    cut = F.struct(score().alias("score"), "k", "l", "r", "a").alias("cut")
    inner = candidates.filter("words > 2").withColumn("w", F.split("phrase", " "))
    inner = inner.select("lang", "f", F.explode(F.expr("array_distinct(flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' ')))))")).alias("phrase"))
    both = cuts.select("lang", "phrase", cut, F.lit(None).cast("long").alias("longer")).unionByName(inner.select("lang", "phrase", F.col("f").alias("longer")), allowMissingColumns=True)
    best = both.groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    best = best.filter(F.col("longer").isNull() | (100 * F.col("longer") < part_of * F.col("cut.a"))).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    # all lists are sorted as one, by ranges, so that no task sorts a language's; its first place is taken off
    placed = stored(with_row_id(best, ["lang", F.desc("score"), F.desc("a"), "phrase"], "place"))
    first = placed.groupBy("lang").agg(F.min("place").alias("first")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # a language may hold most rows: they meet its one row in parts
    best = placed.withColumn("part", (F.col("place") % PARTS).cast("int")).join(first, ["lang", "part"]).withColumn("rank", F.col("place") - F.col("first") + 1).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in SQL for DuckDB, with the parameters of the query.
ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents WHERE text IS NOT NULL
), grams AS (
    SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM pieces, unnest(range(1, 4)) AS t(m), unnest(range(1, len(w) - m + 2)) AS u(i)
), counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS (SELECT * FROM counts WHERE m > 1 AND f >= 10
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.f::HUGEINT * c.f::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
    FROM candidates c, unnest(range(1, c.m)) AS t(k)
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1 : k], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
    SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase, max(f) AS longer FROM candidates, unnest([1, 2]) AS t(i) WHERE m = 3 GROUP BY ALL
), ranked AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
    FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * a
)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
