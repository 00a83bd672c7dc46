"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

Texts become 64-bit word hashes. Tasks count the bigrams of what they read, which go by hash to shards that add them
up; each shard tells the word shards how many distinct followers of which count a context has, and how many distinct
contexts a word follows. A shard's hashes are one sorted array beside its counts, stored in the shared folder. To
score, every bucket of documents asks the shards for its distinct bigrams and words; a worker maps a shard's
arrays into memory from a file of its own and searches them, and the answers meet the bucket's texts again. No
task holds more than a shard or a bucket, and their number follows the input.

A corpus that repeats itself makes the bigrams sure of what follows a frequent word, far too sure for a text that puts
known words in an order of its own. So a text is, with probability PLAIN, one of independent words: its probability is that
of the two models, mixed text by text, and never more than PLAIN under what single words give.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import flat_bytes, lower_ascii, mix64, slices, space_words, span_hashes, stored

#: Text bytes of a bucket; text bytes of the training part for each shard.
BUCKET_BYTES, SHARD_BYTES = 7 << 20, 10 << 20
#: Text bytes whose bigrams a task adds up before it sends them.
COUNT_BYTES = 10 << 20
#: Entries that are unpacked at once into a mapped file.
MAP_ENTRIES = 1 << 18
#: Hash bits that are kept of a word or bigram within its shard; a lookup errs once in 2**40 over a shard's entries.
WIDTH = 5
#: How likely a text is one of independent words: little enough that it tells in no text that the bigrams fit.
PLAIN = 1e-6
START, END = np.uint64(0x51ED270B2C9E3A17), np.uint64(0xC3A5C85C97CB3127)

_PART = "kind int, shard int, bucket int, a binary, b binary, c binary, d binary, e binary"


@dataclass
class Model:
    """shards: rows (kind, shard, arrays) of bigrams and words; the rest are totals and the two orders' discounts."""

    shards: DataFrame
    n_shards: int
    tokens: int
    words: int
    types: int
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    low_rest: float


def _pack(short: np.ndarray, size: int = WIDTH) -> bytes:
    """Numbers under 2 ** (8 * size), all lowest bytes first, then all second ones and so on: what Spark compresses well."""
    return np.ascontiguousarray(short.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unpack(raw: bytes, size: int = WIDTH) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((x.shape[1], 8), dtype=np.uint8)
    out[:, :size] = x.T
    return out.view(np.uint64).reshape(-1)


def _pack_sorted(short: np.ndarray) -> bytes:
    """The steps between sorted numbers, whose upper bytes are nearly all zero."""
    return _pack(np.diff(short, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> bytes:
    return _pack(n, 4)


def _counts(column) -> np.ndarray:
    """The counts of all rows of a column, end to end."""
    return np.concatenate([np.zeros(0, np.int64), *(_unpack(x, 4).astype(np.int64) for x in column.to_pylist() if x is not None)])


def _all(column, unpack) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x in column.to_pylist() if x is not None)])


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - 8 * WIDTH)


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bigram's hash from its words' shortened hashes."""
    return mix64(v + mix64(w ^ np.uint64(0x2545F4914F6CDD1D)))


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, end to end, and the rows' offsets."""
    data, off = flat_bytes(text)
    low = lower_ascii(data)
    starts, ends = space_words(low, off)
    h = span_hashes(low, starts, ends)
    cut = np.searchsorted(starts, off)
    n = np.diff(cut)
    rows = np.arange(len(n))
    out = np.full(len(h) + len(n), END, dtype=np.uint64)
    out[np.arange(len(h)) + np.repeat(rows, n)] = h
    return out, np.concatenate(([0], np.cumsum(n + 1)))


def _contexts(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The token before each; before a text's first comes START."""
    v = np.empty_like(h)
    v[1:] = h[:-1]
    v[off[:-1]] = START
    return v


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of each one's values."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return (k[start], *(np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values))


def _cut(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part.astype(np.uint16) if n <= 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int32()] * 3 + [pa.binary()] * 5
    return pa.table([pa.array([r[k] if k < len(r) else None for r in rows], t) for k, t in enumerate(types)], names=["kind", "shard", "bucket", "a", "b", "c", "d", "e"])


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Of how many entries are counted 1, 2, 3 and 4 times: what is taken off entries of 1, 2, and 3 or more."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))  # type: ignore[return-value]


def train(docs: DataFrame, *, text_col: str = "text") -> Model:
    """Counts all texts of ``docs``; a null text is empty, and every text, repeated ones too, counts as it is."""
    src = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(12, int(total // SHARD_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                h, off = _tokens(part.column("text"))
                words, n = np.unique(h, return_counts=True)
                rows = []
                order, at = _cut((_short(words) % np.uint64(shards)).astype(np.int64), shards)
                for s in range(shards):
                    x = order[at[s] : at[s + 1]]
                    if len(x):
                        rows.append((1, s, 0, words[x].tobytes(), _pack_counts(n[x])))
                v, w = _short(_contexts(h, off)), _short(h)
                del h
                key = _pair(v, w)
                order = np.argsort(key, kind="stable")
                k = key[order]
                start = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
                n = np.diff(np.concatenate((start, [len(k)]))).astype(np.uint32)
                v, w, k = v[order[start]], w[order[start]], k[start]
                # by context within a shard: equal contexts then cost next to nothing
                order = np.argsort(v, kind="stable")
                v, w, k, n = v[order], w[order], k[order], n[order]
                order, at = _cut((k % np.uint64(shards)).astype(np.int64), shards)
                for s in range(shards):
                    x = order[at[s] : at[s + 1]]
                    if len(x):
                        rows.append((0, s, 0, _pack_sorted(v[x]), _pack(w[x]), _pack_counts(n[x])))
                yield from _table(rows).to_batches()

    def add(table: pa.Table) -> pa.Table:
        """One shard's bigrams in all, and what its word shards need to know of them."""
        shard = table.column("shard")[0].as_py()
        own = table.filter(pa.compute.equal(table.column("kind"), 1))
        out: list[tuple] = []
        words, n = _sum_by(np.frombuffer(b"".join(own.column("a").to_pylist()), np.uint64), _counts(own.column("b")))
        out.append((3, shard, 0, words.tobytes(), _pack_counts(n)))
        pairs = table.filter(pa.compute.equal(table.column("kind"), 0))
        v, w = _all(pairs.column("a"), _unpack_sorted), _all(pairs.column("b"), _unpack)
        n = _counts(pairs.column("c"))
        key = _pair(v, w)
        order = np.argsort(key, kind="stable")
        k = key[order]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
        n = np.add.reduceat(n[order], start) if len(start) else n
        v, w, key = v[order[start]], w[order[start]], k[start]
        coc = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        out.append((0, shard, 0, _pack_sorted(_short(key)), _pack_counts(n), coc.astype(np.int64).tobytes()))
        v, *followers = _sum_by(v, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
        w, before = _sum_by(w, np.ones(len(n), dtype=np.int64))
        for kind, hashes, values in ((4, v, followers), (5, w, [before])):
            order, at = _cut((hashes % np.uint64(shards)).astype(np.int64), shards)
            for s in np.flatnonzero(np.diff(at)):
                x = order[at[s] : at[s + 1]]
                out.append((kind, int(s), 0, _pack_sorted(hashes[x]), *(_pack_counts(y[x]) for y in values)))
        return _table(out)

    def gather(table: pa.Table) -> pa.Table:
        """One word shard: its words with counts, distinct contexts, and followers by count; START is a context only."""
        of = {k: table.filter(pa.compute.equal(table.column("kind"), k)) for k in (3, 4, 5)}
        words, n = _sum_by(np.frombuffer(b"".join(of[3].column("a").to_pylist()), np.uint64), _counts(of[3].column("b")))
        if table.column("shard")[0].as_py() == int(_short(START) % np.uint64(shards)):
            at = np.searchsorted(words, START)
            words, n = np.insert(words, at, START), np.insert(n, at, 0)
        short = _short(words)
        sums = np.zeros((4, len(words)), dtype=np.int64)
        for k, columns in ((4, "bcd"), (5, "b")):
            at = np.searchsorted(short, _all(of[k].column("a"), _unpack_sorted))
            for j, c in enumerate(columns):
                np.add.at(sums[j if k == 4 else 3], at, _counts(of[k].column(c)))
        before = sums[3]
        totals = np.array([n.sum(), (n > 0).sum(), before.sum(), *np.bincount(np.minimum(before, 5), minlength=6)[1:5], (before > 2).sum()], dtype=np.int64)
        return _table([(1, table.column("shard")[0].as_py(), 0, words.tobytes(), _pack_counts(n), _pack_counts(before), _pack_counts(sums[:3].reshape(-1)), totals.tobytes())])

    counted = stored(src.mapInArrow(count, _PART).groupBy("shard").applyInArrow(add, _PART))
    words = stored(counted.filter("kind >= 3").groupBy("shard").applyInArrow(gather, _PART))
    high, t = _totals(counted.filter("kind = 0"), "c", 4), _totals(words, "e", 8)
    low = discounts(t[3:7])
    rest = low[0] * t[3] + low[1] * t[4] + low[2] * t[7]
    return Model(counted.filter("kind = 0").unionByName(words), shards, int(t[0]), int(t[1]), int(t[2]), discounts(high), low, float(rest))


def _mapped(raw: bytes, dtype: type, size: int, ordered: bool = False) -> np.ndarray:
    """A stored array, unpacked piece by piece into a file of this worker and mapped into memory; the file goes with it.

    ordered: what is stored are the steps between sorted numbers.
    """
    x = np.frombuffer(raw, np.uint8).reshape(size, -1)
    if not x.shape[1]:
        return np.zeros(0, dtype)
    last = np.uint64(0)
    with tempfile.TemporaryFile() as f:
        for k in range(0, x.shape[1], MAP_ENTRIES):
            piece = _unpack(x[:, k : k + MAP_ENTRIES].tobytes(), size)
            if ordered:
                piece = np.cumsum(piece, dtype=np.uint64) + last
                last = piece[-1]
            piece.astype(dtype).tofile(f)
        f.flush()
        return np.memmap(f, dtype=dtype, mode="r")


def _totals(parts: DataFrame, column: str, width: int) -> np.ndarray:
    """The sum of the shards' arrays: each task adds up those that it reads."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                sums += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(sums)], names=["k", "n"])

    rows = parts.select(column).mapInArrow(add, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(width, np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of each text; logarithms to base 10.

    score is the model's log probability of the text's words and its end, base_score that of single words with half a
    count added, which has a share of PLAIN in the model. A null text is empty: its end alone is scored. Repeated rows are scored each. A model of
    nothing gives every token the same probability, 1.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(12, int(total // BUCKET_BYTES))
    shards, m = model.n_shards, model
    # texts of one id would meet in one bucket: their own hash deals them out as well
    src = src.withColumn("bucket", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(buckets)).cast("int"))
    size = {k: getattr(m, k) for k in ("tokens", "words", "types", "high", "low", "low_rest")}

    def distinct(table: pa.Table) -> Iterator[tuple]:
        """The bucket's tokens, and its distinct words and bigrams with their shards, in an order of their own."""
        h, off = _tokens(table.column("text").combine_chunks() if isinstance(table.column("text"), pa.ChunkedArray) else table.column("text"))
        words, word = np.unique(np.concatenate((h, [START])), return_inverse=True)
        short = _short(words)
        v = np.empty(len(h), dtype=np.int64)
        v[1:] = word[:-2]
        v[off[:-1]] = word[-1]
        w = word[:-1]
        pairs, pair = np.unique(_pair(short[v], short[w]), return_inverse=True)
        return off, v, w, pair, (words, *_cut((short % np.uint64(shards)).astype(np.int64), shards)), (pairs, *_cut((pairs % np.uint64(shards)).astype(np.int64), shards))

    def ask(table: pa.Table) -> pa.Table:
        *_, (words, order, at), (pairs, order2, at2) = distinct(table)
        bucket = table.column("bucket")[0].as_py()
        rows = [(1, int(s), bucket, words[order[at[s] : at[s + 1]]].tobytes()) for s in np.flatnonzero(np.diff(at))]
        rows += [(0, int(s), bucket, _pack_sorted(_short(pairs[order2[at2[s] : at2[s + 1]]]))) for s in np.flatnonzero(np.diff(at2))]
        return _table(rows)

    def answer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        have = right.num_rows > 0
        kind = left.column("kind")[0].as_py() if left.num_rows else 0
        a, b, c, d = (right.column(x)[0].as_py() if have else b"" for x in "abcd")
        keys = _mapped(a, np.uint64, WIDTH, True) if kind == 0 else np.frombuffer(a, np.uint64)
        counts = _mapped(b, np.uint32, 4)
        more = [_mapped(c, np.uint32, 4), *_mapped(d, np.uint32, 4).reshape(3, -1)] if kind else []
        for shard, bucket, asked in zip(left.column("shard").to_pylist(), left.column("bucket").to_pylist(), left.column("a").to_pylist(), strict=True):
            q = np.frombuffer(asked, np.uint64) if kind else _unpack_sorted(asked)
            at = np.minimum(np.searchsorted(keys, q), max(0, len(keys) - 1))
            known = keys[at] == q if len(keys) else np.zeros(len(q), bool)
            got = [(np.where(known, x[at], 0) if len(keys) else np.zeros(len(q))).astype(np.uint32) for x in [counts, *more]]
            rows.append((kind, shard, bucket, _pack_counts(got[0]), *([_pack_counts(got[1]), _pack_counts(np.concatenate(got[2:]))] if kind else [])))
        return _table(rows)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        off, v, w, pair, (words, order, at), (pairs, order2, at2) = distinct(left)
        got = np.zeros((5, len(words)), dtype=np.float64)
        pair_count = np.zeros(len(pairs), dtype=np.float64)
        for kind, s, a, b, c in zip(*(right.column(x).to_pylist() for x in ("kind", "shard", "a", "b", "c")), strict=True):
            if kind:
                x = order[at[s] : at[s + 1]]
                got[0, x], got[1, x] = _unpack(a, 4), _unpack(b, 4)
                got[2:, x] = _unpack(c, 4).reshape(3, -1)
            else:
                pair_count[order2[at2[s] : at2[s + 1]]] = _unpack(a, 4)
        n, before = got[0], got[1]
        base = np.log10((n + 0.5) / (size["tokens"] + 0.5 * (size["words"] + 1)))
        if size["types"]:
            low = (before - np.choose(np.minimum(before, 3).astype(int), (0.0, *size["low"])) + size["low_rest"] / (size["words"] + 1)) / size["types"]
            d = size["high"]
            left_over = d[0] * got[2] + d[1] * got[3] + d[2] * got[4]
            # all followers of a context, counted: its own count, or for START the texts
            context = n.copy()
            start, end = np.searchsorted(words, START), np.searchsorted(words, END)
            context[start] = n[end] if end < len(words) and words[end] == END else 0
            seen = context > 0
            share = np.where(seen, left_over / np.maximum(context, 1), 1.0)
            c = pair_count
            top = (c - np.choose(np.minimum(c, 3).astype(int), (0.0, *d)))[pair] / np.maximum(context[v], 1)
            p = np.log10(np.where(seen[v], top, 0.0) + share[v] * low[w])
        else:
            p = np.zeros(len(w))
        tokens = np.diff(off)
        sums = [np.add.reduceat(x, off[:-1]) for x in (p, base[w], (n[w] > 0).astype(np.int64))]
        if size["types"]:
            e = np.log(10)
            sums[0] = np.logaddexp(e * sums[0] + np.log1p(-PLAIN), e * sums[1] + np.log(PLAIN)) / e
        return pa.table([left.column("id"), pa.array(tokens, pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0]), pa.array(10.0 ** np.minimum(300, -sums[0] / tokens))], names=["id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    asked = src.groupBy("bucket").applyInArrow(ask, _PART)
    answers = asked.groupBy("kind", "shard").cogroup(model.shards.groupBy("kind", "shard")).applyInArrow(answer, _PART)
    kind = dict(docs.dtypes)[id_col]
    return src.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(finish, f"id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)


def held_out(docs: DataFrame, train_on: Column, **names) -> DataFrame:
    """``score`` of all of ``docs`` by a model of those that ``train_on`` holds for, with train_tokens."""
    model = train(docs.filter(train_on), text_col=names.get("text_col", "text"))
    return score(docs, model, **names).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
