"""Removal of byte strings that also start in an earlier document, by difference-cover suffix sorting.

1. Anchors. In every window of 50 bytes the gram with the least hash is an anchor, so equal windows have equal anchors at
   equal places. Anchors go by hash to shards, which find those that two different texts hold; no other window can repeat.
2. Snippets. Each run of windows with such an anchor is cut out, and goes by the anchor to a shard; equal windows
   meet there. Equal snippets are one from here on, with the least document that has it.
3. Suffix sorting. A shard sorts its snippets' suffixes by the difference cover modulo 3: the triples at places not divisible
   by 3 are sorted and named, names are sorted in the same way until they tell all suffixes apart or span a window,
   the remaining suffixes are sorted by their first byte and the next one's name, and both are merged.
4. Adjacent suffixes that share 50 bytes form a group; its windows in documents after the group's first are removed.

Copies of a whole text are found by their digest first, and only the first of them takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import _SPREAD, _powers, dropped, flat_bytes, mix64, slices, stored, with_number

WINDOW = 50
GRAM = 24
#: Windows looked at at once; bytes of text that a bucket of documents should hold; anchors and snippet bytes a shard.
CHUNK, BUCKET_BYTES, SHARD_ANCHORS, SHARD_BYTES = 1 << 19, 6 << 20, 1 << 21, 6 << 20


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def window_anchors(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In parts: places of windows that lie within a row, and the hash of each one's anchor."""
    n, grams = len(data), window - gram + 1
    for a in range(0, max(0, n - window + 1), CHUNK):
        part = data[a : a + CHUNK + window - 1]
        base, inverse = _powers(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_SPREAD[part] * base[: len(part)], out=sums[1:])
        h = mix64((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
        least = _slide(h, grams, np.minimum)
        place = np.arange(a, a + len(least))
        row = np.searchsorted(off, place, side="right") - 1
        inside = place + window <= off[row + 1]
        yield place[inside], least[inside]


def _rows(batch: pa.RecordBatch, text_col: str, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice: row, place in the row and hash of each run of windows with one anchor; where runs start."""
    done = 0
    for part in slices(batch, text_col, 2 << 20):
        data, off = flat_bytes(part.column(text_col))
        places, hashes = [], []
        for p, h in window_anchors(data, off, window, gram):
            places.append(p)
            hashes.append(h)
        if places:
            p, h = np.concatenate(places), np.concatenate(hashes)
            row = np.searchsorted(off, p, side="right") - 1
            new = np.ones(len(p), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1] + 1) | (row[1:] != row[:-1])
            # a run that goes on over places with tied grams is cut at each multiple of the window, so that no snippet is
            # long; each run by itself, as both passes have to cut a row alike whatever rows they see with it
            start = np.flatnonzero(new)
            long = np.diff(np.concatenate((start, [len(p)])))
            new |= (np.arange(len(p)) - np.repeat(start, long)) % window == 0
            start = np.flatnonzero(new)
            yield part, data, off, row[start], p[start], h[start], np.diff(np.concatenate((start, [len(p)])))
        done += part.num_rows


def difference_cover_order(t: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``t`` (positive integers) by their first ``depth`` symbols at least; equal ones in any order."""
    n = len(t)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: t[i : i + depth].tolist()), dtype=np.int64)
    t = np.concatenate((t, np.zeros(4, dtype=np.int64)))
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    names, count = _named(t[sample], t[sample + 1], t[sample + 2])
    if count < len(sample) and depth > 3:
        order = difference_cover_order(names + 1, -(-depth // 3))
    else:
        order = np.argsort(names, kind="stable")
    sampled = sample[order]
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    width, high = len(sampled) + 1, int(t.max()) + 1
    # the rest: already in order of the next suffix, so a stable sort by their own symbol is all
    one = sampled[sampled % 3 == 1]
    rest = one - 1
    own = t[rest]
    rest = rest[np.argsort(own.astype(np.uint16) if high <= 1 << 16 else own, kind="stable")]
    # each sampled suffix, in order: how many of the rest come before it
    sampled = sampled[sampled < n]
    before = np.zeros(len(sampled), dtype=np.int64)
    is_one = sampled % 3 == 1
    one, two = sampled[is_one], sampled[~is_one]
    before[is_one] = np.searchsorted(t[rest] * width + rank[rest + 1], t[one] * width + rank[one + 1])
    pair_rest, pair_two = t[rest] * high + t[rest + 1], t[two] * high + t[two + 1]
    if high * high >= (1 << 62) // width:
        both, _ = _named(np.concatenate((t[rest], t[two])), np.concatenate((t[rest + 1], t[two + 1])), np.zeros(len(rest) + len(two), dtype=np.int64))
        pair_rest, pair_two = both[: len(rest)], both[len(rest) :]
    before[~is_one] = np.searchsorted(pair_rest * width + rank[rest + 2], pair_two * width + rank[two + 2])
    # where names stop short, equal beginnings may have come in another order: all that matters is that they stay together
    place = np.maximum.accumulate(before) + np.arange(len(sampled))
    out = np.empty(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[place] = sampled
    out[free] = rest
    return out


def _named(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of triples in their order, equal for equal ones, and how many there are."""
    high = [int(x.max()) + 1 for x in (a, b, c)]
    if high[0] * high[1] * high[2] <= 1 << 23:
        code = (a * high[1] + b) * high[2] + c
        seen = np.cumsum(np.bincount(code, minlength=1) > 0)
        return seen[code] - 1, int(seen[-1])
    if high[0] * high[1] >= (1 << 62) // high[2]:
        a, n = _named(a, b, np.zeros_like(a))
        b, high[1] = np.zeros_like(a), 1
    found, names = np.unique((a * high[1] + b) * high[2] + c, return_inverse=True)
    return names.reshape(-1), len(found)


def repeated_windows(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A group number for each start: equal for starts whose windows are equal."""
    seen = np.cumsum(np.bincount(text, minlength=256) > 0)
    order = difference_cover_order(seen[text], window)
    number = np.full(len(text), -1, dtype=np.int64)
    number[starts] = np.arange(len(starts))
    order = number[order]
    order = order[order >= 0]
    s = starts[order]
    new = np.ones(len(s), dtype=bool)
    for k in range(1, len(s), 1 << 16):
        at = np.arange(k, min(len(s), k + (1 << 16)))
        same = np.arange(len(at))
        # most neighbours differ soon: only those with equal beginnings are compared whole
        for span in (np.arange(8), np.arange(8, window)) if window > 8 else (np.arange(window),):
            same = same[(text[s[at[same]][:, None] + span] == text[s[at[same] - 1][:, None] + span]).all(axis=1)]
        new[at[same]] = False
    group = np.empty(len(s), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return group


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)


def _split(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def removals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) of each document, its text taken as UTF-8 bytes.

    A byte is removed if a string of ``window`` bytes that covers it also starts in a document with a smaller id. spans
    are start and end of the maximal removed runs, in bytes; kept is what remains, end to end. A null text is empty; a
    null id is smaller than any; rows of one id do not remove each other's bytes. Repeated rows get equal results.
    """
    spark = docs.sparkSession
    src = with_number(docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "own", "id")
    # a row is known by its id and text: rows of one id are cut each by its own spans
    src = src.withColumn("row", F.xxhash64("id", F.lit("row"), "text"))
    total = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(16, total // BUCKET_BYTES)
    shards = max(16, int(total * 2 / (window - gram + 2)) // SHARD_ANCHORS)
    bucket = F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")
    src = src.withColumn("bucket", bucket)

    # 1: anchors of all texts, dealt by hash
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, row, _, h, _ in _rows(batch, "text", window, gram):
                ids, keys, sums, dealt = (part.column(c).to_numpy() for c in ("id", "row", "tid", "bucket"))
                order, cut = _split((h % np.uint64(shards)).astype(np.int64), shards)
                out = []
                for s in range(shards):
                    at = order[cut[s] : cut[s + 1]]
                    if len(at):
                        rows, count = np.unique(row[at], return_counts=True)
                        out.append((s, np.concatenate((ids[rows], keys[rows], sums[rows], dealt[rows].astype(np.int64), count)).tobytes(), h[at].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["shard", "rows", "hashes"])

    def repeated(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(x, np.int64).reshape(5, -1) for x in table.column("rows").to_pylist()]
        ids, keys, sums, dealt, count = (np.concatenate([h[k] for h in heads]) for k in range(5))
        raw = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, 6)
        h = np.zeros((len(raw), 8), dtype=np.uint8)
        h[:, :6] = raw
        h = h.view(np.uint64).reshape(-1)
        del raw
        row = np.repeat(np.arange(len(ids)), count)
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        t = sums[row[order]]
        many = np.minimum.reduceat(t, start) != np.maximum.reduceat(t, start)
        flag = np.zeros(len(h), dtype=bool)
        flag[order] = np.repeat(many, np.diff(np.concatenate((start, [len(h)]))))
        # of copies of a text only the first goes on
        by = np.lexsort((ids, sums))
        first = np.zeros(len(ids), dtype=bool)
        first[by] = np.concatenate(([True], sums[by][1:] != sums[by][:-1]))
        flag &= first[row]
        begin = np.cumsum(count) - count
        at = np.flatnonzero(flag)
        out = []
        o, cut = _split(dealt[row[at]], buckets)
        for b in np.flatnonzero(np.diff(cut)):
            x = at[np.sort(o[cut[b] : cut[b + 1]])]
            rows, n = np.unique(row[x], return_counts=True)
            out.append((int(b), int(table.column("shard")[0].as_py()), np.concatenate((keys[rows], n)).tobytes(), (x - begin[row[x]]).astype(np.uint32).tobytes()))
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "shard", "rows", "places"])

    found = stored(src.withColumn("tid", F.xxhash64("text")).mapInArrow(anchors, "shard int, rows binary, hashes binary").groupBy("shard").applyInArrow(repeated, "bucket int, shard int, rows binary, places binary"))
    n_found = found.agg(F.sum(F.octet_length("places").cast("long"))).first()[0] or 0
    pieces = max(16, n_found // 4 * 2 * window // SHARD_BYTES)

    # 2: snippets of the texts' windows with such anchors, dealt by the anchor
    def snippets(key, left: pa.Table, right: pa.Table) -> pa.Table:
        wanted: dict[int, list[tuple[int, np.ndarray]]] = {}
        for shard, rows, places in zip(right.column("shard").to_pylist(), right.column("rows").to_pylist(), right.column("places").to_pylist(), strict=True):
            keys, n = np.frombuffer(rows, np.int64).reshape(2, -1)
            for i, p in zip(keys.tolist(), np.split(np.frombuffer(places, np.uint32), np.cumsum(n)[:-1]), strict=True):
                wanted.setdefault(i, []).append((shard, p))
        out: list[tuple] = []
        keep = [i in wanted for i in left.column("row").to_pylist()]
        for batch in left.filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches():
            for part, data, off, row, place, h, size in _rows(batch, "text", window, gram):
                ids, keys = part.column("id").to_numpy(), part.column("row").to_numpy()
                shard = (h % np.uint64(shards)).astype(np.int64)
                take = np.zeros(len(h), dtype=bool)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                for r in np.flatnonzero(np.diff(cut)):
                    a, b = cut[r], cut[r + 1]
                    o = np.argsort(shard[a:b], kind="stable")
                    own = shard[a:b][o]
                    for s, p in wanted[int(keys[r])]:
                        mine = o[np.searchsorted(own, s) : np.searchsorted(own, s + 1)]
                        take[a + mine[p[p < len(mine)]]] = True
                at = np.flatnonzero(take)
                if not len(at):
                    continue
                o, c = _split((h[at] // np.uint64(shards) % np.uint64(pieces)).astype(np.int64), pieces)
                for s in np.flatnonzero(np.diff(c)):
                    x = at[o[c[s] : c[s + 1]]]
                    rows, n = np.unique(row[x], return_counts=True)
                    out.append((int(s), np.concatenate((ids[rows], keys[rows], n)).tobytes(), (place[x] - off[row[x]]).astype(np.uint32).tobytes(), size[x].astype(np.uint8).tobytes(), data[_ragged(place[x], size[x] + window - 1)].tobytes()))
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["piece", "rows", "places", "sizes", "bytes"])

    # 3 and 4: suffix sorting of a shard's distinct snippets, and the windows to remove
    def sort(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(x, np.int64).reshape(3, -1) for x in table.column("rows").to_pylist()]
        ids, keys, n = (np.concatenate([h[k] for h in heads]) for k in range(3))
        doc, key = np.repeat(ids, n), np.repeat(keys, n)
        place = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint32)
        size = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.uint8).astype(np.int64)
        text = b"".join(table.column("bytes").to_pylist())
        begin = np.cumsum(size + window - 1) - (size + window - 1)
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(text[a:b], len(number)) for a, b in zip(begin.tolist(), (begin + size + window - 1).tolist(), strict=True)], dtype=np.int64)
        del text
        low = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(low, which, doc)
        joint = np.frombuffer(b"".join(number), np.uint8)
        lengths = np.array([len(x) for x in number], dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        del number
        windows = lengths - window + 1
        starts = _ragged(first, windows)
        owner = np.repeat(np.arange(len(lengths)), windows)
        group = repeated_windows(joint, starts, window)
        least = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, group, low[owner])
        least = least[group]
        # runs of a snippet's windows with one least document: each place of the snippet removes those before its own
        from_window = np.cumsum(windows) - windows
        x = _ragged(from_window[which], windows[which])
        occurrence = np.repeat(np.arange(len(which)), windows[which])
        gone = least[x] < doc[occurrence]
        occurrence, x = occurrence[gone], x[gone]
        at = place[occurrence].astype(np.int64) + (x - from_window[which[occurrence]])
        new = np.ones(len(at), dtype=bool)
        new[1:] = (occurrence[1:] != occurrence[:-1]) | (at[1:] != at[:-1] + 1)
        start = np.flatnonzero(new)
        count = np.diff(np.concatenate((start, [len(at)])))
        d, s, e = key[occurrence[start]], at[start], at[start] + count
        return pa.table({"row": pa.array(d), "start": pa.array(s), "end": pa.array(e + window - 1)})

    deal = F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")
    cuts = src.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(snippets, "piece int, rows binary, places binary, sizes binary, bytes binary").groupBy("piece").applyInArrow(sort, "row long, start long, end long")
    # copies of a text as long as a window go whole: the first of them has all its windows
    sums = stored(src.select("id", "row", F.md5("text").alias("sum"), F.octet_length("text").alias("n")).filter(F.col("n") >= window))
    # stored, so that Spark may split the rows of a text that very many have
    firsts = stored(sums.groupBy("sum").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last"))
    copies = sums.join(firsts, "sum").filter("id > first").select("row", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))
    spans = stored(cuts.unionByName(copies).select(deal, "row", "start", "end"))
    dropped(found, sums, firsts)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, start, end = (right.column(c).to_numpy() for c in ("row", "start", "end"))
        order = np.lexsort((start, ids))
        ids, start, end = ids[order], start[order], end[order]
        own = left.column("row").to_numpy()
        a, b = np.searchsorted(ids, own, side="left"), np.searchsorted(ids, own, side="right")
        n_bytes, n_removed, spans_, kept = [], [], [], []
        for k, t in enumerate(left.column("text")):
            t = t.as_py().encode()
            s, e = start[a[k] : b[k]], np.minimum(end[a[k] : b[k]], len(t))
            top = np.maximum.accumulate(e)
            new = np.concatenate(([True], s[1:] > top[:-1])) if len(s) else np.zeros(0, bool)
            s, e = s[new], top[np.concatenate((np.flatnonzero(new)[1:], [len(s)])) - 1] if len(s) else e
            edge = [0, *np.stack((s, e), axis=1).reshape(-1).tolist(), len(t)]
            kept.append(b"".join(t[i:j] for i, j in zip(edge[::2], edge[1::2], strict=True)))
            spans_.append([{"start": int(i), "end": int(j)} for i, j in zip(s, e, strict=True)])
            n_bytes.append(len(t))
            n_removed.append(int((e - s).sum()))
        return pa.table([left.column("own"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([len(x) for x in spans_], pa.int64()), pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], names=["own", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    out = src.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(finish, f"own {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary")
    return out.select(F.col("own").alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept")
