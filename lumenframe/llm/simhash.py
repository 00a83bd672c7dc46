"""SimHash near-duplicates through vantage-point trees.

Only distinct fingerprints are compared. The top of a vantage-point tree, built on a bounded sample, deals them to
shards by their Hamming distance to its vantage points: within the median inside, beyond it outside. A fingerprint
outside by no more than the link distance could link to one inside, by the triangle inequality, so it also visits the
inner side; every linked pair therefore stays together at each node and meets in a shard. Within a shard the tree goes on
down to small leaves, and the exact distances decide. A shard reports its links as a forest, which holds the
same components with fewer edges than fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, extended, flat_bytes, lower_ascii, slices, space_words, stored
from lumenframe.llm.graph import components

#: Fingerprints that a shard should hold, and the sample that the top of the tree is built on.
SHARD, SAMPLE = 4096, 50_000
LEAF = 128
SEED = 42


def _one(words: list[bytes], shingle: int) -> int:
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    """Bit k is 1 if it is in over half of the hashes; in parts, so that long texts need no more memory."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", shingle: int = 3, keep_text: bool = False) -> DataFrame:
    """``docs`` with fingerprint, the 64 bits as a long; without the text unless ``keep_text``. A null text has no words: zero."""
    kept = docs.drop("fingerprint")
    given = [c for c in kept.columns if keep_text or c != text_col]
    schema = extended(kept.select(*[f"`{c}`" for c in given]).schema, "fingerprint long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                data, off = flat_bytes(part.column(text_col))
                low = lower_ascii(data).tobytes()
                out = [_one(low[a:b].split(), shingle) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.select(given).columns, pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=[*given, "fingerprint"])

    return kept.mapInArrow(run, schema)


def hexadecimal(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _distance(x: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ point)


def top_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and medians of a whole binary tree in heap order; node k's children are 2k + 1 and 2k + 2."""
    points, radius = np.zeros((1 << depth) - 1, dtype=np.uint64), np.full((1 << depth) - 1, 64, dtype=np.int64)
    rng = np.random.default_rng(SEED)

    def grow(k: int, x: np.ndarray) -> None:
        if k >= len(points) or not len(x):
            return
        points[k], radius[k] = vantage(x, rng)
        d = _distance(x, points[k])
        grow(2 * k + 1, x[d <= radius[k]])
        grow(2 * k + 2, x[d > radius[k]])

    grow(0, sample)
    return points, radius


def vantage(x: np.ndarray, rng: np.random.Generator, tries: int = 8, most: int = 2000) -> tuple[np.uint64, int]:
    """The point of a few, each with its median, whose boundary the fewest others lie just beyond."""
    some = x if len(x) <= most else x[rng.integers(0, len(x), most)]
    best, cost = (x[0], 64), np.inf
    for point in x[rng.integers(0, len(x), tries)]:
        count = np.bincount(_distance(some, point), minlength=70)
        inside = np.cumsum(count)
        for r in range(64):
            if 0 < inside[r] < len(some):
                near = count[r + 1] + count[r + 2]
                # rows that the two sides get, squared: balance and few visitors at once
                c = (inside[r] + near) ** 2 + (len(some) - inside[r]) ** 2
                if c < cost:
                    best, cost = (point, r), c
    return best


def _deal(x: np.ndarray, points: np.ndarray, radius: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``x`` goes to which leaf: to its own, and to the inner side of each boundary that it lies just beyond."""
    at, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    depth = (len(points) + 1).bit_length() - 1
    for _ in range(depth):
        d = _distance(x[at], points[node]).astype(np.int64)
        out = d > radius[node]
        visit = np.flatnonzero(out & (d <= radius[node] + reach))
        at, node = np.concatenate((at, at[visit])), np.concatenate((2 * node + 1 + out, 2 * node[visit] + 1))
    return at, node - len(points)


def link_shard(x: np.ndarray, reach: int) -> np.ndarray:
    """The root, an index, of each fingerprint among those of one shard.

    A group's links are never listed: each row of a leaf takes all that it reaches into one component at once.
    """
    root = np.arange(len(x))
    rng = np.random.default_rng(SEED)
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) > LEAF:
            point, r = vantage(x[at], rng)
            d = _distance(x[at], point).astype(np.int64)
            near, outside = d <= r + reach, d > r
            # a split that leaves a side as large as before does not help
            if max(int(near.sum()), int(outside.sum())) < 0.95 * len(at):
                todo += [at[near], at[outside]]
                continue
        for k in range(0, len(at), 256):
            hit = np.bitwise_count(x[at[k : k + 256]][:, None] ^ x[at][None]) <= reach
            for i in np.flatnonzero(hit.sum(axis=1) > 1):
                own = root[at[hit[i]]]
                if (own != own[0]).any():
                    own = np.unique(own)
                    root[np.isin(root, own)] = own[0]
    return root


def link(prints: DataFrame, *, reach: int = 2) -> DataFrame:
    """(node, root) of all distinct fingerprints that link to another at ``reach`` differing bits or fewer.

    prints: one column fingerprint, distinct. The sample and the tree of it are bounded by SAMPLE rows.
    """
    n = prints.count()
    depth = min(14, max(3, int(n // SHARD).bit_length()))
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    tree = prints.sparkSession.sparkContext.broadcast(top_tree(sample, depth))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, radius = tree.value
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            at, shard = _deal(x, points, radius, reach)
            for k in range(0, len(at), 100_000):
                s = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(shard[s]), pa.array(x[at[s]].view(np.int64))], names=["shard", "fingerprint"])

    def pairs(table: pa.Table) -> pa.Table:
        x = table.column("fingerprint").to_numpy().view(np.uint64)
        root = link_shard(x, reach)
        away = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": x[away].view(np.int64), "b": x[root[away]].view(np.int64)})

    dealt = prints.mapInArrow(deal, "shard long, fingerprint long")
    return components(dealt.groupBy("shard").applyInArrow(pairs, "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, reach: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of each document: the smallest id that links reach, its own included.

    Texts with equal fingerprints link; the fingerprint of a text without words, null included, is zero and links like
    any other. A null id is no id to be named by: its row counts, and a component of such rows alone has a null
    component_id. Repeated rows stay and share a component. A table without rows gives none.
    """
    prints = stored(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), text_col="_text", shingle=shingle))
    groups = cut(prints.groupBy("fingerprint").agg(F.min("_id").alias("low")))
    roots = cut(link(groups.select("fingerprint"), reach=reach))
    named = groups.join(roots, groups["fingerprint"] == roots["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "low")
    named = cut(named)
    lowest = cut(named.groupBy("root").agg(F.min("low").alias("component_id")))
    of_print = cut(named.join(lowest, "root").select("fingerprint", "component_id"))
    return prints.join(of_print, "fingerprint").select(F.col("_id").alias(id_col), "fingerprint", "component_id")
