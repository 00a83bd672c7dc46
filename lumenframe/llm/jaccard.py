"""Near-duplicates by the exact Jaccard similarity of word shingles, found through fingerprints and prefixes of the sets.

Fingerprints within REACH bits meet in the shards of the vantage-point tree; such pairs are checked exactly and link most
close copies. Sets of similarity t can differ in far more bits, where no tree of 64-bit fingerprints can prune, so
prefixes find the rest: two sets whose similarity is t or more share a shingle among the first n - ceil(t n) + 1 of each,
in any one order of all shingles, and behind the first that they share both hold enough for the overlap that t asks for.
Only sets that meet so are compared, and no pair is lost. Stored are those prefixes, the heads; whole sets are made again
from the texts, for pairs that the heads don't rule out, by a pass that takes the texts where they lie. Shingles that are
common in one text of SAMPLE come last in the order, so that a passage in few of very many texts makes no pairs. The commonest are
told to all tasks with their counts, the others as a table of bits of fixed size; which shingles that takes for common only
changes where sets meet. Of the heads only shingles that two sets have go on. Sets also carry 256 parities of their shingles:
as many as differ, so many shingles at least are in one set only, which rules out most that meet by chance before a row is made. Each meeting's sets are first compared with the one that holds the least
before the shared shingle, as a rule the text that the others are edits of; then only pairs of different components are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import bit_table, cut, dropped, extended, flat_bytes, in_table, lower_ascii, slices, stored
from lumenframe.llm.graph import components
from lumenframe.llm.simhash import SEED, _majority, link

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits within which fingerprints meet in the tree.
REACH = 3
#: One text of so many is looked at for common shingles, in how many of those one is common, and how many are told to all tasks by name.
SAMPLE, COMMON, TOLD = 8, 3, 50_000
#: The longs of a set's marks: 256 bits by the highest eight of a shingle, each set if an odd number of its shingles has them.
MARKS = ["g0", "g1", "g2", "g3"]


def _shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words than that are one shingle."""
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-last])).tolist()
    return np.unique(np.array([digest(text[a:b], SEED) for a, b in zip(starts, (ends[last - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64).view(np.int64))


def _parts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Slices of the batches, the set of each _text's shingles, and the sets' digests."""
    for batch in batches:
        for part in slices(batch, "_text"):
            data, off = flat_bytes(part.column("_text"))
            low = lower_ascii(data).tobytes()
            sets = [_shingles(low[a:b].split(), shingle) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield part, sets, np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets)))


def shingle_sets(docs: DataFrame, *, shingle: int) -> DataFrame:
    """(node, s): the set of each _text's shingles and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, node in _parts(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(node), _lists(sets)], names=["node", "s"])

    return docs.select("_text").mapInArrow(run, "node long, s array<long>")


def _sets_of(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, s): stored; the sets of (node, _id), made again from their texts.

    Texts are not shuffled: a table of bits tells which ids are worth it, and sets that it lets through besides go.
    """
    table = bit_table(nodes.select(F.xxhash64("_id").alias("of")), "of")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_table(shared.value, batch.column("_of").to_numpy())))

    # no id asked for, no text read
    some = docs.select(F.xxhash64("_id").alias("_of"), "_text").filter(F.lit(bool(table.any()))).mapInArrow(run, "_of long, _text string")
    return stored(shingle_sets(some, shingle=shingle).join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")))


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The shingles that are most common in a sample of the distinct texts, sorted; in how many of them each is; the bits of all common ones, if there are others."""
    some = docs.select(F.xxhash64("_text").alias("h"), "_text").filter(F.pmod("h", F.lit(SAMPLE)) == 0).groupBy("h").agg(F.first("_text").alias("_text"))
    counts = stored(shingle_sets(some, shingle=shingle).select(F.explode("s").alias("token")).groupBy("token").count().filter(F.col("count") >= COMMON))
    rows = counts.orderBy(F.desc("count"), "token").limit(TOLD).toArrow()
    table = bit_table(_two(counts), "token") if rows.num_rows == TOLD else None
    dropped(counts)
    known = rows.column("token").to_numpy()
    by = np.argsort(known)
    return known[by], rows.column("count").to_numpy()[by], table


def _two(tokens: DataFrame) -> DataFrame:
    """Both halves of each token: two bits of a table for each, so that few others are let through."""
    return tokens.select(F.explode(F.array("token", F.shiftrightunsigned("token", 32))).alias("token"))


def _in_both(table: np.ndarray, token: np.ndarray) -> np.ndarray:
    return in_table(table, token) & in_table(table, token.view(np.uint64) >> np.uint64(32))


def _ordered(x: np.ndarray, common: tuple[np.ndarray, np.ndarray, np.ndarray | None]) -> np.ndarray:
    """A set's shingles in the one order of all: those of the sample last, by their counts if these are told, then by hash."""
    tokens, counts, table = common
    often = np.zeros(len(x), dtype=np.int64) if table is None else _in_both(table, x).astype(np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
        often = np.where(tokens[at] == x, counts[at], often)
    return x[np.lexsort((x, often))]


def _head(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def _marks(sets: list[np.ndarray]) -> list[pa.Array]:
    """The four longs of each set's marks."""
    bits = np.zeros((len(sets), 256), dtype=np.uint8)
    token = np.concatenate(sets).view(np.uint64) if sets else np.zeros(0, np.uint64)
    place = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * 256 + (token >> np.uint64(56)).astype(np.int64)
    bits.reshape(-1)[:] = np.bincount(place, minlength=bits.size) & 1
    longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    return [pa.array(np.ascontiguousarray(longs[:, k])) for k in range(len(MARKS))]


def signatures(docs: DataFrame, *, shingle: int, similarity: float, known=None) -> DataFrame:
    """(_id, node, print, n, head, marks): a digest of the set of each text's shingles, its fingerprint, how many it holds, the first of them, and MARKS."""
    shared = known or docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets, node in _parts(batches, shingle):
            prints = np.array([_majority(s.view(np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
            n = pa.array(np.array([len(s) for s in sets], dtype=np.int32))
            heads = [_ordered(s, shared.value)[: _head(len(s), similarity)] for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(node), pa.array(prints), n, _lists(heads), *_marks(sets)], names=["_id", "node", "print", "n", "head", *MARKS])

    return docs.mapInArrow(run, extended(docs.select("_id").schema, "node long, print long, n int, head array<long>, " + ", ".join(f"{g} long" for g in MARKS)))


def _both(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """The pairs (a, b) with what ``sides`` says of each node, as x and y."""
    side = F.struct([c for c in sides.columns if c != "node"])
    return pairs.join(sides.select(F.col("node").alias("a"), side.alias("x")), "a").join(sides.select(F.col("node").alias("b"), side.alias("y")), "b")


def _similar(pairs: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar.

    What two sets share lies in both of their heads or behind the head that ends first, so heads rule most pairs out.
    Only the sets of the others are made again from their texts, one of each digest.
    """
    pairs = stored(pairs.distinct())
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    heads = stored(heads.join(met, "node", "left_semi"))
    behind = F.ceil(similarity * F.greatest("x.n", "y.n") - 1e-9) - 1
    could = F.size(F.array_intersect("x.head", "y.head")) + behind >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9
    left = stored(_both(pairs, heads.select("node", "n", "head")).filter(could).select("a", "b"))
    met = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = stored(heads.select("node", "_id").join(met, "node", "left_semi"))
    one = _sets_of(nodes, docs, shingle)
    shared, total = F.size(F.array_intersect("x.s", "y.s")), F.size("x.s") + F.size("y.s")
    out = stored(_both(left, one).select("a", "b", shared.alias("i"), total.alias("n")).filter(F.col("i") >= similarity * (F.col("n") - F.col("i")) - 1e-9).select("a", "b"))
    dropped(pairs, heads, left, nodes, one)
    return out


def _close(rows: DataFrame, reach: int) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or in one component of the tree's links: each with the least of its own."""
    least = stored(rows.groupBy("print").agg(F.min("node").alias("node"), F.max("node").alias("high")))
    roots = cut(link(least.select(F.col("print").alias("fingerprint")), reach=reach))
    far = least.join(roots.withColumnsRenamed({"node": "print", "root": "other"}), "print").select("node", "other")
    far = far.join(least.select(F.col("print").alias("other"), F.col("node").alias("hub")), "other").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    same = rows.select("node", "print").join(least.filter("node < high").select("print", F.col("node").alias("hub")), "print").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return far.unionByName(same).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _places(heads: DataFrame) -> DataFrame:
    """(token, node, n, i, marks): stored; the shingles of heads at which sets meet, with each set's size, the shingle's place in the order and MARKS."""
    counts = heads.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    counts = stored(counts)
    shared = heads.sparkSession.sparkContext.broadcast(bit_table(_two(counts), "token"))
    dropped(counts)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                lists = part.column("head")
                token = lists.flatten().to_numpy()
                size = np.diff(lists.offsets.to_numpy())
                of = np.repeat(np.arange(part.num_rows), size)
                i = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                kept = _in_both(shared.value, token)
                of, i = of[kept], i[kept].astype(np.int32)
                node, n, *marks = part.select(["node", "n", *MARKS]).take(pa.array(of)).columns
                yield pa.RecordBatch.from_arrays([pa.array(token[kept]), node, n, pa.array(i), *marks], names=["token", "node", "n", "i", *MARKS])

    return stored(heads.select("node", "n", "head", *MARKS).mapInArrow(explode, "token long, node long, n int, i int, " + ", ".join(f"{g} long" for g in MARKS)))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are not in one component yet, the lesser first."""
    pairs = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    return pairs.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, reach: int = REACH) -> DataFrame:
    """(id, component_id) of each document: the smallest id that links reach, its own included.

    Texts link if the Jaccard similarity of their sets of word shingles reaches ``similarity``; texts without words, null
    included, link to each other. Null ids and repeated rows are as in ``simhash.near_duplicates``.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))
    signed = stored(signatures(docs, shingle=shingle, similarity=similarity, known=known))
    heads = stored(signed.groupBy("node").agg(F.first("n").alias("n"), F.first("head").alias("head"), *[F.first(g).alias(g) for g in MARKS], F.min("_id").alias("_id")))
    rows = stored(signed.select("_id", "node", "print"))
    dropped(signed)

    def similar(pairs: DataFrame) -> DataFrame:
        return _similar(pairs, docs, heads, shingle, similarity)

    close = similar(_close(rows, reach))
    roots = cut(components(close))
    # an overlap of t / (1 + t) of both sizes together is what similarity t asks for
    share = similarity / (1 + similarity)

    def fits(n: str, i: str, m: str, j: str) -> Column:
        small, large = F.least(n, m), F.greatest(n, m)
        apart = sum((F.bit_count(F.col(g).bitwiseXOR(F.col(f"{g}b"))) for g in MARKS), F.lit(0))
        return (small >= similarity * large - 1e-9) & (apart <= (1 - 2 * share) * (F.col(n) + F.col(m)) + 1e-9) & (F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= share * (F.col(n) + F.col(m)) - 1e-9)

    places = _places(heads)
    # the text that holds the least before the token: edits of one text share most with it
    hub = F.min(F.struct((F.col("i") / F.col("n")).alias("part"), "node", "n", "i", *MARKS)).alias("hub")
    hubs = places.join(places.groupBy("token").agg(hub), "token").select(F.col("hub.part").alias("part"), F.col("hub.node").alias("a"), F.col("hub.n").alias("m"), F.col("hub.i").alias("j"), *[F.col(f"hub.{g}").alias(f"{g}b") for g in MARKS], F.col("node").alias("b"), "n", "i", *MARKS)
    hubs = hubs.filter(F.col("a") != F.col("b")).filter(fits("n", "i", "m", "j"))
    hubs = stored(hubs.groupBy("a", "b").agg(F.min("part").alias("part")))
    # each text with its best hub first; then with those of other components only
    best = hubs.groupBy("b").agg(F.min(F.struct("part", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = close
    for pairs in (best, hubs.select("a", "b")):
        links = links.unionByName(similar(_apart(pairs, roots)))
        roots = cut(components(links))
    dropped(hubs)
    rooted = stored(places.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    dropped(places)
    open_ = stored(rooted.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("q")).filter("r < q").select("token"))
    # sets of one token meet those of their own class of sizes and the next, so that a common token is many keys
    size = F.floor(F.log("n") / float(np.log(1 / similarity)) + 1e-9)
    places = stored(rooted.join(open_, "token", "left_semi").withColumn("size", size))
    dropped(rooted, open_)
    small = places.filter(F.col("n") - F.col("i") >= 2 * share * F.col("n") - 1e-9)
    small = small.select(F.col("token").alias("t"), F.explode(F.array("size", F.col("size") + 1)).alias("z"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("r"), *[F.col(g).alias(f"{g}b") for g in MARKS])
    order = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("node")))
    on = [F.col("t") == F.col("token"), F.col("z") == F.col("size"), order, F.col("r") != F.col("root"), fits("n", "i", "m", "j")]
    rest = small.join(places, on).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    roots = cut(components(links.unionByName(similar(rest))))
    dropped(places, heads)
    named = stored(rows.select("_id", "node").join(roots, "node", "left").select("_id", F.coalesce("root", "node").alias("root")))
    dropped(rows)
    lowest = cut(named.groupBy("root").agg(F.min("_id").alias("component_id")))
    return named.join(lowest, "root").select(F.col("_id").alias(id_col), "component_id")
