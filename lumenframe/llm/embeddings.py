"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

Vectors link within a label only. Equal vectors are one, counted. Each label's cells come from spherical k-means on a
bounded sample; their number follows the label's rows. A vector lives in the cell of its nearest centre and visits others:
the boundary of two cells is a plane through the origin, and only a vector within the link angle of it can have links
beyond. Of the cells that it could have links in a vector visits the PROBES nearest ones, which bounds the work by the rows
and was measured to find nearly all links; ``exact`` lets it visit all of them, so that no link can be missed. Cells of more
rows than a block are dealt out as pairs of blocks, so that one task never holds a cell, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, dropped, stored
from lumenframe.llm.graph import components

SIMILARITY = 0.93
#: Rows that a cell should hold and that a block of one holds; cells of all labels together at most; vectors for k-means a cell.
BLOCK, MOST_CELLS, PER_CELL = 1024, 4096, 20
#: Cells that a vector visits at most, its own included.
PROBES = 4
_SLACK = 1e-6


def spherical_kmeans(x: np.ndarray, k: int, *, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """k unit centres, fewer if there are fewer distinct vectors, of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        full = norm > 1e-12
        centres[full] = sums[full] / norm[full, None]
    return np.unique(np.round(centres, 12), axis=0)


def unit_vectors(table: DataFrame, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(_id, _label, _d, _u, _key): the unit vector in double precision, its length and the digest of it and its label.

    All three are null where the label is, and for a vector that is null, empty or zero or holds null or non-finite numbers.
    """
    rows = table.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("_label").cast(pa.string()).to_pylist()
            units: list = [None] * batch.num_rows
            keys: list = [None] * batch.num_rows
            v = batch.column("_v")
            size = np.asarray(v.value_lengths().fill_null(0))
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null number is NaN
            begin = np.cumsum(size) - size
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                x = flat[begin[at][:, None] + np.arange(d)]
                # by the largest number first, so that neither squares nor sums overflow
                top = np.abs(x).max(axis=1)
                good = np.isfinite(top) & (top > 0)
                at, x = at[good], x[good] / top[good][:, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0
                for i, u in zip(at.tolist(), x, strict=True):
                    if names[i] is not None:
                        units[i], keys[i] = u, hashlib.sha256(names[i].encode() + b"," + u.tobytes()).hexdigest()
            length = [None if u is None else len(u) for u in units]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(length, pa.int32()), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.string())], names=["_id", "_label", "_d", "_u", "_key"])

    return rows.mapInArrow(run, f"_id {dict(table.dtypes)[id_col]}, _label {dict(table.dtypes)[label_col]}, _d int, _u array<double>, _key string")


def _centres(vectors: DataFrame, kind: str) -> dict[tuple, np.ndarray]:
    """The centres of each label and length of more vectors than a block, MOST_CELLS in all at most; others are one cell.

    One job: the samples of all labels are drawn by hash and each is clustered in a task of its own.
    """
    wide = vectors.groupBy("_label", "_d").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > BLOCK)
    scale = F.when(F.sum(F.ceil(F.col("_rows") / BLOCK)) <= MOST_CELLS, F.lit(1.0)).otherwise(F.least(F.lit(1 - 1e-9), F.lit(MOST_CELLS) * BLOCK / F.sum("_rows")))
    wide = wide.crossJoin(F.broadcast(wide.agg(scale.alias("_scale"))))  # one row
    # in proportion to rows and rounded down, so that they add up to MOST_CELLS at most; a label of one cell needs no centre
    cells = F.when(F.col("_scale") < 1, F.floor(F.col("_rows") * F.col("_scale") / BLOCK)).otherwise(F.ceil(F.col("_rows") / BLOCK)).cast("int")
    wide = stored(wide.select("_label", "_d", cells.alias("_k"), "_rows").filter("_k > 1"))
    drawn = vectors.join(wide, ["_label", "_d"]).filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) * F.col("_rows") < F.lit(float(1 << 30) * PER_CELL) * F.col("_k"))

    def cluster(part: pa.Table) -> pa.Table:
        x = part.column("_u").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        c = spherical_kmeans(x[np.argsort(np.array(part.column("_key").to_pylist()))], part.column("_k")[0].as_py())
        return pa.table([part.column("_label").slice(0, 1), pa.array([x.shape[1]], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["_label", "_d", "c"])

    found = drawn.select("_label", "_d", "_k", "_key", "_u").groupBy("_label", "_d").applyInArrow(cluster, f"_label {kind}, _d int, c binary")
    return {(r["_label"], r["_d"]): np.frombuffer(r["c"], np.float64).reshape(-1, r["_d"]) for r in found.toLocalIterator()}


def near_duplicates(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = SIMILARITY, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links of cosine >= ``similarity`` with others of its label.

    n_links counts the other rows linked directly; component_id is the smallest id that links reach, kept marks the row
    that has it. Null, zero and non-finite vectors, vectors of another length and null labels link with nothing. Rows
    without an id link and count, but a component of such rows alone has a null id. Repeated rows are rows of their own.
    """
    spark = table.sparkSession
    kind = dict(table.dtypes)[label_col]
    rows = stored(unit_vectors(table, id_col=id_col, vector_col=vector_col, label_col=label_col))
    # one vector for all that are equal to it; its number is the hash of what it is
    vectors = stored(rows.filter("_key is not null").groupBy("_key").agg(F.first("_label").alias("_label"), F.first("_d").alias("_d"), F.first("_u").alias("_u"), F.count("*").alias("_n"), F.min("_id").alias("_low")))
    shared = spark.sparkContext.broadcast(_centres(vectors, kind))
    sine = float(np.sqrt(1 - min(1.0, similarity) ** 2)) if similarity > 0 else 1.0
    most = None if exact else probes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                groups: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(part.column("_label").to_pylist(), part.column("_d").to_pylist(), strict=True)):
                    groups.setdefault(key, []).append(i)
                for key, at in groups.items():
                    own = part.take(pa.array(at))
                    x = own.column("_u").flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    row, cell, at_cells = visits(x, shared.value.get(key), sine, most)
                    take = pa.array(row)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(c) for c in at_cells]))), pa.int32()), pa.array(np.concatenate(at_cells), pa.int32()))
                    home = np.array([c[0] for c in at_cells])
                    columns = [own.column(c).take(take) for c in ("_key", "_n", "_label", "_d", "_u")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int32()), pa.array(home[row], pa.int32()), lists.take(take)], names=["_key", "_n", "_label", "_d", "_u", "_cell", "_at_home", "_at"])

    dealt = stored(vectors.select("_key", "_n", "_label", "_d", "_u").mapInArrow(deal, f"_key string, _n long, _label {kind}, _d int, _u array<double>, _cell int, _at_home int, _at array<int>"))
    dealt = dealt.withColumn("_home", F.col("_cell") == F.col("_at_home"))
    # rows of each cell, as blocks: a home row meets every block of the cell, a visitor the home blocks
    sizes = dealt.groupBy("_label", "_d", "_cell").agg(F.sum(F.col("_home").cast("long")).alias("homes"), F.count("*").alias("all"))
    dealt = dealt.join(cut(sizes), ["_label", "_d", "_cell"])
    p = F.ceil(F.col("homes") / BLOCK).cast("int")
    q = F.ceil(F.col("all") / BLOCK).cast("int")
    dealt = dealt.withColumns({"_p": p, "_q": q}).withColumn("_mine", F.pmod(F.xxhash64("_key"), F.when(F.col("_home"), F.col("_p")).otherwise(F.lit(1))).cast("int")).withColumn("_other", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("_q")).cast("int"))
    left = dealt.filter("_home").select("_label", "_d", "_cell", F.col("_mine").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("j"), F.lit(True).alias("left"), "_key", "_n", "_u", "_at_home", "_at")
    right = dealt.filter("_p > 0").select("_label", "_d", "_cell", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("i"), F.col("_other").alias("j"), F.lit(False).alias("left"), "_key", "_n", "_u", "_at_home", F.lit(None).cast("array<int>").alias("_at"))

    def products(part: pa.Table) -> pa.Table:
        side = part.column("left").to_numpy(zero_copy_only=False)
        keys = np.array(part.column("_key").to_pylist())
        n = part.column("_n").to_numpy()
        x = part.column("_u").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        hit = x[a] @ x[b].T >= similarity
        hit &= keys[a][:, None] != keys[b][None]
        # a forest of the links: both sides take the smallest name that a link reaches, until none changes
        names, number = np.unique(keys, return_inverse=True)
        one, two = number[a].copy(), number[b].copy()
        r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        dense = hit[np.ix_(r, c)]
        while len(r):
            less = np.minimum(one[r], np.where(dense, two[c][None], len(names)).min(axis=1))
            more = np.minimum(two[c], np.where(dense, less[:, None], len(names)).min(axis=0))
            if (less == one[r]).all() and (more == two[c]).all():
                break
            one[r], two[c] = less, more
        count = hit @ n[b]
        # a visitor counts a link here if the home row does not visit the visitor's own cell, where both would meet again
        home = part.column("_at_home").to_numpy()[b[c]]
        cells = part.column("_at").take(pa.array(a[r])).to_pylist()
        width = max(map(len, cells), default=0)
        cells = np.array([x + x[:1] * (width - len(x)) for x in cells], dtype=np.int64).reshape(len(r), width)
        again = np.zeros(dense.shape, dtype=bool)
        for k in range(width):
            again |= cells[:, k][:, None] == home[None]
        back = n[a[r]] @ (dense & ~again) if len(r) else np.zeros(len(c), np.int64)
        key = np.concatenate((keys[a], keys[b[c]]))
        root = names[np.concatenate((one, two[c]))]
        return pa.table({"_key": pa.array(key.tolist(), pa.string()), "links": pa.array(np.concatenate((count, back)).astype(np.int64)), "root": pa.array(root.tolist(), pa.string())})

    found = stored(left.unionByName(right).groupBy("_label", "_d", "_cell", "i", "j").applyInArrow(products, "_key string, links long, root string"))
    links = found.groupBy("_key").agg(F.sum("links").alias("links"))
    return _finish(rows, vectors, links, _edges(found), id_col)


def visits(x: np.ndarray, centres: np.ndarray | None, sine: float, most: int | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pairs of a row and a cell that it goes to, and each row's cells, its home first; ``most`` of them, the nearest, if given."""
    if centres is None:
        return np.arange(len(x)), np.zeros(len(x), np.int64), [np.zeros(1, np.int64)] * len(x)
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    gap = dots[np.arange(len(x)), home][:, None] - dots
    square = np.maximum(0.0, 2 - 2 * centres @ centres.T)
    reach = gap <= sine * np.sqrt(square)[home] + _SLACK
    reach[np.arange(len(x)), home] = True
    gap = np.where(reach, gap, np.inf)
    gap[np.arange(len(x)), home] = -1.0
    if most is not None and most < len(centres):
        near = np.argpartition(gap, most - 1, axis=1)[:, :most]
        keep = np.zeros_like(reach)
        np.put_along_axis(keep, near, True, axis=1)
        reach &= keep
    cells = []
    for k in range(len(x)):
        own = np.flatnonzero(reach[k])
        cells.append(own[np.argsort(gap[k, own], kind="stable")])
    return np.repeat(np.arange(len(x)), [len(c) for c in cells]), np.concatenate(cells), cells


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("_key").alias("a"), F.col("root").alias("b"))


def _finish(rows: DataFrame, vectors: DataFrame, links: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    roots = components(edges)
    named = cut(vectors.select("_key", "_n", "_low").join(cut(links), "_key", "left").join(cut(roots.withColumnsRenamed({"node": "_key"})), "_key", "left").select("_key", F.coalesce("root", "_key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("_n") - 1).alias("n_links"), "_low"))
    lowest = cut(named.groupBy("root").agg(F.min("_low").alias("component_id")))
    of_key = cut(named.join(lowest, "root").select(F.col("_key").alias("k"), "n_links", "component_id"))
    out = rows.join(of_key, F.col("_key") == F.col("k"), "left").select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
