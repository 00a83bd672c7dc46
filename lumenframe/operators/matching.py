"""Joins beyond equality: containment, neighbours in space, optimal pairs, suppression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of names, 64 more for each, that are told to all tasks.
TOLD = 10 << 20


def contains_join(rows: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Pairs of a row and a name that its text contains; null and empty names match nothing.

    Not a product of both tables: names are found by their first characters, as many as the shortest one has, 8 at most,
    among the distinct stretches of that length in the texts; only such pairs are compared whole. Names of TOLD bytes in
    all are told to all tasks; beyond that both sides are sorted. The stretches are never told, few as their texts may seem.
    """
    known = names.filter(F.col(name) != "")
    q, size = known.agg(F.least(F.lit(8), F.min(F.length(name))), F.sum(F.octet_length(name).cast("long") + 64)).first()
    q = q or 1
    grams = F.when(F.length(text) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substr(F.col(text), i, F.lit(q)))))
    heads = known.withColumn("_gram", F.substring(name, 1, q)).hint("broadcast" if (size or 0) <= TOLD else "merge")
    return rows.withColumn("_gram", F.explode(grams)).join(heads, "_gram").filter(F.col(text).contains(F.col(name))).drop("_gram")


def unique_match(pairs: DataFrame, key: str, match: str) -> DataFrame:
    """(key, match) of the keys that have one match exactly."""
    return pairs.groupBy(key).agg(F.min(match).alias(match), F.count_distinct(match).alias("_n")).filter("_n = 1").drop("_n")


def first_match(pairs: DataFrame, key: str, match: str) -> DataFrame:
    """(key, match): the least match of each key."""
    return pairs.groupBy(key).agg(F.min(match).alias(match))


def ambiguity(rows: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """Each distinct name of ``rows`` with n, how many rows of ``sources`` have it, and state: missing, unique or ambiguous."""
    n = sources.groupBy(name).agg(F.count("*").alias("n"))
    found = rows.select(name).distinct().join(n, name, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("state", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "unique").otherwise("ambiguous"))


def reverse_lookup(rows: DataFrame, sources: DataFrame, name: str, value: str) -> DataFrame:
    """``rows`` whose name is that of a source, with its value; a name that two sources share is an error once it is looked up."""
    one = sources.groupBy(name).agg(F.min(value).alias(value), F.count("*").alias("_n"))
    shared = F.raise_error(F.concat(F.lit("two sources are named "), F.col(name).cast("string")))
    return rows.join(one.withColumn(value, F.when(F.col("_n") > 1, shared).otherwise(F.col(value))).drop("_n"), name)


def unmatched_weight(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, n): how many rows have each key that no source has."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).join(sources.select(key).distinct(), key, "left_anti")


def same_particle(hash_a: Column, name_a: Column, hash_b: Column, name_b: Column) -> Column:
    """By hash where both have one, by name else."""
    have = (F.coalesce(hash_a, F.lit("")) != "") & (F.coalesce(hash_b, F.lit("")) != "")
    return F.when(have, hash_a == hash_b).otherwise(name_a == name_b)


def nearest_bin(rows: DataFrame, vector: str, bins: Sequence[Sequence[float]], name: str = "bin") -> DataFrame:
    """The nearest of a fixed list of centres, the first of equally near ones. The list is part of the expression, not a join."""
    distances = [F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(v)) for v in b]), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) for b in bins]
    df = rows.withColumn("_d", F.array(*distances))
    return df.withColumn(name, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def suppress_pairs(points: DataFrame, *, key: str, x: str, y: str, size: str, tie: str, diameter: float, marked: Column | None = None) -> DataFrame:
    """``points`` with deleted: of two of a key that are closer than diameter / 1.5 the one of less size, the later by
    ``tie`` of equal ones. Points that are deleted or ``marked`` suppress others all the same.

    Only points of the same or neighbouring squares of that width are compared.
    """
    reach = diameter / 1.5
    a = points.select(key, F.col(x).alias("ax"), F.col(y).alias("ay"), F.col(size).alias("asize"), F.col(tie).alias("atie"))
    a = a.withColumn("_cx", F.floor(F.col("ax") / reach)).withColumn("_cy", F.floor(F.col("ay") / reach))
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    b = a.select(key, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("asize").alias("bsize"), F.col("atie").alias("btie"), "_cx", F.col("_cy").alias("_y")).withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    b = b.select(key, "bx", "by", "bsize", "btie", (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_y") + F.col("_dy")).alias("_cy"))
    near = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")) < reach * reach
    loses = (F.col("asize") < F.col("bsize")) | ((F.col("asize") == F.col("bsize")) & (F.col("atie") > F.col("btie")))
    gone = a.join(b, [key, "_cx", "_cy"]).filter(near & loses).select(key, F.col("atie").alias(tie)).distinct().withColumn("_gone", F.lit(True))
    out = points.join(gone, [key, tie], "left").withColumn("deleted", F.coalesce("_gone", F.lit(False)))
    return (out if marked is None else out.withColumn("deleted", F.col("deleted") | marked)).drop("_gone")


def _positions(frame: pd.DataFrame, axes: Sequence[str]) -> np.ndarray:
    return frame[list(axes)].to_numpy(dtype=np.float64)


def greedy_pairs(own: np.ndarray, other: np.ndarray, most: float | None = None) -> list[tuple[int, int, float]]:
    """For each other in turn the nearest own that is left, the first of equally near ones."""
    left, out = np.ones(len(own), dtype=bool), []
    for j, p in enumerate(other):
        if not left.any():
            break
        d = np.where(left, np.sqrt(((own - p) ** 2).sum(axis=1)), np.inf)
        i = int(d.argmin())
        if most is None or d[i] <= most:
            left[i] = False
            out.append((i, j, float(d[i])))
    return out


def optimal_pairs(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of least total cost: shortest augmenting paths with potentials."""
    if not np.isfinite(cost).all():
        raise ValueError("costs must be finite")
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, dtype=int)  # 1-based row of each column
    for row in range(1, n + 1):
        match[0], column = row, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[column]:
            done[column] = True
            r = match[column]
            slack = c[r - 1] - u[r] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], column
            step = np.where(done[1:], np.inf, least[1:])
            nxt = int(step.argmin()) + 1
            u[match[done]] += step[nxt - 1]
            v[done] -= step[nxt - 1]
            least[~done] -= step[nxt - 1]
            column = nxt
        while column:
            match[column] = match[way[column]]
            column = way[column]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def match_particles(own: DataFrame, other: DataFrame, *, key: str, id_col: str, axes: Sequence[str], how: str = "greedy", max_distance: float | None = None) -> DataFrame:
    """(key, own_id, other_id, distance): pairs of one own and one other row of a key.

    greedy: each other row, by id, takes the nearest own row that is left. optimal: least total distance. A key is what
    one image holds: its rows meet in one task, which the sequential choice needs. ``max_distance`` leaves pairs
    beyond it out; without it all are kept, as callers that state no limit expect.
    """
    kind = dict(own.dtypes)

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[key, "own_id", "other_id", "distance"], dtype=object)  # an empty column of floats is no key of another type
        left, right = left.sort_values(id_col), right.sort_values(id_col)
        a, b = _positions(left, axes), _positions(right, axes)
        if how == "greedy":
            found = greedy_pairs(a, b, max_distance)
        else:
            d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
            found = [(i, j, float(d[i, j])) for i, j in optimal_pairs(d) if max_distance is None or d[i, j] <= max_distance]
        return pd.DataFrame({key: [left[key].iloc[0]] * len(found), "own_id": [left[id_col].iloc[i] for i, _, _ in found], "other_id": [right[id_col].iloc[j] for _, j, _ in found], "distance": [d for _, _, d in found]})

    # columns anew, so that a join of the pairs with either table does not meet the same columns again
    columns = [F.col(c).alias(c) for c in (key, id_col, *axes)]
    return own.select(columns).groupBy(key).cogroup(other.select(columns).groupBy(key)).applyInPandas(pair, f"`{key}` {kind[key]}, own_id {kind[id_col]}, other_id {kind[id_col]}, distance double")


def approximate_sets(own: DataFrame, other: DataFrame, pairs: DataFrame, *, id_col: str, tolerance: float, keep: Sequence[str] = ("own", "both", "other")) -> DataFrame:
    """Rows of both tables with origin: own only, both or other only; a pair counts if its distance is within the tolerance.

    What both have is own's row.
    """
    near = pairs.filter((F.col("distance") >= 0) & (F.col("distance") <= tolerance + 1e-6))
    a = own.join(near.select(F.col("own_id").alias(id_col)).withColumn("_m", F.lit(True)), id_col, "left").withColumn("origin", F.when(F.col("_m"), "both").otherwise("own")).drop("_m")
    b = other.join(near.select(F.col("other_id").alias(id_col)), id_col, "left_anti").withColumn("origin", F.lit("other"))
    return a.unionByName(b).filter(F.col("origin").isin(list(keep)))


def density_peaks(points: DataFrame, *, key: str, id_col: str, axes: Sequence[str], cutoff: float, least_density: int, least_distance: float) -> DataFrame:
    """(key, id, density, distance, cluster): clustering by density peaks within each key.

    density counts neighbours within the cutoff; distance is to the nearest point of more density (ties: the lower id
    is denser). Centres reach both limits; the others follow their nearest denser point. No centre reached: -1.
    """
    kind = dict(points.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id_col)
        x = _positions(frame, axes)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        density = (d < cutoff).sum(axis=1) - 1
        order = np.lexsort((np.arange(len(x)), -density))
        distance, up, cluster = np.zeros(len(x)), np.full(len(x), -1), np.full(len(x), -1)
        for k, i in enumerate(order):
            if not k:
                distance[i] = d[i].max()
            else:
                j = order[:k][d[i, order[:k]].argmin()]
                distance[i], up[i] = d[i, j], j
            if density[i] >= least_density and distance[i] >= least_distance:
                cluster[i] = frame[id_col].iloc[i]
            elif up[i] >= 0:
                cluster[i] = cluster[up[i]]
        return pd.DataFrame({key: frame[key].to_numpy(), id_col: frame[id_col].to_numpy(), "density": density, "distance": distance, "cluster": cluster})

    return points.select(key, id_col, *axes).groupBy(key).applyInPandas(run, f"`{key}` {kind[key]}, `{id_col}` {kind[id_col]}, density long, distance double, cluster long")


def positional_join(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Row i of one with row i of the other, each in its own order."""
    from lumenframe.operators.table import with_row_id

    return with_row_id(a, order_a, "_row").join(with_row_id(b, order_b, "_row"), "_row").drop("_row")


def nearest_in_group(rows: DataFrame, centres: DataFrame, *, key: str, id_col: str, value: str, centre_id: str, centre_value: str) -> DataFrame:
    """(id, centre): of the centres of the same key the one nearest in value, the lower id of equally near ones."""
    pairs = rows.join(centres.select(key, centre_id, centre_value), key)
    w = Window.partitionBy(id_col).orderBy(F.abs(F.col(value) - F.col(centre_value)), centre_id)
    return pairs.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(id_col, centre_id)
