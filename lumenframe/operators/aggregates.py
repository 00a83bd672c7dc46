"""Aggregations: statistics of a column, histograms, content hashes, merging of partial array sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import hashing, maths


def upper_median(value: str) -> Column:
    """Element n / 2, from 0, of a group's sorted values: exact, so the group's values meet in one row."""
    return F.get(F.sort_array(F.collect_list(value)), F.floor(F.count(value) / 2).cast("int"))


def statistics(value: str) -> dict[str, Column]:
    """mean, std of the population, least and greatest; null for groups without values."""
    return {"mean": F.avg(value), "std": F.stddev_pop(value), "low": F.min(value), "high": F.max(value)}


def weighted_mean(value: str, weight: str, least: float = 1e-6) -> Column:
    """0 where the weights' sum is next to nothing."""
    total = F.sum(F.col(weight).cast("double"))
    return F.when(F.abs(total) > least, F.sum(F.col(value).cast("double") * F.col(weight)) / total).otherwise(0.0)


def non_zero(value: str) -> dict[str, Column]:
    """mean and std of the population of the values that are not zero."""
    v = F.when(F.col(value) != 0, F.col(value))
    return {"mean": F.avg(v), "std": F.stddev_pop(v)}


def within_std(df: DataFrame, value: str, n: float, *, around_median: bool = False) -> DataFrame:
    """Rows within n standard deviations of the mean or upper median, bounds included."""
    from lumenframe.operators.ordered import percentile_by_index

    stats = df.agg(F.avg(value).alias("_mid"), F.stddev_pop(value).alias("_std"))
    if around_median:
        stats = stats.drop("_mid").crossJoin(F.broadcast(percentile_by_index(df, value=value, fraction=0.5).select(F.col("value").alias("_mid"))))  # one row each
    return df.crossJoin(F.broadcast(stats)).filter(F.abs(F.col(value) - F.col("_mid")) <= n * F.col("_std")).drop("_mid", "_std")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of the bins that have values, from the least value to the greatest; end bins are half as wide."""
    bounds = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    placed = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds))  # one row
    return placed.groupBy(maths.histogram_bin(F.col(value), F.col("_low"), F.col("_high"), bins).alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: tuple[int, int]) -> DataFrame:
    """(x_bin, y_bin, n), like ``histogram`` on both axes."""
    bounds = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    placed = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(bounds))  # one row
    return placed.groupBy(maths.histogram_bin(F.col(x), F.col("_x0"), F.col("_x1"), bins[0]).alias("x_bin"), maths.histogram_bin(F.col(y), F.col("_y0"), F.col("_y1"), bins[1]).alias("y_bin")).agg(F.count("*").alias("n"))


def distance_histogram(df: DataFrame, distance: str, bins: int) -> DataFrame:
    """(bin, n) of distances from 0 to the greatest, 1 at least, halves to the even bin."""
    top = df.agg(F.greatest(F.lit(1.0), F.max(distance)).alias("_top"))
    at = F.bround(F.col(distance) / F.col("_top") * (bins - 1)).cast("int")
    return df.filter(F.col(distance).isNotNull()).crossJoin(F.broadcast(top)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row


def conditional_counts(**conditions: Column) -> list[Column]:
    """How many rows meet each condition."""
    return [F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in conditions.items()]


def content_hash(cells: Column, order: list[str]) -> Column:
    """Hash of a group's texts end to end, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, cells.alias("_cell")))), lambda x: x["_cell"])
    return hashing.text_hash(F.array_join(ordered, ""))


def merge_arrays(partials: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Element-wise sums of the arrays of each key, as (keys, i, value): added up before and after the shuffle."""
    rows = partials.select(*keys, F.posexplode(values).alias("i", "_v"))
    return rows.groupBy(*keys, "i").agg(F.sum("_v").alias("value"))


def fsc_shells(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Fourier shell correlation of two half maps, as (keys, shell, fsc).

    voxels: radius, re1, im1, re2, im2. Every voxel counts linearly to the two shells around its radius.
    """
    low = F.floor("radius").cast("int")
    w = F.col("radius") - low
    parts = voxels.withColumn("_s", F.explode(F.array(F.struct(low.alias("shell"), (1 - w).alias("w")), F.struct((low + 1).alias("shell"), w.alias("w")))))
    both = (F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2")) * F.col("_s.w")
    one, two = ((F.col(f"re{k}") * F.col(f"re{k}") + F.col(f"im{k}") * F.col(f"im{k}")) * F.col("_s.w") for k in (1, 2))
    sums = parts.groupBy(*keys, F.col("_s.shell").alias("shell")).agg(F.sum(both).alias("_b"), F.sum(one).alias("_1"), F.sum(two).alias("_2"))
    return sums.select(*keys, "shell", (F.col("_b") / F.greatest(F.lit(1e-6), F.sqrt(F.col("_1") * F.col("_2")))).alias("fsc"))


def correlation_sums(rows: DataFrame, keys: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """(keys, ab, aa, bb, n): sums of products of each group; the keys say whether it is by item, by frame or by grid cell."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return rows.groupBy(*keys).agg(F.sum(x * y * w).alias("ab"), F.sum(x * x * w).alias("aa"), F.sum(y * y * w).alias("bb"), F.count("*").alias("n"))


def grid_cell(value: Column, low: float | Column, high: float | Column, cells: int) -> Column:
    """The cell, from 0, of equally wide ones between the bounds; what lies outside goes to the end cells."""
    at = F.floor((value - low) / (high - low) * cells)
    return F.least(F.greatest(at, F.lit(0)), F.lit(cells - 1)).cast("int")


def mean_curve(items: DataFrame, curve: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, value, n): element by element the mean of the items' curves; shorter curves leave the rest to the others."""
    rows = items.select(*(keys or []), F.posexplode(curve).alias("i", "_v"))
    return rows.groupBy(*(keys or []), "i").agg(F.avg("_v").alias("value"), F.count("_v").alias("n"))
