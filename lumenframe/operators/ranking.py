"""Top-k, subsets and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def take_highest(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The n rows of greatest value, lower ``tie`` first; NaN and null never."""
    return df.filter(~F.isnan(F.col(value).cast("double"))).orderBy(F.desc(value), tie).limit(n)


def take_lowest(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    return df.filter(~F.isnan(F.col(value).cast("double"))).orderBy(value, tie).limit(n)


def take_nearest(df: DataFrame, value: str, centre: float, tie: str, n: int) -> DataFrame:
    """The n rows whose value is nearest to the centre."""
    d = F.col(value) - F.lit(centre)
    return df.filter(F.col(value).isNotNull()).orderBy(d * d, tie).limit(n)


def adaptive_peaks(peaks: DataFrame, *, key: str, score: str, tie: str, n: int, step: float = 0.05, sigmas: float = 4.0, least: float = 0.5, truncate: bool = True) -> DataFrame:
    """Peaks of each key above a threshold that falls in steps from mean + ``sigmas`` standard deviations of its non-zero scores to
    ``least`` until n peaks pass; ``truncate``: then the n best of them."""
    s = F.when(F.col(score) != 0, F.col(score))
    start = peaks.groupBy(key).agg((F.avg(s) + sigmas * F.stddev_pop(s)).alias("_top"))
    df = peaks.join(start, key).withColumn("_step", F.greatest(F.lit(0), F.ceil((F.col("_top") - F.col(score)) / step)))
    df = df.filter((F.col(score) >= least) & ~F.isnan(score))
    levels = df.groupBy(key, "_step").agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(key).orderBy("_step")))
    limit = levels.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_all") >= n, F.col("_step"))), F.max("_step")).alias("_limit"))
    out = df.join(limit, key).filter(F.col("_step") <= F.col("_limit")).drop("_top", "_step", "_limit")
    if not truncate:
        return out
    return out.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).filter(F.col("_k") <= n).drop("_k")


def random_subset(df: DataFrame, key: str, n: int, seed: int = 123) -> DataFrame:
    """n rows without replacement, the same ones for the same seed wherever the rows lie."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def sort_by_key(df: DataFrame, key: str, tie: str) -> DataFrame:
    """By bytes of the key, not by the rules of a language; equal keys in the order of ``tie``."""
    return df.orderBy(key, tie)


def sorted_indices(value: str, tie: str):
    """A group's row numbers by value, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(tie).alias("t")))), lambda x: x["t"])
