"""Operators on rows in an order: running sums, moving medians, differences, last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import arrays


def running_dose(tilts: DataFrame, *, key: str, order: list[str], dose: str, default: float = 0.0, name: str = "running") -> DataFrame:
    """The dose up to and with each row; with a default dose each row's number and a half times it instead."""
    w = Window.partitionBy(key).orderBy(*order)
    if default > 0:
        return tilts.withColumn(name, (F.row_number().over(w) - 0.5) * default)
    return tilts.withColumn(name, F.sum(dose).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def half_split_order(tilts: DataFrame, *, key: str, angle: str, dose: str, tie: str, name: str = "place") -> DataFrame:
    """Place of each row by angle. Of equal angles those of more dose come first if the lower half of the series has the more
    dose in all, and last if it has not: the half with less dose was taken first."""
    by_angle = Window.partitionBy(key).orderBy(angle, tie)
    whole = Window.partitionBy(key)
    df = tilts.withColumn("_low", F.row_number().over(by_angle) <= F.floor(F.count("*").over(whole) / 2))
    df = df.withColumn("_sign", F.signum(F.sum(F.when(F.col("_low"), F.col(dose)).otherwise(0)).over(whole) - F.sum(F.when(~F.col("_low"), F.col(dose)).otherwise(0)).over(whole)))
    order = Window.partitionBy(key).orderBy(angle, -F.col("_sign") * F.col(dose), tie)
    return df.withColumn(name, F.row_number().over(order)).drop("_low", "_sign")


def moving_median(df: DataFrame, *, key: str, order: list[str], value: str, width: int, name: str = "median") -> DataFrame:
    """Upper median of the rows from half a width before to half a width after, fewer at the ends."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn(name, arrays.upper_median(F.collect_list(value).over(w)))


def first_difference(df: DataFrame, *, key: str, order: list[str], value: str, name: str = "difference") -> DataFrame:
    """The next value less this one; the last row of each key has none and goes."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(name, F.lead(value).over(w) - F.col(value)).filter(F.col(name).isNotNull())


def turning_points(df: DataFrame, *, key: str, order: list[str], value: str) -> DataFrame:
    """Rows where the values turn from rising to falling, or the other way round; name kind: peak or trough."""
    w = Window.partitionBy(key).orderBy(*order)
    before, after = F.signum(F.col(value) - F.lag(value).over(w)), F.signum(F.lead(value).over(w) - F.col(value))
    return df.withColumn("kind", F.when((before > 0) & (after < 0), "peak").when((before < 0) & (after > 0), "trough")).filter("kind is not null")


def last_average(df: DataFrame, *, key: str, order: list[str], value: str, n: int, name: str = "average") -> DataFrame:
    """The mean of each row's value and those of up to n - 1 before it."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)))


def per_second(average: Column, parallel: int | Column) -> Column:
    """Items a second of ``parallel`` workers that take ``average`` seconds each."""
    return F.try_divide(F.lit(1.0) * parallel, average)


def last_rows(df: DataFrame, *, order: list[str], n: int) -> DataFrame:
    """The n rows that come last in the order, the newest with them: a distributed top n."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def early_mean(frames: DataFrame, *, key: str, order: str, value: str, name: str = "mean_early") -> DataFrame:
    """Of each key: the mean value of the first third of its rows, one at least."""
    w = Window.partitionBy(key)
    df = frames.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w))
    return df.filter(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 3))).groupBy(key).agg(F.avg(value).alias(name))


def percentile_by_index(df: DataFrame, *, value: str, fraction: float) -> DataFrame:
    """One row, value: element floor(n * fraction), from 0, of the sorted non-null values.

    The place is found on a range partition, as a sample of the sort would give another element.
    """
    from lumenframe.operators.table import with_row_id

    known = df.select(F.col(value).alias("value")).filter("value is not null")
    place = known.agg(F.floor(F.count("*") * F.lit(fraction)).cast("long").alias("_place"))
    numbered = with_row_id(known, ["value"], "_row")
    return numbered.join(F.broadcast(place), F.col("_row") == F.col("_place")).select("value")
