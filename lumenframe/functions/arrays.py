"""Array functions on the JVM: higher-order functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def _let(value: Column, f) -> Column:
    """f of the value, which is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def add(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Element by element; null where b is 0."""
    return _zip(a, b, lambda x, y: F.try_divide(x, y))


def least(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.least(x, y))


def greatest(a: Column, b: Column) -> Column:
    return _zip(a, b, lambda x, y: F.greatest(x, y))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(_zip(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean(a: Column) -> Column:
    return F.try_divide(total(F.transform(a, lambda x: x.cast("double"))), F.size(a).cast("double"))


def std(a: Column) -> Column:
    """Of the population."""
    return _let(mean(a), lambda m: F.sqrt(F.try_divide(total(F.transform(a, lambda x: (x - m) * (x - m))), F.size(a).cast("double"))))


def normalised(a: Column) -> Column:
    """Mean 0 and standard deviation 1; zeros if all are equal."""
    return _let(F.struct(mean(a).alias("m"), std(a).alias("s")), lambda v: F.transform(a, lambda x: F.when(v["s"] > 0, (x - v["m"]) / v["s"]).otherwise(0.0)))


def cross_correlation(a: Column, b: Column) -> Column:
    """Mean product of the two arrays, each normalised."""
    return F.try_divide(dot(normalised(a), normalised(b)), F.size(a).cast("double"))


def first_difference(a: Column) -> Column:
    """One element fewer: each next one minus this one."""
    return F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.get(a, i + 1) - F.get(a, i))).otherwise(F.slice(a, 1, 0))


def upper_median(a: Column) -> Column:
    """Element n / 2, counted from 0, of the sorted array: the upper one of even counts."""
    return F.get(F.sort_array(a), F.floor(F.size(a) / 2).cast("int"))


def nan_to_zero(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(F.isnan(x), 0.0).otherwise(x))


def indices_of(a: Column, condition) -> Column:
    """0-based places of the elements for which ``condition`` holds."""
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: condition(F.get(a, i)))


def convolve(a: Column, kernel: Column) -> Column:
    """Same length; beyond the ends the array is 0."""
    half = F.floor(F.size(kernel) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.size(a) - 1),
        lambda i: F.aggregate(F.sequence(F.lit(0), F.size(kernel) - 1), F.lit(0.0), lambda s, k: s + F.coalesce(F.when(i + half - k >= 0, F.get(a, i + half - k)), F.lit(0.0)) * F.get(kernel, k)),
    )


def interleave(a: Column, b: Column) -> Column:
    return F.flatten(_zip(a, b, lambda x, y: F.array(x, y)))


def first_below(a: Column, threshold: float) -> Column:
    """Where a falling curve crosses ``threshold``, between the last place above it and the next.

    0 if the first element is at or below it; the last place if none is.
    """
    t = F.lit(threshold)
    at = F.array_min(indices_of(a, lambda x: x <= t))
    before, after = F.get(a, at - 1), F.get(a, at)
    return F.when(at.isNull(), (F.size(a) - 1).cast("double")).when(at == 0, 0.0).otherwise((at - 1) + (before - t) / (before - after))


def element_at_fraction(a: Column, fraction: float) -> Column:
    """Element floor(n * fraction), counted from 0, of the sorted array."""
    return F.get(F.sort_array(a), F.floor(F.size(a) * F.lit(fraction)).cast("int"))


def take(a: Column, condition) -> Column:
    """values and indices (from 0) of the elements for which ``condition`` holds, in their order."""
    return _let(indices_of(a, condition), lambda at: F.struct(F.transform(at, lambda i: F.get(a, i)).alias("values"), at.alias("indices")))


def take_below(a: Column, threshold: float) -> Column:
    """What lies strictly below; NaN never does."""
    return take(a, lambda x: ~F.isnan(x) & (x < threshold))


def take_above(a: Column, threshold: float) -> Column:
    """What lies strictly above; NaN never does."""
    return take(a, lambda x: ~F.isnan(x) & (x > threshold))


def sliding_correlation(a: Column, b: Column, lengths: Column, start: int = 0, least: int = 1) -> Column:
    """For each place from ``start`` on the correlation of both arrays in a window about it, of its own length; NaN elsewhere.

    A window has ``least`` places or more and reaches half its length to both sides, the place at its end not included,
    and less at the ends of the array; the last ``least`` / 2 places have none.
    """
    half = lambda i: F.floor(F.greatest(F.lit(least), F.get(lengths, i)) / 2).cast("int")

    def one(i: Column) -> Column:
        low, high = F.greatest(F.lit(0), i - half(i)), F.least(F.size(a), i + half(i))
        inside = (i >= start) & (i < F.size(a) - least // 2)
        return F.when(inside, cross_correlation(F.slice(a, low + 1, high - low), F.slice(b, low + 1, high - low))).otherwise(F.lit(float("nan")))

    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), one)
