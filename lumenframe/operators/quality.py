"""Quality of items: range filter, status and validity. NaN fails every threshold, as no comparison with it holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.table import fresh


@dataclass(frozen=True)
class Ranges:
    """Limits of the quality filter."""

    astigmatism: float = 3.0
    defocus: tuple[float, float] = (0.0, 5.0)
    phase: tuple[float, float] = (0.0, 1.0)
    resolution: float = 5.0
    motion: float = 5.0
    particles: int = 1
    mask: float = 10.0


def at_most(value: Column, limit: float | Column) -> Column:
    return ~F.isnan(value.cast("double")) & (value <= limit)


def at_least(value: Column, limit: float | Column) -> Column:
    return ~F.isnan(value.cast("double")) & (value >= limit)


def astigmatism_statistics(items: DataFrame, x: str, y: str, floor: float = 1e-4) -> DataFrame:
    """One row: mean_x and mean_y of the astigmatism vectors, and their root mean square distance from it."""
    # one pass: the mean square distance is the mean square less the square of the mean
    sums = items.agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.avg(F.col(x) * F.col(x) + F.col(y) * F.col(y)).alias("_s"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_s") - F.col("mean_x") * F.col("mean_x") - F.col("mean_y") * F.col("mean_y")))
    return sums.select("mean_x", "mean_y", F.greatest(F.lit(floor), spread).alias("std"))


def range_filter(items: DataFrame, ranges: Ranges, *, fit_phase: bool = False) -> DataFrame:
    """``items`` with accepted: all clauses whose stage has results hold.

    Columns: defocus, resolution, phase and astigmatism_x, astigmatism_y are null without the contrast transfer function,
    motion without motion correction, particles without picking; mask always counts.
    """
    stats = astigmatism_statistics(items.filter("defocus is not null"), "astigmatism_x", "astigmatism_y")
    own = fresh(items, "_astigmatism")
    df = items.crossJoin(F.broadcast(stats.select(F.struct("*").alias(own))))  # one row
    dx, dy = F.col("astigmatism_x") - F.col(f"{own}.mean_x"), F.col("astigmatism_y") - F.col(f"{own}.mean_y")
    clauses = {
        "defocus": at_least(F.col("defocus"), ranges.defocus[0]) & at_most(F.col("defocus"), ranges.defocus[1]),
        "astigmatism_x": at_most(F.sqrt(dx * dx + dy * dy) / F.col(f"{own}.std"), ranges.astigmatism),
        "resolution": at_most(F.col("resolution"), ranges.resolution),
        "motion": at_most(F.col("motion"), ranges.motion),
        "particles": (F.col("particles") < 0) | (F.col("particles") >= ranges.particles),
    }
    if fit_phase:
        clauses["phase"] = at_least(F.col("phase"), ranges.phase[0]) & at_most(F.col("phase"), ranges.phase[1])
    good = F.coalesce(at_most(F.col("mask"), ranges.mask), F.lit(True))
    for stage, clause in clauses.items():
        good = good & F.when(F.col(stage).isNull(), True).otherwise(clause)
    return df.withColumn("accepted", good).drop(own)


def status(manual: Column, filtered_out: Column, stored: dict[str, Column], wanted: dict[str, tuple[Column, Column]], is_series: Column) -> Column:
    """LeaveOut, Unprocessed, Outdated, FilteredOut or Processed.

    manual: null, or whether a user left the item out; stored: each stage's options, null if it never ran; wanted: for
    each stage whether it is on, and the options it should have. Series have their first stage alone compared.
    """
    ran = None
    for options in stored.values():
        ran = options.isNotNull() if ran is None else ran | options.isNotNull()
    outdated = F.lit(False)
    for k, (stage, (on, options)) in enumerate(wanted.items()):
        changed = on & ~stored[stage].eqNullSafe(options)
        outdated = outdated | (changed if k == 0 else changed & ~is_series)
    return (
        F.when(F.coalesce(manual, F.lit(False)), "LeaveOut")
        .when(~ran, "Unprocessed")
        .when(outdated, "Outdated")
        .when(filtered_out & manual.isNull(), "FilteredOut")
        .otherwise("Processed")
    )


def valid_items(items: DataFrame, *, filtered: bool = False, left_out: bool = False) -> DataFrame:
    """Items to export: columns unselect_filter, unselect_manual and options_ctf. Both flags let such items in."""
    keep = F.col("options_ctf").isNotNull()
    if not filtered:
        keep = keep & ~(F.col("unselect_filter") & F.col("unselect_manual").isNull())
    if not left_out:
        keep = keep & ~F.coalesce(F.col("unselect_manual"), F.lit(False))
    return items.filter(keep)


def name_filter(items: DataFrame, pattern: str, statuses: list[str] | None = None, *, name: str = "name", state: str = "status") -> DataFrame:
    """Items whose name the pattern finds and whose status is one of those given; a pattern that is none lets all pass."""
    if pattern and _is_pattern(items, pattern):
        items = items.filter(F.col(name).rlike(pattern))
    return items if statuses is None else items.filter(F.col(state).isin(statuses))


def _is_pattern(df: DataFrame, pattern: str) -> bool:
    """Asked of the engine that will run it."""
    from py4j.protocol import Py4JJavaError

    try:
        df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError:
        return False
    return True


def score_threshold(picks: DataFrame, items: DataFrame, suffix: str, *, key: str = "item_id", score: str = "fom", thresholds: str = "picking_thresholds") -> DataFrame:
    """Picks that reach their item's threshold for the suffix; all of items without one."""
    limits = items.select(key, F.col(thresholds)[suffix].alias("_least"))
    return picks.join(limits, key, "left").filter(F.col("_least").isNull() | at_least(F.col(score), F.col("_least"))).drop("_least")


def away_from_border(picks: DataFrame, width: Column, height: Column, diameter: float) -> DataFrame:
    """Picks that are over 0.8 diameters from all four sides."""
    d = 0.8 * diameter
    return picks.filter((F.col("x") > d) & (F.col("y") > d) & (F.col("x") < width - d) & (F.col("y") < height - d))
