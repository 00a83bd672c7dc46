"""Column, row and set operations on tables of text cells or typed columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.plans.shared import stored

# What columns of particle tables are taken to be where a table lacks them.
PARTICLE_DEFAULTS = {
    "rlnCoordinateX": "0.0",
    "rlnCoordinateY": "0.0",
    "rlnVoltage": "300.0",
    "rlnSphericalAberration": "2.7",
    "rlnAmplitudeContrast": "0.07",
    "rlnPhaseShift": "0.0",
    "rlnDefocusU": "0.0",
    "rlnDefocusV": "0.0",
    "rlnDefocusAngle": "0.0",
    "rlnCtfMaxResolution": "999.0",
    "rlnImageName": "None",
    "rlnMicrographName": "None",
}


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = "_" + name
    return name


def with_row_id(df: DataFrame, order: Iterable[str | Column], name: str = "row_id") -> DataFrame:
    """Numbers the rows from 0 in the given order, by ranges: each range is sorted and numbered on its own.

    The sorted ranges are stored once, as a second computation could draw other bounds; counts and numbers come from the
    stored rows. The counts of the ranges, one number each, are all that is gathered. Ties are spread over ranges by a hash
    of their rows, so that no range holds a key of many rows alone; their order among each other is open.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    at, part, before, n = fresh(df, "_at"), fresh(df, "_part"), fresh(df, "_before"), fresh(df, "_n")
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = [*order, F.xxhash64(*plain)]
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(at, 33))
    counts = rows.groupBy(part).agg(F.count("*").alias(n))
    before_ = counts.select(part, (F.sum(n).over(Window.orderBy(part)) - F.col(n)).alias(before))  # a row for each range
    numbered = rows.join(F.broadcast(before_), part)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def get_column(df: DataFrame, name: str) -> DataFrame | None:
    """The column as a table of one, None if there is none of that name."""
    return df.select(F.col(f"`{name}`")) if name in df.columns else None


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Casts text columns; a cell that is no such value is an error, as it would be where tables are read."""
    return df.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in kinds.items()})


def vector(names: Iterable[str], kind: str = "float") -> Column:
    """Several columns as one struct of x, y, z, w, v."""
    return F.struct(*[F.col(f"`{c}`").cast(kind).alias(a) for c, a in zip(names, "xyzwv", strict=False)])


def add_column(df: DataFrame, name: str, value: Column | str | float) -> DataFrame:
    """A column at the end; one of that name must not be there yet."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def set_rows(df: DataFrame, name: str, where: Column, value: Column | str | float) -> DataFrame:
    return df.withColumn(name, F.when(where, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(f"`{name}`")))


def modify_column(df: DataFrame, name: str, f: Callable[[Column], Column]) -> DataFrame:
    """``f`` gets the column and may use others of the row through F.col."""
    return df.withColumn(name, f(F.col(f"`{name}`")))


def fill_defaults(df: DataFrame, pixel_size: float, defaults: dict[str, str] | None = None) -> DataFrame:
    """Adds the columns that a particle table lacks; magnification and detector pixel size are always set."""
    missing = {c: F.lit(v) for c, v in (defaults or PARTICLE_DEFAULTS).items() if c not in df.columns}
    return df.withColumns(missing | {"rlnMagnification": F.lit("10000.0"), "rlnDetectorPixelSize": F.lit(f"{pixel_size:.5f}")})


def gather_arrays(df: DataFrame, prefixes: dict[str, str], kind: str = "float") -> DataFrame:
    """Columns prefix1 .. prefixN, up to the first that is missing, as one array each; they are dropped."""
    arrays, gone = {}, []
    for prefix, name in prefixes.items():
        n = 1
        while f"{prefix}{n}" in df.columns:
            n += 1
        steps = [f"{prefix}{k}" for k in range(1, n)]
        arrays[name] = F.array(*[F.col(f"`{c}`").cast(kind) for c in steps])
        gone += steps
    return df.withColumns(arrays).drop(*gone)


def spread_array(df: DataFrame, name: str, prefix: str, n: int) -> DataFrame:
    """The reverse: one column for each of n elements."""
    return df.withColumns({f"{prefix}{k + 1}": F.get(F.col(name), F.lit(k)) for k in range(n)}).drop(name)


def fan_out(df: DataFrame, groups: int, path: Column, order: Iterable[str], name: str = "image") -> DataFrame:
    """Every row once for each of ``groups`` stacks; images are numbered group by group in row order, ``index@path``."""
    numbered = with_row_id(df, order, "_row")
    n = numbered.agg(F.count("*").alias("_total"))
    out = numbered.crossJoin(F.broadcast(n)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return out.withColumn(name, F.format_string("%07d@%s", (F.col("group") * F.col("_total") + F.col("_row") + 1).cast("long"), path)).drop("_row", "_total")


def tilt_fan_out(df: DataFrame, tilts: int | Column, name: str = "tilt") -> DataFrame:
    """Every row once for each tilt, from 0 on, with what is constant over them repeated."""
    n = F.lit(tilts) if isinstance(tilts, int) else tilts
    return df.withColumn(name, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))


def common_union(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, of the columns that all have, in the first one's order."""
    names = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(DataFrame.unionAll, (t.select(*[f"`{c}`" for c in names]) for t in tables))


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``df`` with all rows of the keys in ``new`` replaced by its rows."""
    return df.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def subset(df: DataFrame, rows: DataFrame, key: str = "row_id", place: str = "place") -> DataFrame:
    """The rows that ``rows`` (key, place) names, with the place that each has there."""
    return df.join(rows.select(key, place), key)


def remove_rows(df: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(rows.select(key), key, "left_anti")


def import_particles(df: DataFrame, pixel_size: float) -> DataFrame:
    """Particle table cells as positions in Angstroms, offsets taken off, half sets from 0 and base names of images."""
    from lumenframe.functions import text

    def number(name: str) -> Column:
        return F.col(name).cast("double") if name in df.columns else F.lit(0.0)

    axes = [a for a in "XYZ" if f"rlnCoordinate{a}" in df.columns]
    position = {a.lower(): (number(f"rlnCoordinate{a}") - number(f"rlnOrigin{a}")) * pixel_size for a in axes}
    angles = {k: number(f"rlnAngle{k.capitalize()}") for k in ("rot", "tilt", "psi")}
    return df.select(*[v.alias(k) for k, v in (position | angles).items()], (number("rlnRandomSubset") - 1).cast("int").alias("half"), text.base_name(F.col("rlnMicrographName")).alias("source_name"))


def export_particles(df: DataFrame, pixel_size: float) -> DataFrame:
    """The reverse for columns x, y, z, rot, tilt, psi, half and source_name."""
    cells = {f"rlnCoordinate{a.upper()}": F.col(a) / pixel_size for a in "xyz" if a in df.columns} | {f"rlnAngle{k.capitalize()}": F.col(k) for k in ("rot", "tilt", "psi")}
    return df.select(*[v.alias(k) for k, v in cells.items()], (F.col("half") + 1).alias("rlnRandomSubset"), F.col("source_name").alias("rlnMicrographName"))
