"""Small text formats of experiments, parsed with column expressions: mdoc, affine lists, logs, PDB atoms; item XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import text


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r", "").alias("value"))


def read_mdoc(spark: SparkSession, path: str) -> DataFrame:
    """(path, axis, zvalue, angle, dose, movie, time): a row for each [ZValue] block; what a block lacks is null.

    Angles are rounded to a tenth, movies are base names; times read dd-MMM-yy HH:mm:ss.
    """
    files = _whole(spark, path).withColumn("axis", F.regexp_extract("value", r"Tilt axis angle = (-?[\d.]+)", 1).try_cast("double"))
    rows = files.select("path", "axis", F.posexplode(F.split("value", r"\[ZValue = ")).alias("k", "b")).filter("k > 0")

    def cell(name: str):
        return F.trim(F.regexp_extract("b", rf"(?m)^\s*{name} = (.*)$", 1))

    return rows.select(
        "path", "axis", F.regexp_extract("b", r"^(\d+)", 1).try_cast("int").alias("zvalue"), F.bround(cell("TiltAngle").try_cast("double"), 1).alias("angle"),
        cell("ExposureDose").try_cast("double").alias("dose"), text.base_name(cell("SubFramePath")).alias("movie"),
        F.try_to_timestamp(F.regexp_replace(cell("DateTime"), r"\s+", " "), F.lit("dd-MMM-yy HH:mm:ss")).alias("time"),
    )


def read_lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(path, row, cells): the lines that are not empty, after the first ``skip``, in order."""
    rows = _whole(spark, path).select("path", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    return rows.filter(F.col("row") >= skip).select("path", (F.col("row") - skip).alias("row"), F.split(F.trim("line"), r"\s+").alias("cells"))


def read_xf(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, a11, a12, a21, a22, dx, dy) of affine transforms."""
    names = ("a11", "a12", "a21", "a22", "dx", "dy")
    return read_lines(spark, path).select("path", "row", *[F.get("cells", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)])


def read_tilt_solution(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, correction): the third number of each line after the header."""
    return read_lines(spark, path, skip=1).select("path", "row", F.get("cells", F.lit(2)).cast("double").alias("correction"))


def read_tilts(spark: SparkSession, path: str) -> DataFrame:
    """Tilts of a series table; dose and angle must be there, what else is missing is 0."""
    from lumenframe.sources import star

    df = star.read(spark, path)
    for needed in ("wrpDose", "wrpAngleTilt"):
        if needed not in df.columns:
            raise ValueError(f"no column {needed}")
    cells = {"dose": "wrpDose", "angle": "wrpAngleTilt", "axis": "wrpAxisAngle", "offset_x": "wrpAxisOffsetX", "offset_y": "wrpAxisOffsetY"}
    movie = F.col("wrpMovieName") if "wrpMovieName" in df.columns else F.lit(None).cast("string")
    return df.select("_path", F.col("_row").alias("tilt_id"), movie.alias("movie"), *[(F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(n) for n, c in cells.items()])


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """(path, serial, name, residue, chain, number, x, y, z, element) of ATOM and HETATM records."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value").filter(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))

    def cell(start: int, size: int):
        return F.trim(F.substring("value", start, size))

    return lines.select("path", cell(7, 5).cast("int").alias("serial"), cell(13, 4).alias("name"), cell(18, 3).alias("residue"), cell(22, 1).alias("chain"), cell(23, 4).cast("int").alias("number"), *[cell(s, 8).cast("double").alias(a) for s, a in ((31, "x"), (39, "y"), (47, "z"))], cell(77, 2).alias("element"))


def read_items(spark: SparkSession, path: str, tag: str = "Movie") -> DataFrame:
    """Item records in short: path, root_name, manual, resolution, motion, mask, maps of parameters and thresholds, curve, grid.

    A file that is no XML record gives no row; cells that don't parse are null. The whole records: ``item_xml.read``.
    """
    from lumenframe.sources import item_xml

    texts = spark.read.format("binaryFile").load(path).select("path", "content")
    df = item_xml.parse(item_xml.as_texts(texts)).filter(F.col("kind") == tag)
    return df.select(
        "path", "root_name", F.col("unselect_manual").alias("manual"), F.col("resolution").cast("double"), F.col("motion").cast("double"), F.col("mask").cast("double"), "ctf", F.try_element_at("options", F.lit("OptionsCTF")).alias("options_ctf"), F.try_element_at("options", F.lit("OptionsMovement")).alias("options_movement"),
        F.transform_values("picking_thresholds", lambda _, v: v.cast("double")).alias("picking_thresholds"), "spectrum", F.try_element_at("grids", F.lit("GridCTF")).alias("grid"),
    )


def series_tilts(mdoc: DataFrame, transforms: DataFrame) -> DataFrame:
    """Tilts of each series by angle, with the transform of the same place: series are told by their root names. What one side has in excess stays, with nulls for the other."""
    a = mdoc.withColumn("series", text.root_name(F.col("path"))).withColumn("row", F.row_number().over(Window.partitionBy("path").orderBy("angle", "zvalue")) - 1)
    b = transforms.withColumn("series", text.root_name(F.col("path"))).drop("path")
    return a.join(b, ["series", "row"], "full")
