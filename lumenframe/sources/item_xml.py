"""XML records of experiments, both ways: items and tilt series, and populations with their species and sources.

A file is a row. Its text is parsed on the JVM by a given schema, as inference would take a lone child for a struct; its
text is made by column expressions, and the task that has the row writes the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import text
from lumenframe.sources.maps import file_system

# Names of elements and attributes.
ITEM, SERIES = "Movie", "TiltSeries"
ATTRIBUTES = {
    "unselect_filter": ("UnselectFilter", "boolean"), "unselect_manual": ("UnselectManual", "boolean"), "resolution": ("CTFResolutionEstimate", "decimal(20,6)"), "motion": ("MeanFrameMovement", "decimal(20,6)"), "mask": ("MaskPercentage", "decimal(20,6)"),
    "bfactor": ("Bfactor", "float"), "weight": ("Weight", "float"), "magnification": ("MagnificationCorrection", "string"), "angles_inverted": ("AreAnglesInverted", "boolean"), "plane_normal": ("PlaneNormal", "string"),
}
OPTIONS = ["OptionsCTF", "OptionsMovement", "OptionsBoxNet", "OptionsMovieExport", "OptionsParticlesExport"]
CURVES = {"spectrum": "PS1D", "background": "SimulatedBackground", "scale": "SimulatedScale"}
GRIDS = [
    "GridCTF", "GridCTFDefocusDelta", "GridCTFDefocusAngle", "GridCTFPhase", "GridCTFDoming", "GridBeamTiltX", "GridBeamTiltY", "GridMovementX", "GridMovementY", "GridLocalMovementX", "GridLocalMovementY", "GridVolumeWarpX", "GridVolumeWarpY", "GridVolumeWarpZ",
    "GridAngleX", "GridAngleY", "GridAngleZ", "GridDoseBfacs", "GridDoseBfacsDelta", "GridDoseBfacsAngle", "GridDoseWeights", "GridLocationBfacs", "GridLocationWeights",
]
PYRAMIDS = {"pyramid_x": "PyramidShiftX", "pyramid_y": "PyramidShiftY"}
TILTS = {"angle": ("Angles", "float"), "dose": ("Dose", "float"), "use": ("UseTilt", "boolean"), "axis": ("AxisAngle", "float"), "offset_x": ("AxisOffsetX", "float"), "offset_y": ("AxisOffsetY", "float"), "movie": ("MoviePath", "string")}
TILT_CURVES = {"tilt_spectra": "TiltPS1D", "tilt_scales": "TiltSimulatedScale"}

_GRID_XML = "struct<_Width: int, _Height: int, _Depth: int, _Duration: int, _MarginX: float, _MarginY: float, _MarginZ: float, Node: array<struct<_X: int, _Y: int, _Z: int, _W: int, _Value: float>>>"
_PARAMS_XML = "struct<Param: array<struct<_Name: string, _Value: string>>>"
GRID = "struct<width: int, height: int, depth: int, duration: int, margins: array<float>, values: array<float>>"
_CURVE = "array<struct<x: float, y: float>>"
#: The rows of items and series alike; what a record lacks is null, of maps the key.
SCHEMA = ", ".join(
    ["path string", "root_name string", "kind string"] + [f"{name} {kind}" for name, (_, kind) in ATTRIBUTES.items()] + [f"{name} {_CURVE}" for name in CURVES]
    + ["ctf map<string, string>", "options map<string, map<string, string>>", f"grids map<string, {GRID}>"] + [f"{name} array<{GRID}>" for name in PYRAMIDS]
    + ["picking_thresholds map<string, decimal(20,6)>", "tilts array<struct<" + ", ".join(f"{n}: {k}" for n, (_, k) in TILTS.items()) + ">>"] + [f"{name} array<{_CURVE}>" for name in TILT_CURVES]
)


def read_texts(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(path, xml): files as text, in UTF-16 where they begin with its mark, else in UTF-8; bytes that are neither show as replacements."""
    return as_texts(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"))


def as_texts(files: DataFrame) -> DataFrame:
    """(path, content) as (path, xml)."""
    mark = F.hex(F.substring("content", 1, 2))
    utf8 = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    return files.select("path", F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(F.make_valid_utf8(utf8.cast("string"))).alias("xml"))


def _as_map(params: Column) -> Column:
    """Parameters as a map, of a name that comes twice the last; null without the element."""
    found = F.coalesce(params["Param"], F.array())
    return F.when(params.isNotNull(), F.aggregate(found, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["_Name"]), F.create_map(p["_Name"], p["_Value"]))))


def _as_curve(points: Column) -> Column:
    """'x|y;x|y' as points; a cell that is no number is null."""
    cells = F.transform(F.split(points, ";"), lambda p: F.split(p, r"\|"))
    return F.when(points.isNotNull(), F.transform(cells, lambda c: F.struct(F.get(c, F.lit(0)).try_cast("float").alias("x"), F.get(c, F.lit(1)).try_cast("float").alias("y"))))


def _as_grid(g: Column) -> Column:
    """Nodes by their places, x fastest; a missing node is 0, of one that comes twice the last counts, one outside is left out."""
    w, h, d, t = (F.coalesce(g[c], F.lit(1)) for c in ("_Width", "_Height", "_Depth", "_Duration"))
    nodes = F.coalesce(g["Node"], F.array())
    places = F.transform(nodes, lambda n: F.struct(F.when(n["_X"].between(0, w - 1) & n["_Y"].between(0, h - 1) & n["_Z"].between(0, d - 1) & F.coalesce(n["_W"], F.lit(0)).between(0, t - 1), ((F.coalesce(n["_W"], F.lit(0)) * d + n["_Z"]) * h + n["_Y"]) * w + n["_X"]).alias("i"), n["_Value"].alias("v")))
    in_order = (F.size(places) == w * h * d * t) & F.forall(F.transform(places, lambda p, k: p["i"].eqNullSafe(k)), lambda x: x)
    values = F.when(in_order, F.transform(places, lambda p: p["v"])).otherwise(F.transform(F.sequence(F.lit(0), w * h * d * t - 1), lambda k: F.coalesce(F.try_element_at(F.filter(places, lambda p: p["i"] == k), F.lit(-1))["v"], F.lit(0.0).cast("float"))))
    margins = F.when(g["_MarginX"].isNotNull(), F.array(g["_MarginX"], g["_MarginY"], g["_MarginZ"]))
    return F.when(g.isNotNull(), F.struct(w.alias("width"), h.alias("height"), d.alias("depth"), g["_Duration"].alias("duration"), margins.alias("margins"), values.alias("values")))


def _without_nulls(names: list[str], cells: list[Column]) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*cells)), lambda _, v: v.isNotNull())


def parse(texts: DataFrame) -> DataFrame:
    """Items and series of (path, xml), by SCHEMA. A text that is no such record has its path and name only, an empty file no row; a cell that doesn't parse is null."""
    schema = ", ".join(
        [f"_{a} string" for a, _ in ATTRIBUTES.values()] + [f"{e} string" for e in CURVES.values()] + [f"CTF {_PARAMS_XML}"] + [f"{o} {_PARAMS_XML}" for o in OPTIONS] + [f"{g} {_GRID_XML}" for g in GRIDS] + [f"{p} array<{_GRID_XML}>" for p in PYRAMIDS.values()]
        + ["PickingThresholds struct<Threshold: array<struct<_Suffix: string, _Value: string>>>"] + [f"{e} string" for e, _ in TILTS.values()] + [f"{e} array<struct<_ID: int, _VALUE: string>>" for e in TILT_CURVES.values()]
    )
    kind = F.nullif(F.regexp_extract("xml", rf"<({ITEM}|{SERIES})[\s/>]", 1), F.lit(""))
    # white space is trimmed here where it is due, not by the parser
    rows = texts.select("path", kind.alias("kind"), F.when(kind.isNotNull(), F.from_xml("xml", schema, {"mode": "PERMISSIVE"})).alias("x"))

    def attribute(a: str, t: str) -> Column:
        return F.col(f"x._{a}").try_cast(t) if t != "string" else F.col(f"x._{a}")

    def cells(element: str, t: str) -> Column:
        # bounds of lines as they stand in the file
        found = F.transform(F.split(F.col(f"x.{element}"), "\n"), lambda v: F.regexp_replace(v, r"[ \r\t]", ""))
        return found if t == "string" else F.transform(found, lambda v: v.try_cast(t))

    lists = {n: cells(e, t) for n, (e, t) in TILTS.items()}
    size = F.size(lists["angle"])
    # What a tilt has whose list is missing.
    missing = {"use": F.lit(True), "movie": F.lit("")}
    tilt = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(*[F.when(lists[n].isNull(), missing.get(n, F.lit(0.0).cast("float"))).otherwise(F.get(lists[n], i)).cast(TILTS[n][1]).alias(n) for n in TILTS]))
    thresholds = F.aggregate(F.col("x.PickingThresholds.Threshold"), F.create_map().cast("map<string,decimal(20,6)>"), lambda m, p: F.when(p["_Value"].try_cast("decimal(20,6)").isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda k, _: k != p["_Suffix"]), F.create_map(p["_Suffix"], p["_Value"].try_cast("decimal(20,6)")))))
    columns = [F.col("path"), text.root_name(F.col("path")).alias("root_name"), F.col("kind")]
    columns += [attribute(a, t).alias(n) for n, (a, t) in ATTRIBUTES.items()]
    columns += [_as_curve(F.col(f"x.{e}")).alias(n) for n, e in CURVES.items()]
    columns += [_as_map(F.col("x.CTF")).alias("ctf"), F.when(F.col("x").isNotNull(), _without_nulls(OPTIONS, [_as_map(F.col(f"x.{o}")) for o in OPTIONS])).alias("options"), F.when(F.col("x").isNotNull(), _without_nulls(GRIDS, [_as_grid(F.col(f"x.{g}")) for g in GRIDS])).alias("grids")]
    columns += [F.transform(F.col(f"x.{e}"), _as_grid).alias(n) for n, e in PYRAMIDS.items()]
    columns += [thresholds.alias("picking_thresholds"), F.when(F.col("x.Angles").isNotNull(), tilt).alias("tilts")]
    columns += [F.transform(F.array_sort(F.transform(F.col(f"x.{e}"), lambda c, k: F.struct(c["_ID"].alias("id"), k.alias("k"), c["_VALUE"].alias("v")))), lambda c: _as_curve(c["v"])).alias(n) for n, e in TILT_CURVES.items()]
    return rows.select(*columns)


def read(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """Items and series of the files of a folder, by SCHEMA; see ``parse``."""
    return parse(read_texts(spark, path, glob))


def _escaped(c: Column) -> Column:
    c = c.cast("string")
    # line ends and tabs of attributes would come back as spaces
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def _attr(name: str, value: Column) -> Column:
    """An attribute; none if the value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), _escaped(value), F.lit('"')), F.lit(""))


def _net_boolean(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False")


def _element(name: str | Column, inner: Column, attributes: Column | None = None) -> Column:
    """An element; nothing if the inner text is null."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.coalesce(F.concat(F.lit("<"), name, attributes if attributes is not None else F.lit(""), F.lit(">"), inner, F.lit("</"), name, F.lit(">\n")), F.lit(""))


def _params(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda p: F.concat(F.lit("<Param"), _attr("Name", p["key"]), _attr("Value", F.coalesce(p["value"], F.lit(""))), F.lit("/>"))), "")


def _points(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda p: F.concat_ws("|", F.coalesce(p["x"].cast("string"), F.lit("")), F.coalesce(p["y"].cast("string"), F.lit("")))), ";")


def _grid_attributes(g: Column) -> Column:
    margins = [_attr(f"Margin{a}", F.get(g["margins"], F.lit(k))) for k, a in enumerate("XYZ")]
    return F.concat(_attr("Width", g["width"]), _attr("Height", g["height"]), _attr("Depth", g["depth"]), _attr("Duration", g["duration"]), *margins)


def _nodes(g: Column) -> Column:
    def node(v: Column, i: Column) -> Column:
        x, y, z = i % g["width"], F.floor(i / g["width"]) % g["height"], F.floor(i / (g["width"] * g["height"])) % g["depth"]
        w = F.when(g["duration"].isNotNull(), F.floor(i / (g["width"] * g["height"] * g["depth"])))
        return F.concat(F.lit("<Node"), _attr("X", x), _attr("Y", y), _attr("Z", z), _attr("W", w), _attr("Value", v), F.lit("/>"))

    return F.array_join(F.transform(g["values"], node), "")


def as_xml(items: DataFrame) -> DataFrame:
    """(root_name, xml): the text of each row of SCHEMA; null cells are left out."""
    attributes = F.concat(*[_attr(a, _net_boolean(F.col(n)) if t == "boolean" and n != "unselect_manual" else F.coalesce(_net_boolean(F.col(n)), F.lit("null")) if t == "boolean" else F.col(n)) for n, (a, t) in ATTRIBUTES.items()])
    lists = [_element(e, F.when(F.col("tilts").isNotNull(), F.array_join(F.transform("tilts", lambda r: F.coalesce(_net_boolean(r[n]) if t == "boolean" else _escaped(r[n]), F.lit(""))), "\n"))) for n, (e, t) in TILTS.items()]
    curves = [_element(e, _points(F.col(n))) for n, e in CURVES.items()]
    by_tilt = [F.array_join(F.transform(F.coalesce(F.col(n), F.array()), lambda c, k: _element(e, _points(c), _attr("ID", k))), "") for n, e in TILT_CURVES.items()]
    options = [_element(o, _params(F.get(F.map_values(F.map_filter("options", lambda k, _: k == o)), F.lit(0)))) for o in OPTIONS]
    grids = F.array_join(F.transform(F.array_sort(F.map_keys(F.coalesce("grids", F.create_map().cast(f"map<string,{GRID}>")))), lambda k: _element(k, _nodes(F.element_at("grids", k)), _grid_attributes(F.element_at("grids", k)))), "")
    pyramids = [F.array_join(F.transform(F.coalesce(F.col(n), F.array()), lambda g: _element(e, _nodes(g), _grid_attributes(g))), "") for n, e in PYRAMIDS.items()]
    thresholds = F.array_join(F.transform(F.array_sort(F.map_entries("picking_thresholds")), lambda p: F.concat(F.lit("<Threshold"), _attr("Suffix", p["key"]), _attr("Value", p["value"]), F.lit("/>"))), "")
    inner = F.concat(*lists, *curves, *by_tilt, _element("CTF", _params(F.col("ctf"))), *options, grids, *pyramids, _element("PickingThresholds", thresholds))
    return items.select("root_name", F.concat(F.lit('<?xml version="1.0" encoding="utf-16"?>\n'), _element(F.coalesce("kind", F.lit(ITEM)), inner, attributes)).alias("xml"))


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Writes each (root_name, xml) as root_name.xml in UTF-16 and returns (root_name, bytes). A file gets its name when it is whole, so that a task may run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        for batch in batches:
            sizes = []
            for name, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = xml.encode("utf-16")
                with system.open_output_stream(f"{place}/.{name}.xml.part") as out:
                    out.write(content)
                system.move(f"{place}/.{name}.xml.part", f"{place}/{name}.xml")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["root_name", "bytes"])

    return texts.select("root_name", "xml").mapInArrow(run, "root_name string, bytes long")


def write(items: DataFrame, folder: str) -> DataFrame:
    """Writes each row of SCHEMA as a file of its own; two rows of one name are an error."""
    names = items.groupBy("root_name").agg(F.count("*").alias("_n"))
    once = F.when(F.col("_n") == 1, F.col("xml")).otherwise(F.raise_error(F.concat(F.lit("two records named "), "root_name")))
    return write_texts(as_xml(items).join(names, "root_name").select("root_name", once.alias("xml")), folder)


# --- populations -------------------------------------------------------------

_ENTRIES = "array<struct<_GUID: string, _Path: string, _Version: string, _Hash: string, _Name: string>>"


def _file(texts: DataFrame, root: str, schema: str) -> DataFrame:
    """Texts whose root element is ``root``, parsed; others are an error that names the file."""
    is_root = F.regexp_like("xml", F.lit(rf"^\s*(<\?xml[^>]*\?>)?\s*<{root}[\s/>]"))
    checked = F.when(is_root, F.col("xml")).otherwise(F.raise_error(F.concat(F.lit(f"no {root}: "), "path")))
    return texts.select("path", F.from_xml(checked, f"Param array<struct<_Name: string, _Value: string>>, {schema}", {"mode": "FAILFAST"}).alias("x"))


def _settings(df: DataFrame) -> Column:
    return _as_map(F.struct(F.col("x.Param").alias("Param")))


def _guid(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[{}]", ""))


def _versions(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast(_ENTRIES)), lambda e: F.struct(_guid(e["_GUID"]).alias("guid"), e["_Version"].alias("version")))


def read_species(spark: SparkSession, path: str, glob: str = "*.species") -> DataFrame:
    """(path, guid, name, settings, used_sources): a row for each species file; used_sources are (guid, version)."""
    rows = _file(read_texts(spark, path, glob), "Species", f"UsedDataSources struct<DataSource: {_ENTRIES}>")
    s = rows.select("path", _settings(rows).alias("settings"), _versions(F.col("x.UsedDataSources.DataSource")).alias("used_sources"))
    return s.select("path", _guid(F.try_element_at("settings", F.lit("GUID"))).alias("guid"), F.try_element_at("settings", F.lit("Name")).alias("name"), "settings", "used_sources")


def read_sources(spark: SparkSession, path: str, glob: str = "*.source") -> DataFrame:
    """(path, guid, name, settings, used_species, files): a row for each source file; files are (hash, name)."""
    rows = _file(read_texts(spark, path, glob), "DataSource", f"UsedSpecies struct<Species: {_ENTRIES}>, Files struct<File: {_ENTRIES}>")
    files = F.transform(F.coalesce(F.col("x.Files.File"), F.array().cast(_ENTRIES)), lambda e: F.struct(e["_Hash"].alias("hash"), e["_Name"].alias("name")))
    s = rows.select("path", _settings(rows).alias("settings"), _versions(F.col("x.UsedSpecies.Species")).alias("used_species"), files.alias("files"))
    return s.select("path", _guid(F.try_element_at("settings", F.lit("GUID"))).alias("guid"), F.try_element_at("settings", F.lit("Name")).alias("name"), "settings", "used_species", "files")


def read_population(spark: SparkSession, path: str, glob: str = "*.population") -> DataFrame:
    """(population, kind, guid, path): the species and sources that population files list; paths are joined to the population's folder."""
    rows = _file(read_texts(spark, path, glob), "Population", f"Species struct<Species: {_ENTRIES}>, Sources struct<Source: {_ENTRIES}>")

    def entries(kind: str, column: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast(_ENTRIES)), lambda e: F.struct(F.lit(kind).alias("kind"), _guid(e["_GUID"]).alias("guid"), F.translate(e["_Path"], "\\", "/").alias("at")))

    listed = F.concat(entries("species", "x.Species.Species"), entries("source", "x.Sources.Source"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    out = rows.select(F.col("path").alias("population"), folder.alias("folder"), F.explode(listed).alias("e"))
    joined = F.when(F.regexp_like("e.at", F.lit(r"^(/|\w+:)")), F.col("e.at")).otherwise(F.concat("folder", "e.at"))
    # steps up and no steps are taken
    for _ in range(8):
        joined = F.regexp_replace(F.regexp_replace(joined, r"(?<=/)\./", ""), r"(?<=/)(?!\.\.)[^/]+/\.\./", "")
    return out.select("population", "e.kind", "e.guid", joined.alias("path"))


def checked(listed: DataFrame, loaded: DataFrame, kind: str) -> DataFrame:
    """``loaded`` files (path, guid) that the population lists, as an assertion: an entry without its file, or whose file has another identity, fails the job and is named."""
    entries = listed.filter(F.col("kind") == kind).select("population", F.col("guid").alias("_listed"), F.regexp_replace("path", "^file:/+", "/").alias("_at"))
    found = loaded.withColumn("_at", F.regexp_replace("path", "^file:/+", "/"))
    both = entries.join(found, "_at", "left")
    wrong = F.when(F.col("path").isNull(), F.concat(F.lit(f"no file of {kind} "), "_at")).when(~F.col("guid").eqNullSafe(F.col("_listed")), F.concat(F.lit(f"stored identity of {kind} "), "_at", F.lit(" does not match: "), "_listed", F.lit(" is listed, the file has "), F.coalesce("guid", F.lit("none"))))
    return both.withColumn("guid", F.when(wrong.isNull(), F.col("guid")).otherwise(F.raise_error(wrong))).drop("_at", "_listed")


def unresolved(used: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """(path, guid, version): what files of ``used`` say they use and ``known`` does not have."""
    wants = used.select("path", F.explode(column).alias("u")).select("path", "u.guid", "u.version")
    return wants.join(known.select("guid").distinct(), "guid", "left_anti").select("path", "guid", "version")
