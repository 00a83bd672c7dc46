"""Registered queries through files and tiles: what is written as maps or records and read back, and components of images."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import directions
from lumenframe.operators import components, curves, defects, fits, table
from lumenframe.plans.catalogue import _query, _t
from lumenframe.plans.shared import scratch
from lumenframe.sources import item_xml, maps


@_query("""WITH e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z, embedding FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64)
 SELECT 'label' || label AS name, CAST(z AS INTEGER) AS z, CAST(count(*) OVER (PARTITION BY label) AS INTEGER) AS depth, round(list_sum(embedding::DOUBLE[]), 3) + 0.0 AS total FROM e QUALIFY z IN (0, 3, 17)""")
def map_layers(spark, sf_dir):
    """Vectors as layers of a stack for each label, written as files, of which three layers are read by range."""
    e = _t(spark, sf_dir, "embeddings").filter("label is not null and size(embedding) = 64")
    # layers are numbered by ranges, so that no task sorts all of a label
    e = table.with_row_id(e.select("label", "vec_id", "embedding"), ["label", "vec_id"], "place")
    first = e.groupBy("label").agg(F.min("place").alias("first"))
    layers = e.join(first, "label").select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1.5).cast("float").alias("pixel_size"), (F.col("place") - F.col("first")).cast("int").alias("z"), F.col("embedding").alias("data"))
    folder = scratch(spark)
    maps.write(layers, folder, ext="mrcs").count()
    rows = maps.read(spark, folder, glob="*.mrcs", layers=[0, 3, 17])
    total = F.aggregate("data", F.lit(0.0).cast("double"), lambda s, x: s + x)
    return rows.select(F.regexp_extract("path", r"([^/]*)\.mrcs$", 1).alias("name"), "z", "depth", (F.round(total, 3) + 0.0).alias("total"))


@_query("""SELECT 'label' || label AS name, round(sum(list_sum(embedding::DOUBLE[])), 2) + 0.0 AS mass, round(max(list_max(embedding))::DOUBLE, 5) AS top FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64 GROUP BY label""")
def map_reductions(spark, sf_dir):
    """Each label's vectors as an image, reduced along its layers and to its mass, partial results by blocks."""
    e = _t(spark, sf_dir, "embeddings").filter("label is not null and size(embedding) = 64")
    layers = e.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("path"), F.lit(0).alias("z"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").alias("data"))
    top = maps.reduce_slices(layers, "max").select("path", F.round(F.array_max("data"), 5).alias("top"))
    return maps.centre_of_mass(layers).join(top, "path").select(F.col("path").alias("name"), (F.round("mass", 2) + 0.0).alias("mass"), "top")


@_query("""SELECT 's' || s_suppkey AS root_name, round(s_acctbal, 2) AS resolution, CASE s_nationkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'open' END AS manual, s_name AS supplier, CAST(2 * (1 + s_nationkey % 4) AS INTEGER) AS nodes,
 CAST(list_sum(list_transform(range(2 * (1 + s_nationkey % 4)), lambda i: i * (s_suppkey % 7))) AS DOUBLE) AS total, CAST(s_nationkey % 3 AS INTEGER) AS tilts FROM supplier""")
def item_records(spark, sf_dir):
    """Items and series as XML files, one each, and read back by schema: attributes, parameters, grids and tilts."""
    s = _t(spark, sf_dir, "supplier")
    width = (2 * (1 + F.col("s_nationkey") % 4)).cast("int")
    values = F.transform(F.sequence(F.lit(0), width - 1), lambda i: (i * (F.col("s_suppkey") % 7)).cast("float"))
    grid = F.struct((width / 2).cast("int").alias("width"), F.lit(2).alias("height"), F.lit(1).alias("depth"), F.lit(None).cast("int").alias("duration"), F.array(*[F.lit(0.0).cast("float")] * 3).alias("margins"), values.alias("values"))
    tilt = F.struct(F.lit(1.5).cast("float").alias("angle"), *[F.lit(0.0).cast("float").alias(c) for c in ("dose",)], F.lit(True).alias("use"), *[F.lit(0.0).cast("float").alias(c) for c in ("axis", "offset_x", "offset_y")], F.col("s_name").alias("movie"))
    n = (F.col("s_nationkey") % 3).cast("int")
    given = {
        "root_name": F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "kind": F.when(n > 0, "TiltSeries").otherwise("Movie"), "resolution": F.col("s_acctbal").cast("decimal(20,6)"), "unselect_manual": F.when(n == 0, True).when(n == 1, False),
        "ctf": F.create_map(F.lit("Supplier"), F.col("s_name")), "grids": F.create_map(F.lit("GridCTF"), grid), "tilts": F.when(n > 0, F.array_repeat(tilt, n)),
    }
    none = spark.createDataFrame([], item_xml.SCHEMA)
    items = none.unionByName(s.select(*[v.alias(k) for k, v in given.items()]), allowMissingColumns=True)
    folder = scratch(spark)
    item_xml.write(items, folder).count()
    back = item_xml.read(spark, folder)
    g = F.element_at("grids", F.lit("GridCTF"))
    return back.select("root_name", F.col("resolution").cast("double").alias("resolution"), F.when(F.col("unselect_manual"), "yes").when(~F.col("unselect_manual"), "no").otherwise("open").alias("manual"), F.element_at("ctf", F.lit("Supplier")).alias("supplier"), (g["width"] * g["height"]).alias("nodes"), F.aggregate(g["values"], F.lit(0.0).cast("double"), lambda a, x: a + x).alias("total"), F.coalesce(F.size("tilts"), F.lit(0)).alias("tilts"))


@_query("""WITH RECURSIVE p AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS x, CAST(p_partkey // 50 AS BIGINT) AS y FROM part WHERE p_size % 3 = 0),
 r AS (SELECT x, y, x AS fx, y AS fy FROM p UNION SELECT q.x, q.y, r.fx, r.fy FROM r, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) AS d(dx, dy), p q WHERE q.x = r.x + dx AND q.y = r.y + dy),
 f AS (SELECT x, y, min(fy * 50 + fx) AS first FROM r GROUP BY 1, 2),
 c AS (SELECT first, count(*) AS n, min(x) AS low_x, max(x) AS high_x, min(y) AS low_y, max(y) AS high_y, avg(x) AS mx FROM f GROUP BY 1)
 SELECT row_number() OVER (ORDER BY first) - 1 AS component, first % 50 AS first_x, first // 50 AS first_y, n, low_x, high_x, low_y, high_y, round(mx, 6) AS x FROM c""")
def image_components(spark, sf_dir):
    """Components of an image of parts, fifty a row, from tiles of 16 pixels: boxes, sizes and mean places."""
    p = _t(spark, sf_dir, "part").filter("p_size % 3 = 0")
    pixels = p.select(F.lit("parts").alias("path"), (F.col("p_partkey") % 50).cast("int").alias("x"), F.expr("CAST(p_partkey div 50 AS INT)").alias("y"), F.lit(1.0).alias("value"))
    found = components.components(components.tiles_from_pixels(pixels, 16))
    return found.select("component", "first_x", "first_y", "n", "low_x", "high_x", "low_y", "high_y", F.round("x", 6).alias("x"))


@_query("""WITH a AS (SELECT CAST(CAST(l_extendedprice * 100 AS BIGINT) % 72000 AS DOUBLE) / 100 - 360 AS r0, l_quantity * 3.6 + l_discount AS t0 FROM lineitem),
 b AS (SELECT CASE WHEN r0 < 0 THEN r0 + 360 ELSE r0 END AS r, t0 FROM a), c AS (SELECT CASE WHEN t0 > 90 THEN r + 180 ELSE r END AS r, CASE WHEN t0 > 90 THEN 180 - t0 ELSE t0 END AS t FROM b),
 d AS (SELECT greatest(0, least(2880, round_even((CASE WHEN r > 360 THEN r - 360 ELSE r END) * 8, 0))) AS r, greatest(0, least(720, round_even(t * 8, 0))) AS t FROM c),
 cells AS (SELECT r, t, count(*) AS n, radians(r / 8) AS ra, radians(t / 8) AS ta FROM d GROUP BY r, t),
 rings AS (SELECT i, CASE WHEN i < 4 THEN i ELSE 4 END AS q, CASE WHEN i < 4 THEN 1 - i * i / 48.0 ELSE 4 / 3.0 - i / 6.0 END AS z, CASE WHEN i < 4 THEN 0.5 ELSE 0.5 + (i % 2) * 0.5 END AS s FROM range(1, 9) g(i)),
 bins AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS bin, (j - s) * 90 / q AS rot, degrees(acos(z)) AS tilt FROM (SELECT i, q, z, s, unnest(range(1, 4 * q + 1)) AS j FROM rings)),
 near AS (SELECT c.n, arg_min(b.bin, (round((sin(ta) * cos(ra) - sin(radians(tilt)) * cos(radians(rot))) ** 2 + (sin(ta) * sin(ra) - sin(radians(tilt)) * sin(radians(rot))) ** 2 + (cos(ta) - cos(radians(tilt))) ** 2, 9), b.bin)) AS bin FROM cells c, bins b GROUP BY c.r, c.t, c.n)
 SELECT CAST(near.bin AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n FROM near GROUP BY 1""")
def angular_distribution(spark, sf_dir):
    """Directions of all picks by the nearest of equal-area pixels of the upper half."""
    li = _t(spark, sf_dir, "lineitem")
    rot = (F.round(F.col("l_extendedprice") * 100).cast("long") % 72000).cast("double") / 100 - 360
    bins = directions.centres(2, nested=False, limit_tilt=90 + 1e-9)
    return directions.angular_bins(li.select(rot.alias("rot"), (F.col("l_quantity") * 3.6 + F.col("l_discount")).alias("tilt")), "rot", "tilt", bins).select("bin", "n")


@_query("""WITH r AS (SELECT n_nationkey * 37 % 180 AS x, n_nationkey * 53 % 900 AS y, 5 + n_regionkey * 3 AS w, 10 + n_nationkey * 7 AS h FROM nation)
 SELECT l_orderkey * 10 + l_linenumber AS id, EXISTS (SELECT 1 FROM r WHERE l_partkey % 200 >= x AND l_partkey % 200 < x + w AND l_orderkey % 1000 >= y AND l_orderkey % 1000 < y + h) AS defect FROM lineitem""")
def defective_picks(spark, sf_dir):
    """Picks that lie in one of the detector's defect rectangles."""
    n = _t(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    r = n.select((key * 37 % 180).alias("x"), (key * 53 % 900).alias("y"), (5 + F.col("n_regionkey") * 3).alias("width"), (10 + key * 7).alias("height"))
    li = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 200).alias("x"), (F.col("l_orderkey") % 1000).alias("y"))
    return defects.mark_defects(li, r).select("id", "defect")


@_query("""SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) + 0.0 AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS quality FROM lineitem GROUP BY 1 HAVING var_pop(l_quantity) > 0.01""")
def line_fits(spark, sf_dir):
    """A line through the picks of each source."""
    f = fits.fit_lines(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], x="l_quantity", y="l_extendedprice").filter("slope <> 0 or intercept <> 0")
    return f.select("l_suppkey", (F.round("slope", 4) + 0.0).alias("slope"), (F.round("intercept", 2) + 0.0).alias("intercept"), F.round("quality", 6).alias("quality"))


@_query("""WITH s AS (SELECT l_suppkey AS k, covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_discount, l_discount) AS yy, covar_pop(l_quantity, l_extendedprice) AS xz, covar_pop(l_discount, l_extendedprice) AS yz, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz FROM lineitem GROUP BY 1),
 p AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM s WHERE xx * yy - xy * xy > 1e-9 * xx * yy)
 SELECT k AS l_suppkey, round(a, 3) + 0.0 AS a, round(b, 1) + 0.0 AS b, round(mz - a * mx - b * my, 1) + 0.0 AS c FROM p""")
def plane_fits(spark, sf_dir):
    """A plane through the picks of each source."""
    f = fits.fit_planes(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], x="l_quantity", y="l_discount", z="l_extendedprice").filter("a is not null")
    return f.select("l_suppkey", (F.round("a", 3) + 0.0).alias("a"), (F.round("b", 1) + 0.0).alias("b"), (F.round("c", 1) + 0.0).alias("c"))


@_query("""SELECT l_suppkey, round(4 * regr_slope(ln(l_extendedprice), 1.0 / ((l_quantity / 4 + 2) * (l_quantity / 4 + 2))), 3) + 0.0 AS b_factor FROM lineitem WHERE l_quantity / 4 + 2 BETWEEN 3 AND 10 AND l_extendedprice > 0 GROUP BY 1 HAVING var_pop(l_quantity) > 0.01""")
def b_factors(spark, sf_dir):
    """Fall-off of amplitudes with resolution for each source, by sums."""
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") / 4 + 2).alias("resolution"), F.col("l_extendedprice").alias("amplitude"))
    return curves.b_factors(li, ["l_suppkey"]).filter("b_factor <> 0").select("l_suppkey", (F.round("b_factor", 3) + 0.0).alias("b_factor"))
