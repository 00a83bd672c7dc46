"""More registered queries: table and array operators, lookups, curves and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import arrays
from lumenframe.operators import aggregates, catalog, kernels, matching, quality, ranking, table
from lumenframe.plans.catalogue import _query, _t
from lumenframe.streaming import folder


@_query("SELECT s_suppkey, CAST(s_acctbal AS FLOAT) AS x, CAST(s_nationkey AS FLOAT) AS y, 'none' AS tag, CASE WHEN s_nationkey > 12 THEN 0 ELSE s_acctbal END AS s_acctbal, upper(s_name) AS s_name, s_nationkey * 10 + s_suppkey AS s_nationkey FROM supplier")
def column_operators(spark, sf_dir):
    """Typed views, new columns, rows set by a condition, and cells mapped with and without others of their row."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    s = table.add_column(s.withColumn("v", table.vector(["s_acctbal", "s_nationkey"])), "tag", "none")
    s = table.modify_column(s, "s_nationkey", lambda c: c * 10 + F.col("s_suppkey"))
    s = table.set_rows(s, "s_acctbal", F.col("v.y") > 12, 0.0)
    return table.modify_column(s, "s_name", F.upper).select("s_suppkey", "v.x", "v.y", "tag", "s_acctbal", "s_name", "s_nationkey")


@_query("SELECT CAST(p_size AS INTEGER) AS p_size FROM part")
def one_column(spark, sf_dir):
    return table.typed(table.get_column(_t(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("string")), "p_size"), p_size="int")


@_query("SELECT l_orderkey, l_linenumber, CAST(l_discount AS FLOAT) AS x1, CAST(l_tax AS FLOAT) AS x2, CAST(3 AS BIGINT) AS steps, round(l_quantity + l_discount + l_tax, 4) AS total FROM lineitem")
def wide_array_reshape(spark, sf_dir):
    """Numbered columns as an array, and back to columns."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"))
    wide = table.gather_arrays(li, {"x": "x"}, "double").select("l_orderkey", "l_linenumber", F.size("x").cast("long").alias("steps"), F.round(arrays.total(F.col("x")), 4).alias("total"), F.slice("x", 2, 2).cast("array<float>").alias("tail"))
    return table.spread_array(wide, "tail", "x", 2)


@_query("""SELECT l_orderkey * 10 + l_linenumber AS half, round((l_quantity - l_discount) * 1.5, 5) AS x, round((l_extendedprice - l_tax) * 1.5, 5) AS y, CAST(l_suppkey AS DOUBLE) AS tilt, p_type AS source_name
 FROM lineitem JOIN part ON l_partkey = p_partkey""")
def import_projection(spark, sf_dir):
    """Particle cells scaled by the pixel size, offsets taken off, half sets from 0, base names."""
    li = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cells = {"rlnCoordinateX": F.col("l_quantity"), "rlnOriginX": F.col("l_discount"), "rlnCoordinateY": F.col("l_extendedprice"), "rlnOriginY": F.col("l_tax"), "rlnAngleTilt": F.col("l_suppkey"), "rlnRandomSubset": F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1, "rlnMicrographName": F.concat(F.lit("a/b/"), "p_type")}
    out = table.import_particles(li.select(*[v.cast("string").alias(k) for k, v in cells.items()]), 1.5)
    return out.select(F.col("half").cast("long").alias("half"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "tilt", "source_name")


@_query("""SELECT round(l_quantity / 1.5, 5) AS rlnCoordinateX, round(l_discount / 1.5, 5) AS rlnCoordinateY, CAST(0 AS DOUBLE) AS rlnAngleRot, l_tax AS rlnAngleTilt, CAST(1 AS DOUBLE) AS rlnAnglePsi, l_linenumber + 1 AS rlnRandomSubset, l_returnflag AS rlnMicrographName FROM lineitem""")
def export_projection(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.lit(0.0).alias("rot"), F.col("l_tax").alias("tilt"), F.lit(1.0).alias("psi"), F.col("l_linenumber").alias("half"), F.col("l_returnflag").alias("source_name"))
    out = table.export_particles(li, 1.5)
    return out.withColumns({c: F.round(c, 5) for c in ("rlnCoordinateX", "rlnCoordinateY")})


@_query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events QUALIFY row_id % 3 <> 1")
def remove_rows(spark, sf_dir):
    numbered = table.with_row_id(_t(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"])
    return table.remove_rows(numbered, numbered.filter("row_id % 3 = 1")).select("event_id", "row_id")


@_query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events), n AS (SELECT row_id, row_number() OVER (ORDER BY row_id DESC) AS place FROM r WHERE row_id % 5 = 0) SELECT event_id, place FROM r JOIN n USING (row_id)")
def subset_rows(spark, sf_dir):
    """Rows picked by number, with the place that each has in the order they were picked in."""
    numbered = table.with_row_id(_t(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"])
    picked = numbered.filter("row_id % 5 = 0").select("row_id", F.col("row_id").alias("back"))
    places = table.with_row_id(picked, [F.desc("back")], "place").withColumn("place", F.col("place") + 1)
    return table.subset(numbered, places).select("event_id", "place")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 8 AND l_extendedprice > 8 AND l_quantity < 50 - 8 AND l_extendedprice < 50000 - 8")
def border_filter(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return quality.away_from_border(li, F.lit(50), F.lit(50000), 10.0).select("l_orderkey", "l_linenumber")


@_query("SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def reverse_lookup(spark, sf_dir):
    """By a name that must be unique among the sources."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return matching.reverse_lookup(c, _t(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey").select("c_custkey", "n_regionkey")


@_query("""WITH p AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id % 7 AS VARCHAR) END AS a, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 7 AS VARCHAR) END AS b, CAST(user_id % 5 AS VARCHAR) AS m, CAST(event_id % 5 AS VARCHAR) AS n FROM events)
 SELECT event_id, CASE WHEN coalesce(a, '') <> '' AND coalesce(b, '') <> '' THEN a = b ELSE m = n END AS same FROM p""")
def particle_identity(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    a, b = F.when(e % 3 != 0, (u % 7).cast("string")), F.when(e % 2 == 0, (e % 7).cast("string"))
    return _t(spark, sf_dir, "events").select("event_id", matching.same_particle(a, (u % 5).cast("string"), b, (e % 5).cast("string")).alias("same"))


@_query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0")
def items_with_files(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    files = s.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("/maps/"), "s_name", F.lit("_fsc.mrc")).alias("path"))
    return catalog.with_files(s, files, F.concat("s_name", F.lit("_fsc.mrc"))).select("s_suppkey")


@_query("SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def resolve_references(spark, sf_dir):
    """Entries joined to what they refer to; a reference to nothing would be an error."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return catalog.resolve(c, "c_nationkey", _t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@_query("""WITH v AS (SELECT l_suppkey, l_quantity / 4 AS r, l_discount AS a, l_tax AS b, l_extendedprice / 1e5 AS c, l_quantity / 50 AS d FROM lineitem),
 s AS (SELECT l_suppkey, CAST(floor(r) AS INTEGER) AS shell, 1 - (r - floor(r)) AS w, a, b, c, d FROM v UNION ALL SELECT l_suppkey, CAST(floor(r) AS INTEGER) + 1, r - floor(r), a, b, c, d FROM v)
 SELECT l_suppkey, shell, round(sum((a * c + b * d) * w) / greatest(1e-6, sqrt(sum((a * a + b * b) * w) * sum((c * c + d * d) * w))), 5) + 0.0 AS fsc FROM s GROUP BY 1, 2""")
def shell_correlation(spark, sf_dir):
    """Fourier shell correlation of two half maps, voxels shared by the two shells around them."""
    v = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") / 4).alias("radius"), F.col("l_discount").alias("re1"), F.col("l_tax").alias("im1"), (F.col("l_extendedprice") / 1e5).alias("re2"), (F.col("l_quantity") / 50).alias("im2"))
    return aggregates.fsc_shells(v, ["l_suppkey"]).withColumn("fsc", F.round("fsc", 5) + 0.0)


@_query("SELECT 'item' AS kind, l_orderkey AS key, round(sum(l_quantity * l_discount), 4) AS ab, round(sum(l_quantity * l_quantity), 4) AS aa, round(sum(l_discount * l_discount), 4) AS bb, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'frame', l_linenumber, round(sum(l_quantity * l_discount), 4), round(sum(l_quantity * l_quantity), 4), round(sum(l_discount * l_discount), 4), count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'cell', greatest(0, least(7, CAST(floor(l_extendedprice / 100000 * 8) AS BIGINT))), round(sum(l_quantity * l_discount), 4), round(sum(l_quantity * l_quantity), 4), round(sum(l_discount * l_discount), 4), count(*) FROM lineitem GROUP BY 2")
def correlation_sums(spark, sf_dir):
    """The same sums by item, by frame and by grid cell."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", aggregates.grid_cell(F.col("l_extendedprice"), 0.0, 1e5, 8).alias("cell"))
    parts = [aggregates.correlation_sums(li, [k], "l_quantity", "l_discount").select(F.lit(kind).alias("kind"), F.col(k).cast("long").alias("key"), *[F.round(c, 4).alias(c) for c in ("ab", "aa", "bb")], "n") for kind, k in (("item", "l_orderkey"), ("frame", "l_linenumber"), ("cell", "cell"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("SELECT CAST(i - 1 AS INTEGER) AS i, round(avg(embedding[i]::DOUBLE), 6) + 0.0 AS value, count(*) AS n FROM embeddings, range(1, 65) r(i) WHERE label % 2 = 0 GROUP BY 1")
def mean_curve(spark, sf_dir):
    items = _t(spark, sf_dir, "embeddings").filter("label % 2 = 0").select(F.col("embedding").cast("array<double>").alias("c"))
    return aggregates.mean_curve(items, "c").withColumn("value", F.round("value", 6) + 0.0)


@_query("""SELECT vec_id, CAST(len(list_filter(e, lambda x: x < -0.1)) AS BIGINT) AS below, CAST(list_transform(list_filter(range(1, 65), lambda i: e[i] > 0.1), lambda i: i - 1) AS INTEGER[])::VARCHAR AS above_at FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def take_above_below(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    at = arrays.take_above(F.col("e"), 0.1)["indices"]
    return e.select("vec_id", F.size(arrays.take_below(F.col("e"), -0.1)["values"]).cast("long").alias("below"), F.concat(F.lit("["), F.array_join(at.cast("array<string>"), ", "), F.lit("]")).alias("above_at"))


@_query("SELECT s_suppkey, CAST(t AS INTEGER) AS tilt, s_acctbal FROM supplier, range(0, 25) r(t) WHERE t < s_nationkey")
def tilt_fan_out(spark, sf_dir):
    """Each particle once for each tilt of its series."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("int").alias("n"))
    return table.tilt_fan_out(s, F.col("n")).drop("n")


@_query("""WITH c AS (SELECT vec_id, i, embedding[i]::DOUBLE AS a, embedding[65 - i]::DOUBLE AS b, CAST(greatest(8, 6 + (vec_id + i - 1) % 9) AS INTEGER) // 2 AS h FROM embeddings, range(1, 65) r(i)),
 w AS (SELECT x.vec_id, x.i, avg(y.a) AS ma, avg(y.b) AS mb, avg(y.a * y.b) AS ab, stddev_pop(y.a) AS sa, stddev_pop(y.b) AS sb FROM c x JOIN c y ON x.vec_id = y.vec_id AND y.i >= x.i - x.h AND y.i < x.i + x.h WHERE x.i > 4 AND x.i <= 60 GROUP BY 1, 2)
 SELECT vec_id, round(sum((ab - ma * mb) / (sa * sb)), 4) + 0.0 AS total, round(max((ab - ma * mb) / (sa * sb)), 4) AS best FROM w GROUP BY 1""")
def sliding_correlation(spark, sf_dir):
    """How well two curves agree about each place, in windows whose length the place decides, 8 at least; the last 4 places have none."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    e = e.withColumns({"b": F.reverse("a"), "n": F.transform(F.sequence(F.lit(0), F.size("a") - 1), lambda i: (6 + (F.col("vec_id") + i) % 9).cast("int"))})
    q = e.select("vec_id", arrays.sliding_correlation(F.col("a"), F.col("b"), F.col("n"), 4, 8).alias("q")).select("vec_id", F.filter("q", lambda x: ~F.isnan(x)).alias("q"))
    return q.select("vec_id", (F.round(arrays.total(F.col("q")), 4) + 0.0).alias("total"), F.round(F.array_max("q"), 4).alias("best"))


@_query("""WITH c AS (SELECT vec_id, list_reverse_sort(embedding::DOUBLE[]) AS e FROM embeddings), k AS (SELECT vec_id, e, CAST(len(list_filter(e, lambda x: x > 0.05)) AS BIGINT) AS k FROM c)
 SELECT vec_id, round(CASE WHEN k = len(e) THEN len(e) - 1 WHEN k = 0 THEN 0 ELSE (k - 1) + (e[k] - 0.05) / (e[k] - e[k + 1]) END, 5) AS crossing FROM k""")
def first_below(spark, sf_dir):
    """Where a falling curve crosses a threshold, between two places."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.sort_array(F.col("embedding").cast("array<double>"), asc=False).alias("e"))
    return e.select("vec_id", F.round(arrays.first_below(F.col("e"), 0.05), 5).alias("crossing"))


@_query()
def resample_curves(spark, sf_dir):
    """Monotone cubics through each line of an order, at twice as many points."""
    nodes = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    points = nodes.select("l_orderkey", F.explode(F.array(F.col("x"), F.col("x") + 0.5)).alias("x"))
    return kernels.resample_curves(nodes, points, key="l_orderkey")


@_query("SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey")
def sort_by_key(spark, sf_dir):
    return ranking.sort_by_key(_t(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@_query("SELECT l_orderkey, CAST(list(l_linenumber ORDER BY l_extendedprice, l_linenumber) AS VARCHAR) AS places FROM lineitem GROUP BY 1")
def sorted_indices(spark, sf_dir):
    places = ranking.sorted_indices("l_extendedprice", "l_linenumber").cast("array<string>")
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(places, ", "), F.lit("]")).alias("places"))


@_query()
def random_subset(spark, sf_dir):
    """A sampling operator: the same 100 rows for the same seed wherever they lie."""
    return ranking.random_subset(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100)


@_query("SELECT date_trunc('hour', ts) AS start, user_id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_sums(spark, sf_dir):
    """The tumbling windows of the stream operator over the whole table at once."""
    return folder.windowed(_t(spark, sf_dir, "events"), time="ts", key="user_id", value="value").withColumn("total", F.round("total", 4))


@_query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def running_counts(spark, sf_dir):
    return folder.running_counts(_t(spark, sf_dir, "orders"), "o_orderstatus")


@_query("SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 <> 0")
def stale_results(spark, sf_dir):
    """Items without a result of their present options."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    done = folder.stamped(s.withColumn("s_acctbal", F.when(F.col("s_nationkey") % 3 == 0, F.col("s_acctbal")).otherwise(F.col("s_acctbal") + 1)), ["s_nationkey", "s_acctbal"])
    return folder.stale(s, done, "s_suppkey", ["s_nationkey", "s_acctbal"]).select("s_suppkey")
