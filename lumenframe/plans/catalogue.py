"""The registered queries over the driver's tables, each with its SQL where SQL can say it.

orders stand for items, lineitem for picks of an item, events for series of measurements, embeddings for vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import arrays, geometry, hashing, maths, physics, text
from lumenframe.operators import aggregates, matching, ordered, quality, ranking, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") != "P"
    angle = F.radians((F.col("o_orderkey") % 180).cast("double"))
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.when(done, F.col("o_totalprice") / 1e5).alias("defocus"),
        F.when(done, F.cos(angle)).alias("astigmatism_x"),
        F.when(done, F.sin(angle)).alias("astigmatism_y"),
        F.when(done, (F.col("o_orderkey") % 80) / F.lit(10.0)).alias("resolution"),
        F.when(F.col("o_orderstatus") == "F", (F.col("o_custkey") % 70) / F.lit(10.0)).alias("motion"),
        F.when(F.col("o_orderstatus") == "O", (F.col("o_custkey") % 5).cast("int")).alias("particles"),
        (F.col("o_orderkey") % 12).cast("double").alias("mask"),
    )


_ITEMS = """items AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1e5 END AS defocus,
    CASE WHEN o_orderstatus <> 'P' THEN cos(radians(o_orderkey % 180)) END AS ax, CASE WHEN o_orderstatus <> 'P' THEN sin(radians(o_orderkey % 180)) END AS ay,
    CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 80) / 10.0 END AS resolution, CASE WHEN o_orderstatus = 'F' THEN (o_custkey % 70) / 10.0 END AS motion,
    CASE WHEN o_orderstatus = 'O' THEN o_custkey % 5 END AS particles, o_orderkey % 12 AS mask FROM orders),
 st AS (SELECT avg(ax) AS mx, avg(ay) AS my, greatest(1e-4, sqrt(avg(ax * ax + ay * ay) - avg(ax) * avg(ax) - avg(ay) * avg(ay))) AS sd FROM items WHERE defocus IS NOT NULL),
 qc AS (SELECT items.*, (defocus IS NULL OR defocus BETWEEN 0 AND 5) AND (ax IS NULL OR sqrt((ax - mx) * (ax - mx) + (ay - my) * (ay - my)) / sd <= 3)
    AND (resolution IS NULL OR resolution <= 5) AND (motion IS NULL OR motion <= 5) AND (particles IS NULL OR particles >= 1) AND mask <= 10 AS accepted FROM items, st)"""


@_query(f"WITH {_ITEMS} SELECT item_id, accepted FROM qc")
def qc_filter_items(spark, sf_dir):
    """Range filter with clauses that count only where their stage has results."""
    return quality.range_filter(_items(spark, sf_dir), quality.Ranges()).select("item_id", "accepted")


@_query("SELECT round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(greatest(1e-4, sqrt(avg(x * x + y * y) - avg(x) * avg(x) - avg(y) * avg(y))), 6) AS std FROM (SELECT cos(radians(o_orderkey % 180)) AS x, sin(radians(o_orderkey % 180)) AS y FROM orders WHERE o_orderstatus <> 'P')")
def astigmatism_statistics(spark, sf_dir):
    s = quality.astigmatism_statistics(_items(spark, sf_dir).filter("defocus is not null"), "astigmatism_x", "astigmatism_y")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def _status(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    stored = {"ctf": F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 3), "movement": F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 2)}
    wanted = {"ctf": (F.lit(True), F.lit(1).cast("long")), "movement": (F.col("o_orderkey") % 2 == 0, F.lit(1).cast("long"))}
    manual = F.when(F.col("o_orderkey") % 11 == 0, True).when(F.col("o_orderkey") % 13 == 0, False)
    return o.select(F.col("o_orderkey").alias("item_id"), quality.status(manual, F.col("o_totalprice") > 200000, stored, wanted, F.col("o_orderpriority").startswith("1")).alias("status"))


_STATUS = """s AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 11 = 0 THEN 'LeaveOut' WHEN o_orderstatus = 'P' THEN 'Unprocessed'
    WHEN o_custkey % 3 IS DISTINCT FROM 1 OR (o_orderkey % 2 = 0 AND (CASE WHEN o_orderstatus = 'F' THEN o_custkey % 2 END) IS DISTINCT FROM 1 AND NOT starts_with(o_orderpriority, '1')) THEN 'Outdated'
    WHEN o_totalprice > 200000 AND o_orderkey % 13 <> 0 THEN 'FilteredOut' ELSE 'Processed' END AS status FROM orders)"""


@_query(f"WITH {_STATUS} SELECT * FROM s")
def status_classify(spark, sf_dir):
    return _status(spark, sf_dir)


@_query(f"WITH {_STATUS} SELECT status, count(*) AS n FROM s GROUP BY status")
def status_counts(spark, sf_dir):
    return _status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@_query("SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) AS possible FROM orders GROUP BY 1")
def conditional_counts(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*aggregates.conditional_counts(done=F.col("o_orderstatus") == "F", possible=F.col("o_orderstatus") != "P"))


_VALID = "o_orderstatus <> 'P' AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 NOT IN (0, 1)) AND o_orderkey % 5 <> 0"


def _valid(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumns({"options_ctf": F.when(F.col("o_orderstatus") != "P", 1), "unselect_filter": F.col("o_orderkey") % 3 == 0, "unselect_manual": F.when(F.col("o_orderkey") % 5 == 0, True).when(F.col("o_orderkey") % 5 == 1, False)})
    return quality.valid_items(o)


@_query(f"SELECT o_orderkey FROM orders WHERE {_VALID}")
def valid_items(spark, sf_dir):
    return _valid(spark, sf_dir).select("o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-') AND o_orderstatus IN ('F', 'O')")
def name_and_status_filter(spark, sf_dir):
    return quality.name_filter(_t(spark, sf_dir, "orders"), "^[12]-", ["F", "O"], name="o_orderpriority", state="o_orderstatus").select("o_orderkey")


@_query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[Ll]icense')")
def regex_documents(spark, sf_dir):
    return quality.name_filter(_t(spark, sf_dir, "documents"), "[Ll]icense", name="text").select("doc_id")


@_query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def particles_join_items(spark, sf_dir):
    """Spark decides from the items' size whether they are broadcast."""
    return _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_totalprice")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def items_with_particles(spark, sf_dir):
    return _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem").filter("l_quantity > 45"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@_query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {_VALID})")
def particles_without_items(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").join(_valid(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


_NAMES = "(SELECT DISTINCT p_brand AS word FROM part UNION SELECT DISTINCT p_type FROM part)"


@_query(f"SELECT p_partkey, word FROM (SELECT p_partkey, p_type || ' ' || p_brand AS label FROM part) JOIN {_NAMES} ON contains(label, word)")
def contains_join(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    words = p.select(F.col("p_brand").alias("word")).union(p.select("p_type")).distinct()
    return matching.contains_join(p.select("p_partkey", F.concat_ws(" ", "p_type", "p_brand").alias("label")), words, "label", "word").select("p_partkey", "word")


@_query(f"SELECT p_partkey, min(word) AS word FROM (SELECT p_partkey, p_name AS label FROM part) JOIN (SELECT DISTINCT p_name AS word FROM part) ON contains(label, word) GROUP BY 1 HAVING count(DISTINCT word) = 1")
def contains_unique(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    pairs = matching.contains_join(p.select("p_partkey", "p_name"), p.select(F.col("p_name").alias("word")).distinct(), "p_name", "word")
    return matching.unique_match(pairs, "p_partkey", "word")


@_query("SELECT n_name, n, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM (SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name)")
def ambiguous_names(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    sources = _t(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return matching.ambiguity(n, sources, "n_name")


@_query("SELECT l_suppkey AS suppkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def unmatched_weight(spark, sf_dir):
    return matching.unmatched_weight(_t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("suppkey")), _t(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("suppkey")), "suppkey")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 4 = 0 OR l_quantity >= s_suppkey % 50")
def score_threshold(spark, sf_dir):
    """Thresholds in a map of suffixes; items without one let all through."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 4 != 0, F.create_map(F.lit("boxnet"), (F.col("s_suppkey") % 50).cast("double"))).alias("picking_thresholds"))
    return quality.score_threshold(_t(spark, sf_dir, "lineitem"), s, "boxnet", key="l_suppkey", score="l_quantity").select("l_orderkey", "l_linenumber")


@_query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS rlnCoordinateX, '300.0' AS rlnVoltage, '2.7' AS rlnSphericalAberration, '10000.0' AS rlnMagnification, '1.25000' AS rlnDetectorPixelSize, 'None' AS rlnImageName FROM lineitem")
def default_fill_projection(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("rlnCoordinateX"))
    return table.fill_defaults(df, 1.25).select("l_orderkey", "l_linenumber", "rlnCoordinateX", "rlnVoltage", "rlnSphericalAberration", "rlnMagnification", "rlnDetectorPixelSize", "rlnImageName")


@_query("SELECT s_suppkey, g AS \"group\", printf('%07d@%s', g * (SELECT count(*) FROM supplier) + row_number() OVER (PARTITION BY g ORDER BY s_suppkey), s_name) AS image FROM supplier, range(3) r(g)")
def group_fan_out(spark, sf_dir):
    return table.fan_out(_t(spark, sf_dir, "supplier"), 3, F.col("s_name"), ["s_suppkey"]).select("s_suppkey", F.col("group").cast("long").alias("group"), "image")


@_query("SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier")
def common_column_union(spark, sf_dir):
    c, s = (_t(spark, sf_dir, n).select(*[F.col(x).alias(x[2:]) for x in cols]) for n, cols in (("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), ("supplier", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))))
    return table.common_union(c, s)


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, 0.0 FROM orders WHERE o_orderstatus = 'P'")
def upsert_rebuild(spark, sf_dir):
    new = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return table.upsert(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), new, "l_orderkey")


@_query("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id, event_id FROM events")
def row_numbers(spark, sf_dir):
    return table.with_row_id(_t(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("row_id", "event_id")


@_query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM events")
def running_dose(spark, sf_dir):
    return ordered.running_dose(_t(spark, sf_dir, "events"), key="user_id", order=["ts", "event_id"], dose="value").select("event_id", F.round("running", 4).alias("running"))


@_query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 0.5) * 1.5 AS running FROM events")
def running_dose_default(spark, sf_dir):
    return ordered.running_dose(_t(spark, sf_dir, "events"), key="user_id", order=["ts", "event_id"], dose="value", default=1.5).select("event_id", "running")


@_query("""WITH r AS (SELECT *, round(value) AS a, CAST(event_id % 7 AS BIGINT) AS d FROM events), h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) <= count(*) OVER (PARTITION BY user_id) // 2 AS low FROM r),
 s AS (SELECT *, sign(sum(CASE WHEN low THEN d ELSE 0 END) OVER (PARTITION BY user_id) - sum(CASE WHEN low THEN 0 ELSE d END) OVER (PARTITION BY user_id)) AS g FROM h)
 SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY a, -g * d, event_id) AS place FROM s""")
def half_split_order(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("a", F.round("value")).withColumn("d", F.col("event_id") % 7)
    return ordered.half_split_order(e, key="user_id", angle="a", dose="d", tie="event_id").select("event_id", F.col("place").cast("long").alias("place"))


@_query("SELECT event_id, list_sort(l)[len(l) // 2 + 1] AS median FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM events)")
def moving_median(spark, sf_dir):
    return ordered.moving_median(_t(spark, sf_dir, "events"), key="user_id", order=["ts", "event_id"], value="value", width=5).select("event_id", "median")


@_query("SELECT * FROM (SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value AS difference FROM events) WHERE difference IS NOT NULL")
def first_difference(spark, sf_dir):
    return ordered.first_difference(_t(spark, sf_dir, "events"), key="user_id", order=["ts", "event_id"], value="value").select("event_id", "difference")


@_query("SELECT event_id, CASE WHEN b > 0 AND a < 0 THEN 'peak' ELSE 'trough' END AS kind FROM (SELECT event_id, sign(value - lag(value) OVER w) AS b, sign(lead(value) OVER w - value) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE (b > 0 AND a < 0) OR (b < 0 AND a > 0)")
def sign_change_peaks(spark, sf_dir):
    return ordered.turning_points(_t(spark, sf_dir, "events"), key="user_id", order=["ts", "event_id"], value="value").select("event_id", "kind")


@_query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS average FROM events")
def last_n_average(spark, sf_dir):
    return ordered.last_average(_t(spark, sf_dir, "events"), key="user_id", order=["ts", "event_id"], value="value", n=5).select("event_id", F.round("average", 6).alias("average"))


@_query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def last_n_rows(spark, sf_dir):
    return ordered.last_rows(_t(spark, sf_dir, "events").select("event_id", "ts"), order=["ts", "event_id"], n=100)


@_query("SELECT user_id, round(avg(value), 6) AS mean_early FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k <= greatest(1, n // 3) GROUP BY user_id")
def early_mean(spark, sf_dir):
    return ordered.early_mean(_t(spark, sf_dir, "events"), key="user_id", order="event_id", value="value").select("user_id", F.round("mean_early", 6).alias("mean_early"))


@_query("SELECT value FROM (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem) WHERE k = CAST(floor(n * 0.997) AS BIGINT)")
def percentile_index(spark, sf_dir):
    return ordered.percentile_by_index(_t(spark, sf_dir, "lineitem"), value="l_extendedprice", fraction=0.997)


@_query("SELECT l_partkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def upper_median(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(aggregates.upper_median("l_extendedprice").alias("median"))


@_query("SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def column_statistics(spark, sf_dir):
    s = aggregates.statistics("l_quantity")
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[(F.round(v, 6) if k in ("mean", "std") else v).alias(k) for k, v in s.items()])


@_query("SELECT l_suppkey, round(avg(l_discount) FILTER (l_discount <> 0), 6) AS mean, round(stddev_pop(l_discount) FILTER (l_discount <> 0), 6) AS std FROM lineitem GROUP BY 1")
def mean_std_nonzero(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[F.round(v, 6).alias(k) for k, v in aggregates.non_zero("l_discount").items()])


@_query("SELECT l_partkey, round(CASE WHEN abs(sum(l_quantity)) > 1e-6 THEN sum(l_discount * l_quantity) / sum(l_quantity) ELSE 0 END, 6) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(aggregates.weighted_mean("l_discount", "l_quantity"), 6).alias("mean"))


@_query("SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs(value - m) <= 1.5 * s")
def within_n_std(spark, sf_dir):
    return aggregates.within_std(_t(spark, sf_dir, "events").select("event_id", "value"), "value", 1.5).select("event_id")


@_query("SELECT event_id FROM events, (SELECT list_sort(list(value))[count(*) // 2 + 1] AS m, stddev_pop(value) AS s FROM events) WHERE abs(value - m) <= 1.5 * s")
def within_n_std_from_median(spark, sf_dir):
    return aggregates.within_std(_t(spark, sf_dir, "events").select("event_id", "value"), "value", 1.5, around_median=True).select("event_id")


@_query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber LIMIT 50")
def take_n_highest(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return ranking.take_highest(df, "l_extendedprice", "k", 50).drop("k")


@_query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 50")
def take_n_lowest(spark, sf_dir):
    return ranking.take_lowest(_t(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", 50)


@_query("SELECT event_id, value FROM events ORDER BY (value - 50) * (value - 50), event_id LIMIT 50")
def take_nearest(spark, sf_dir):
    return ranking.take_nearest(_t(spark, sf_dir, "events").select("event_id", "value"), "value", 50.0, "event_id", 50)


@_query("""WITH t AS (SELECT user_id, avg(CASE WHEN value <> 0 THEN value END) + 1.0 * stddev_pop(CASE WHEN value <> 0 THEN value END) AS top FROM events GROUP BY 1),
 s AS (SELECT e.*, greatest(0, ceil((top - value) / 2.0)) AS step FROM events e JOIN t USING (user_id) WHERE value >= 0.5), l AS (SELECT user_id, step, sum(count(*)) OVER (PARTITION BY user_id ORDER BY step) AS n FROM s GROUP BY 1, 2),
 m AS (SELECT user_id, coalesce(min(CASE WHEN n >= 5 THEN step END), max(step)) AS lim FROM l GROUP BY 1)
 SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM s JOIN m USING (user_id) WHERE step <= lim) WHERE k <= 5""")
def adaptive_peaks(spark, sf_dir):
    return ranking.adaptive_peaks(_t(spark, sf_dir, "events"), key="user_id", score="value", tie="event_id", n=5, step=2.0, sigmas=1.0).select("event_id")


@_query("SELECT CAST(trunc((l_extendedprice - lo) / (hi - lo) * 49 + 0.5) AS INTEGER) AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
def histogram_1d(spark, sf_dir):
    return aggregates.histogram(_t(spark, sf_dir, "lineitem"), "l_extendedprice", 50)


@_query("SELECT CAST(trunc((l_extendedprice - a) / (b - a) * 9 + 0.5) AS INTEGER) AS x_bin, CAST(trunc((l_quantity - c) / (d - c) * 7 + 0.5) AS INTEGER) AS y_bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_quantity) AS c, max(l_quantity) AS d FROM lineitem) GROUP BY 1, 2")
def histogram_2d(spark, sf_dir):
    return aggregates.histogram_2d(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", (10, 8))


@_query("SELECT CAST(round_even(value / top * 19, 0) AS INTEGER) AS bin, count(*) AS n FROM events, (SELECT greatest(1.0, max(value)) AS top FROM events) GROUP BY 1")
def distance_histogram(spark, sf_dir):
    return aggregates.distance_histogram(_t(spark, sf_dir, "events"), "value", 20)


@_query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
def distinct_counts(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))


@_query()
def content_hash(spark, sf_dir):
    """Hash of each order's part keys in line order; of UTF-16 bytes, which DuckDB's hash does not take."""
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(aggregates.content_hash(F.col("l_partkey").cast("string"), ["l_linenumber"]).alias("hash"))


@_query("SELECT label, CAST(i - 1 AS INTEGER) AS i, round(sum(embedding[i]::DOUBLE), 4) AS value FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2")
def partial_final_merge(spark, sf_dir):
    df = aggregates.merge_arrays(_t(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), ["label"], "v")
    return df.select("label", "i", F.round("value", 4).alias("value"))


@_query("""SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm, round(list_avg(e), 6) AS mean, list_sort(e)[33] AS median, round(e[2] - e[1], 6) AS step, len(list_filter(e, lambda x: x > 0)) AS positive
 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def array_ops(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.round(arrays.norm(F.col("e")), 6).alias("norm"), F.round(arrays.mean(F.col("e")), 6).alias("mean"), arrays.upper_median(F.col("e")).alias("median"), F.round(F.get(arrays.first_difference(F.col("e")), F.lit(0)), 6).alias("step"), F.size(arrays.indices_of(F.col("e"), lambda x: x > 0)).cast("long").alias("positive"))


@_query("""WITH p AS (SELECT l_partkey AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT k, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM p GROUP BY 1)
 SELECT k AS l_partkey, round(avg(CASE WHEN sx > 0 AND sy > 0 THEN (x - mx) / sx * (y - my) / sy ELSE 0 END), 6) AS correlation FROM p JOIN s USING (k) GROUP BY 1""")
def normalized_cross_correlation(spark, sf_dir):
    """Both arrays of a part from one list of pairs, so that they keep one order."""
    a = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_list(F.struct("l_quantity", "l_extendedprice")).alias("p"))
    x, y = F.transform("p", lambda q: q["l_quantity"]), F.transform("p", lambda q: q["l_extendedprice"])
    return a.withColumns({"x": x, "y": y}).select("l_partkey", F.round(arrays.cross_correlation(F.col("x"), F.col("y")), 6).alias("correlation"))


_CENTRES = [[0.5 * ((i >> (k % 4)) & 1) - 0.25 for k in range(64)] for i in range(10)]


@_query("WITH c AS (SELECT i, list_transform(range(64), lambda k: 0.5 * ((i >> (k % 4)) & 1) - 0.25) AS v FROM range(10) r(i)), d AS (SELECT vec_id, i, list_sum(list_transform(range(1, 65), lambda k: (embedding[k]::DOUBLE - v[k]) * (embedding[k]::DOUBLE - v[k]))) AS d FROM embeddings, c) SELECT vec_id, CAST(arg_min(i, (d, i)) AS INTEGER) AS bin FROM d GROUP BY 1")
def nearest_bin(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return matching.nearest_bin(e, "v", _CENTRES).select("vec_id", "bin")


def _points(spark, sf_dir):
    at = [F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate("xyz")]
    # an image holds 64 points: what is matched or clustered at once stays small whatever the table
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr("vec_id div 64").alias("image"), *at)


@_query()
def greedy_match(spark, sf_dir):
    p = _points(spark, sf_dir)
    return matching.match_particles(p.filter("vec_id % 2 = 0"), p.filter("vec_id % 2 = 1"), key="image", id_col="vec_id", axes="xyz")


@_query()
def optimal_match(spark, sf_dir):
    p = _points(spark, sf_dir)
    return matching.match_particles(p.filter("vec_id % 2 = 0"), p.filter("vec_id % 2 = 1"), key="image", id_col="vec_id", axes="xyz", how="optimal")


@_query()
def approx_set_ops(spark, sf_dir):
    p = _points(spark, sf_dir)
    a, b = p.filter("vec_id % 2 = 0"), p.filter("vec_id % 2 = 1")
    pairs = matching.match_particles(a, b, key="image", id_col="vec_id", axes="xyz", how="optimal")
    return matching.approximate_sets(a, b, pairs, id_col="vec_id", tolerance=0.1).select("vec_id", "origin")


@_query("""WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS s FROM embeddings)
 SELECT vec_id, EXISTS (SELECT 1 FROM p b WHERE b.label = a.label AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < (0.06 / 1.5) * (0.06 / 1.5) AND (a.s < b.s OR (a.s = b.s AND a.vec_id > b.vec_id))) AS deleted FROM p a""")
def pairwise_suppression(spark, sf_dir):
    return matching.suppress_pairs(_points(spark, sf_dir), key="label", x="x", y="y", size="z", tie="vec_id", diameter=0.06).select("vec_id", "deleted")


@_query()
def density_peaks(spark, sf_dir):
    return matching.density_peaks(_points(spark, sf_dir), key="image", id_col="vec_id", axes="xyz", cutoff=0.1, least_density=3, least_distance=0.15)


@_query("SELECT o_orderkey, k, round(0.07 * cos(a) - sqrt(1 - 0.07 * 0.07) * sin(a), 5) AS value FROM (SELECT o_orderkey, i AS k, pi() * l * -(o_totalprice / 1e5 * 1e4) * (i * 0.02) * (i * 0.02) + pi() / 2 * 2.7e7 * l * l * l * (i * 0.02) * (i * 0.02) * (i * 0.02) * (i * 0.02) AS a FROM orders, range(1, 11) r(i), (SELECT 12.2643247 / sqrt(300000.0 * (1 + 0.978466e-6 * 300000.0)) AS l))")
def ctf_curve(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("d")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))))
    c = {n: F.lit(v) for n, v in {"v": 300.0, "cs": 2.7, "a": 0.07, "p": 0.0, "b": 0.0, "s": 1.0}.items()}
    return o.select("o_orderkey", "k", F.round(physics.ctf(F.col("k") * 0.02, F.col("d"), c["v"], c["cs"], c["a"], c["p"], c["b"], c["s"]), 5).alias("value"))


@_query("""SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS base, regexp_extract(url, '^(.*[/\\\\])?', 0) AS folder, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS root FROM pages""")
def path_parts(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", text.base_name(u).alias("base"), text.folder(u).alias("folder"), text.root_name(u).alias("root"))


@_query("SELECT l_orderkey, l_linenumber, round((u + v) * 0.5e-4, 6) AS defocus, round((u - v) * 0.5e-4, 6) AS delta FROM (SELECT *, (l_quantity / 10 + l_discount / 2) * 1e4 AS u, (l_quantity / 10 - l_discount / 2) * 1e4 AS v FROM lineitem)")
def defocus_round_trip(spark, sf_dir):
    """Written as U and V and read again: the difference comes back halved."""
    d, e = F.col("l_quantity") / 10, F.col("l_discount")
    back = physics.read_defocus(physics.defocus_u(d, e), physics.defocus_v(d, e))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", back.alias("b")).select("l_orderkey", "l_linenumber", F.round("b.defocus", 6).alias("defocus"), F.round("b.delta", 6).alias("delta"))


@_query("SELECT vec_id, round(CASE WHEN abs(x) < 1e-8 THEN 1 ELSE sin(pi() * x) / (pi() * x) END, 6) AS sinc, round(x - floor(x), 6) AS fraction, CAST(ceil(vec_id / 8.0) * 8 AS BIGINT) AS multiple FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)")
def scalar_functions(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select("vec_id", F.round(maths.sinc(F.col("x")), 6).alias("sinc"), F.round(maths.fraction(F.col("x")), 6).alias("fraction"), maths.next_multiple(F.col("vec_id"), 8).alias("multiple"))


_EULER = ("cp*ct*cr - sp*sr", "cp*ct*sr + sp*cr", "-cp*st", "-sp*ct*cr - cp*sr", "-sp*ct*sr + cp*cr", "sp*st", "st*cr", "st*sr", "ct")


@_query(f"""SELECT vec_id, {", ".join(f"round({e}, 6) + 0.0 AS m{k // 3 + 1}{k % 3 + 1}" for k, e in enumerate(_EULER))} FROM (SELECT vec_id, cos(r) AS cr, sin(r) AS sr, cos(t) AS ct, sin(t) AS st, cos(p) AS cp, sin(p) AS sp
    FROM (SELECT vec_id, radians(vec_id % 360) AS r, radians(vec_id % 180) AS t, radians(vec_id % 90) AS p FROM embeddings))""")
def euler_matrices(spark, sf_dir):
    m = geometry.from_euler((F.col("vec_id") % 360).cast("double"), (F.col("vec_id") % 180).cast("double"), (F.col("vec_id") % 90).cast("double"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", m.alias("m")).select("vec_id", *[(F.round(F.get("m", F.lit(k)), 6) + 0.0).alias(f"m{k // 3 + 1}{k % 3 + 1}") for k in range(9)])


@_query("SELECT CAST(floor(o_totalprice / 1000) AS BIGINT) AS voxel, arg_min(o_orderkey, (o_custkey % 97, o_orderkey)) AS map_id FROM orders GROUP BY 1")
def map_compositing(spark, sf_dir):
    """Each voxel from the map of best resolution."""
    from lumenframe.operators import kernels

    o = _t(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 1000).alias("voxel"), F.col("o_orderkey").alias("map_id"), (F.col("o_custkey") % 97).cast("double").alias("resolution"), F.lit(0.0).alias("half1"), F.lit(0.0).alias("half2"))
    return kernels.composite(o).select("voxel", "map_id")


@_query("SELECT user_id, to_json({'n': count(*), 'last': max(event_id)}) AS settings FROM events GROUP BY 1")
def settings_json(spark, sf_dir):
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return e.select("user_id", F.to_json(F.struct("n", "last")).alias("settings"))


@_query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS place FROM lineitem")
def positions_in_group(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@_query("SELECT a.s_suppkey AS left_key, b.c_custkey AS right_key FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS k FROM supplier) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS k FROM customer) b USING (k)")
def positional_join(spark, sf_dir):
    a, b = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return matching.positional_join(a, b, ["s_acctbal", "s_suppkey"], ["c_acctbal", "c_custkey"]).select(F.col("s_suppkey").alias("left_key"), F.col("c_custkey").alias("right_key"))


@_query("WITH RECURSIVE r AS (SELECT x // 2 AS ancestor, x AS node, 1 AS depth FROM (SELECT c_custkey AS x FROM customer) WHERE x > 1 UNION ALL SELECT ancestor // 2, node, depth + 1 FROM r WHERE ancestor > 1) SELECT ancestor, node, depth FROM r WHERE ancestor > 0")
def descendants(spark, sf_dir):
    """All pairs of ancestor and descendant of a binary tree over customers."""
    from lumenframe.operators import catalog

    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent"))
    return catalog.descendants(c, "node", "parent").filter("ancestor > 0")


_GOOD = f"WITH {_ITEMS}"


@_query(f"""{_GOOD}, p AS (SELECT l_orderkey AS item_id, l_quantity, l_discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 4 = 0 OR l_quantity >= s_suppkey % 50)
 SELECT item_id, count(*) AS n, round(avg(l_quantity), 6) AS mean_score FROM p JOIN qc USING (item_id) WHERE accepted GROUP BY 1""")
def good_particles(spark, sf_dir):
    """Accepted picks of accepted items, counted by item: filter, join, threshold, aggregation."""
    items = quality.range_filter(_items(spark, sf_dir), quality.Ranges()).filter("accepted").select("item_id")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 4 != 0, F.create_map(F.lit("boxnet"), (F.col("s_suppkey") % 50).cast("double"))).alias("picking_thresholds"))
    picks = quality.score_threshold(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), "l_suppkey", "l_quantity"), s, "boxnet", key="l_suppkey", score="l_quantity")
    return picks.join(items, "item_id").groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_score"))


@_query()
def file_hashes(spark, sf_dir):
    """Content hash of pages by name and the beginning of their bytes."""
    return _t(spark, sf_dir, "pages").select("page_id", hashing.file_hash(text.root_name(F.col("url")), F.encode("html", "UTF-8")).alias("hash"))
