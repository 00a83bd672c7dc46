"""Connected components of a graph that is only ever a distributed table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that edges reach.

    Large-star and small-star steps alternate: every node is linked to the smallest node it knows of, until all
    edges are stars. The minima are aggregated before they are shuffled, and are written to the shared folder before
    they are joined, so that Spark may split a hub's edges over tasks. Loops, repeated edges and null ends do not count.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna().filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = stored(e.distinct())
    mark = _mark(e)
    while mark[0]:
        # large star: u's larger neighbours are linked to the smallest of u and its neighbours
        low = stored(e.groupBy("u").agg(F.min("v").alias("m")))
        large = stored(e.join(low.withColumnsRenamed({"u": "k", "m": "km"}), F.col("v") == F.col("k"), "left").select("u", F.coalesce("km", "v").alias("v")))
        dropped(e, low)
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        e = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v")
        e = stored(e.distinct())
        dropped(large, low)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    """The number of edges and an order-free digest of them: equal marks mean that a round changed nothing."""
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
