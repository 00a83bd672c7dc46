"""Species, sources and versions: hierarchies, references and commits of changed content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.shared import cut


def descendants(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(ancestor, node, depth) of all pairs, level by level; a node that is its own ancestor ends the walk there."""
    edges = nodes.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("ancestor"), F.col(node).alias("node")).distinct()
    edges = cut(edges)
    out, level, depth = edges.withColumn("depth", F.lit(1)), edges, 1
    while True:
        depth += 1
        level = level.join(edges.select(F.col("ancestor").alias("node"), F.col("node").alias("_next")), "node").select("ancestor", F.col("_next").alias("node")).distinct()
        level = cut(level.join(out, ["ancestor", "node"], "left_anti"))
        if level.isEmpty():
            return out
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))


def resolve(rows: DataFrame, reference: str, catalog: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to what they refer to; a reference to nothing is an error when it is reached."""
    found = catalog.withColumnRenamed(key, "_key").withColumn("_there", F.lit(True))
    joined = rows.join(found, F.col(reference) == F.col("_key"), "left")
    fails = F.col(reference).isNotNull() & F.col("_there").isNull()
    return joined.withColumn(reference, F.when(fails, F.raise_error(F.concat(F.lit("no such entry: "), F.col(reference).cast("string")))).otherwise(F.col(reference))).drop("_key", "_there")


def with_files(rows: DataFrame, files: DataFrame, name: Column) -> DataFrame:
    """Rows whose file is in a listing (path)."""
    from lumenframe.functions import text

    return rows.withColumn("_file", name).join(files.select(text.base_name(F.col("path")).alias("_file")).distinct(), "_file", "left_semi").drop("_file")


def changed(current: DataFrame, committed: DataFrame, key: str, content: Column) -> DataFrame:
    """Entries whose content hash is not that of their last version, with the hash as version."""
    from lumenframe.functions import hashing

    return current.withColumn("version", hashing.text_hash(content)).join(committed.select(key, "version"), [key, "version"], "left_anti")


def commit(current: DataFrame, committed: DataFrame, key: str, content: Column, folder: str) -> DataFrame:
    """Writes changed entries to a folder for each version and returns them."""
    rows = changed(current, committed, key, content)
    rows.write.mode("append").partitionBy("version").parquet(f"{folder}/versions")
    return rows
