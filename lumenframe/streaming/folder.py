"""Folders as streams: files that no longer grow, series that are complete, results that follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.plans.shared import dropped, stored

LISTING = "path string, size long, seen_at timestamp, done boolean"


def listing(spark: SparkSession, folder: str, glob: str = "*", results: str = ".xml") -> DataFrame:
    """(path, size, seen_at, done) of the files just now; done: a file of the same name that ends in ``results`` lies beside it. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", F.col("length").alias("size"))
    made = spark.read.format("binaryFile").option("pathGlobFilter", f"*{results}").load(folder).select(_root(F.col("path")).alias("_root"), F.lit(True).alias("_made")).distinct()
    own = F.lower("path").endswith(results)
    found = files.withColumn("_root", F.when(~own, _root(F.col("path")))).join(made, "_root", "left")
    return found.select("path", "size", F.current_timestamp().alias("seen_at"), F.coalesce("_made", F.lit(False)).alias("done"))


def _root(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def record_listings(spark: SparkSession, folder: str, table: str, glob: str = "*", quiet_ms: int = 1000, results: str = ".xml"):
    """A stream writer that appends to a Parquet table, at each of its triggers, the files of the folder that are not settled.

    A file source would hand out each file once, when it is first seen; what grows has to be looked at again. A file is
    recorded until it has been recorded with a size that it kept for over ``quiet_ms``, and then only when its size changes
    or a result comes to lie beside it: rows follow what happens, not files times triggers. The last listing is kept beside
    it, a row a file. Streams for ``stable_files`` read the table with the schema LISTING.
    """
    kept: list[DataFrame] = []

    def write(batch: DataFrame, _: int) -> None:
        now = listing(batch.sparkSession, folder, glob, results)
        if kept:
            last = kept[0].select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "done", "since", "told")])
            same = F.col("_size").eqNullSafe(F.col("size")) & F.col("_done").eqNullSafe(F.col("done"))
            since = F.when(same, F.col("_since")).otherwise(F.col("seen_at"))
            was = same & F.coalesce("_told", F.lit(False))
            now = now.join(last, "path", "left").select("path", "size", "seen_at", "done", since.alias("since"), was.alias("was"))
        else:
            now = now.select("*", F.col("seen_at").alias("since"), F.lit(False).alias("was"))
        told = F.col("was") | F.col("done") | (F.unix_millis("seen_at") - F.unix_millis("since") > quiet_ms)
        new = stored(now.withColumn("told", told))
        new.filter("not was").select("path", "size", "seen_at", "done").write.mode("append").parquet(table)
        if kept:
            dropped(kept.pop())
        kept.append(new)

    return spark.readStream.format("rate").load().writeStream.foreachBatch(write)


def _settled(key: str, count: str, rows: DataFrame, ready: Callable[[int, int], bool], wait_ms: int, timer: bool) -> DataFrame:
    """Of a stream (key, count, seen_at, done): each key once, when a row of it is done, or its count ready by ``ready`` (count, milliseconds it has stayed).

    The state of a key is its count, since when it has it, and whether it went on already. Time is what rows say. With
    ``timer`` a key of which no more rows come goes on after ``wait_ms``; such a stream never runs out of batches, so it is
    not for triggers that stop when all is read.
    """

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, since, done = state.get if state.exists else (-1, 0, False)
        if state.hasTimedOut:
            if not done:
                done = True
                yield pd.DataFrame({key: [name[0]], count: [n], "seen_at": [pd.Timestamp(since, unit="ms")]})
        else:
            frame = pd.concat(list(frames)).sort_values("seen_at")
            for now, at, made in zip(frame[count].tolist(), frame["seen_at"], frame["done"].tolist(), strict=True):
                ms = int(at.value // 1_000_000)
                if made and not done:
                    n, since, done = now, ms, True
                    yield pd.DataFrame({key: [name[0]], count: [n], "seen_at": [at]})
                elif now != n:
                    n, since = now, ms
                elif not done and ready(n, ms - since):
                    done = True
                    yield pd.DataFrame({key: [name[0]], count: [n], "seen_at": [at]})
        state.update((int(n), int(since), bool(done)))
        if timer and not done:
            state.setTimeoutDuration(wait_ms + 1)

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} string, {count} long, seen_at timestamp", f"{count} long, since long, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout)


def stable_files(seen: DataFrame, quiet_ms: int = 1000, skip: str = ".xml", timer: bool = False) -> DataFrame:
    """Of a stream of listings (path, size, seen_at, done): each file once, when its size has stayed for over ``quiet_ms``, or at once if it is done.

    Files that end in ``skip``, which results of other files do, are no items themselves and are left out. A stream without
    the column done has no results yet.
    """
    files = seen.filter(~F.lower("path").endswith(skip))
    done = F.coalesce("done", F.lit(False)) if "done" in seen.columns else F.lit(False)
    return _settled("path", "size", files.withColumn("done", done), lambda _, ms: ms > quiet_ms, quiet_ms, timer)


def complete_series(tilts: DataFrame, expected: int, timeout_ms: int, timer: bool = False) -> DataFrame:
    """Of a stream (series, tilts, seen_at): each series once, when its number of tilts is the expected or has stayed for the timeout."""
    return _settled("series", "tilts", tilts.withColumn("done", F.lit(False)), lambda n, ms: n >= expected or ms > timeout_ms, timeout_ms, timer)


def once(files: DataFrame, time: str | None = None, late: str = "1 day") -> DataFrame:
    """Each path once, however often it arrives; of a stream with a time column, state older than ``late`` is let go."""
    if time and files.isStreaming:
        return files.withWatermark(time, late).dropDuplicatesWithinWatermark(["path"])
    return files.dropDuplicates(["path"])


def stale(items: DataFrame, results: DataFrame, key: str, options: list[str]) -> DataFrame:
    """Items without a result of their present options: what is left to process."""
    want = items.withColumn("_options", F.sha2(F.to_json(F.struct(*options)), 256))
    return want.join(results.select(key, "_options"), [key, "_options"], "left_anti")


def stamped(results: DataFrame, options: list[str]) -> DataFrame:
    """Results with the digest of the options they were made with, for ``stale``."""
    return results.withColumn("_options", F.sha2(F.to_json(F.struct(*options)), 256))


def publish(rows: DataFrame, table: str, key: str):
    """Writes a stream of items' rows so that a batch replaces all rows of the items it holds, and doing it again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(table)

    return rows.writeStream.foreachBatch(write)


def publish_buckets(rows: DataFrame, table: str, key: str, buckets: int = 64):
    """Like ``publish`` for many items: rows lie in a fixed number of folders by a hash of their item, not in one an item."""
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = stored(batch.withColumn("_bucket", bucket))
        whole = new
        if _exists(spark, table):
            old = spark.read.parquet(table).join(F.broadcast(new.select("_bucket").distinct()), "_bucket", "left_semi")  # as many rows as buckets
            whole = stored(old.join(new.select(key).distinct(), key, "left_anti").select(new.columns).unionByName(new))
        whole.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(table)
        dropped(*{id(x): x for x in (new, whole)}.values())

    return rows.writeStream.foreachBatch(write)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def running_counts(items: DataFrame, status: str = "status") -> DataFrame:
    """How many items have each status so far; for complete mode."""
    return items.groupBy(status).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, *, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums and counts of tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "total", "n")
