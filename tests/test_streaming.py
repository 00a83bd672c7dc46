"""Streams over folders of small files."""

import json

from pyspark.sql import functions as F

from lumenframe.streaming import folder


def feed(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_stable_files(spark, tmp_path):
    at = "2024-01-01T00:00:0{}Z"
    feed(tmp_path, "1.json", [{"path": "a", "size": 1, "seen_at": at.format(0)}, {"path": "b", "size": 1, "seen_at": at.format(0)}, {"path": "a", "size": 2, "seen_at": at.format(1)}, {"path": "b", "size": 1, "seen_at": at.format(1)}, {"path": "a", "size": 2, "seen_at": at.format(3)}, {"path": "a", "size": 2, "seen_at": at.format(5)}])
    seen = spark.readStream.schema("path string, size long, seen_at timestamp").json(str(tmp_path))
    rows = run(spark, folder.stable_files(seen), "ripe")
    assert [(r["path"], r["size"]) for r in rows] == [("a", 2)]


def test_files_with_results_pass_at_once(spark, tmp_path):
    """In the first batch a file goes on that has its result beside it; one without waits until it is quiet."""
    at = "2024-01-01T00:00:0{}Z"
    row = lambda p, n, k, done: {"path": p, "size": n, "seen_at": at.format(k), "done": done}
    seen = spark.readStream.schema(folder.LISTING).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    feed(tmp_path, "1.json", [row("a", 1, 0, False), row("b", 1, 0, True), row("b.xml", 9, 0, False)])
    rows = run(spark, folder.stable_files(seen), "first_batch")
    assert [(r["path"], r["size"]) for r in rows] == [("b", 1)]
    feed(tmp_path, "2.json", [row("a", 1, 2, False), row("b", 2, 2, True), row("c", 5, 2, False)])
    feed(tmp_path, "3.json", [row("a", 1, 3, False), row("c", 6, 3, True), row("c", 6, 9, True)])
    rows = run(spark, folder.stable_files(seen), "all_batches")
    assert sorted((r["path"], r["size"]) for r in rows) == [("a", 1), ("b", 1), ("c", 6)]


def test_listings_follow_what_happens(spark, tmp_path):
    """A settled file is recorded no more, until it changes or its result comes."""
    import time

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mrc").write_bytes(b"1")
    (tmp_path / "in" / "b.mrc").write_bytes(b"1")
    (tmp_path / "in" / "b.xml").write_bytes(b"1")
    table = str(tmp_path / "listings")
    spark.createDataFrame([], folder.LISTING).write.parquet(table)
    lister = folder.record_listings(spark, str(tmp_path / "in"), table, "*.mrc", quiet_ms=300).trigger(processingTime="500 milliseconds").start()

    def of(name):
        return sorted((r["seen_at"], r["size"], r["done"]) for r in spark.read.schema(folder.LISTING).parquet(table).collect() if r["path"].endswith(name))

    def until(ready):
        end = time.time() + 90
        while time.time() < end and not ready():
            time.sleep(0.5)
        assert ready()

    until(lambda: len(of("a.mrc")) >= 2)
    time.sleep(4)
    a, b = of("a.mrc"), of("b.mrc")
    assert len(a) <= 3 and [r[1:] for r in b] == [(1, True)]
    (tmp_path / "in" / "a.xml").write_bytes(b"1")
    until(lambda: of("a.mrc")[-1][2])
    (tmp_path / "in" / "b.mrc").write_bytes(b"12")
    until(lambda: of("b.mrc")[-1][1] == 2)
    lister.stop()


def test_publish_twice_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed(tmp_path / "in", "1.json", [{"item": 1, "v": 1}, {"item": 2, "v": 2}])
    out = str(tmp_path / "table")
    spark.createDataFrame([(1, 9), (3, 3)], "item long, v long").write.partitionBy("item").parquet(out)
    stream = spark.readStream.schema("item long, v long").json(str(tmp_path / "in"))
    for _ in range(2):
        folder.publish(stream, out, "item").trigger(availableNow=True).start().awaitTermination(120)
        assert sorted((r["item"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_stale_items(spark):
    items = spark.createDataFrame([(1, 5), (2, 6)], "item int, setting int")
    done = folder.stamped(spark.createDataFrame([(1, 5), (2, 7)], "item int, setting int"), ["setting"])
    assert [r["item"] for r in folder.stale(items, done, "item", ["setting"]).collect()] == [2]


def test_listing(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"123")
    (tmp_path / "b.tif").write_bytes(b"1")
    (tmp_path / "b.xml").write_bytes(b"<Movie/>")
    assert sorted((r["size"], r["done"]) for r in folder.listing(spark, str(tmp_path), "*.tif").collect()) == [(1, True), (3, False)]
    assert {r["path"].rsplit("/", 1)[1]: r["done"] for r in folder.listing(spark, str(tmp_path)).collect()} == {"a.tif": False, "b.tif": True, "b.xml": False}
    assert folder.running_counts(spark.createDataFrame([("x",), ("x",)], "status string")).first()["n"] == 2


def test_files_that_are_listed_once_go_on_by_timer(spark, tmp_path):
    """Files arrive in a folder, are listed while the stream runs, and go on when they are quiet; results of others never do."""
    import time

    (tmp_path / "in").mkdir()
    for name in ("a.mrc", "b.mrc", "a.xml"):
        (tmp_path / "in" / name).write_bytes(b"1234")
    table = str(tmp_path / "listings")
    spark.createDataFrame([], folder.LISTING).write.parquet(table)
    lister = folder.record_listings(spark, str(tmp_path / "in"), table).trigger(processingTime="1 second").start()
    ripe = folder.stable_files(spark.readStream.schema(folder.LISTING).parquet(table), 200, timer=True)
    q = ripe.writeStream.format("memory").queryName("quiet").outputMode("append").start()
    end = time.time() + 60
    while time.time() < end and spark.table("quiet").count() < 2:
        time.sleep(1)
    lister.stop()
    q.stop()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.table("quiet").collect()) == ["a.mrc", "b.mrc"]


def test_complete_series(spark, tmp_path):
    at = "2024-01-01T00:00:{:02d}Z"
    rows = [{"series": "a", "tilts": n, "seen_at": at.format(k)} for k, n in enumerate((1, 3, 3))] + [{"series": "b", "tilts": 2, "seen_at": at.format(k)} for k in (0, 1)]
    feed(tmp_path, "1.json", rows)
    seen = spark.readStream.schema("series string, tilts long, seen_at timestamp").json(str(tmp_path))
    q = folder.complete_series(seen, 3, 600_000).writeStream.format("memory").queryName("whole").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["series"], r["tilts"]) for r in spark.table("whole").collect()] == [("a", 3)]


def test_publish_in_buckets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "table")
    for k, rows in enumerate(([{"item": 1, "v": 9}, {"item": 3, "v": 3}], [{"item": 1, "v": 1}, {"item": 1, "v": 5}, {"item": 2, "v": 2}])):
        feed(tmp_path / "in", f"{k}.json", rows)
        stream = spark.readStream.schema("item long, v long").json(str(tmp_path / "in"))
        folder.publish_buckets(stream, out, "item", 2).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r["item"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, 1), (1, 5), (2, 2), (3, 3)]
