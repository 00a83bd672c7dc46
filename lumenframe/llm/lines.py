"""Removal of repeated line runs, with DataFrame functions only.

A document is a sequence of line numbers; all suffixes of all sequences are sorted by prefix doubling. A round orders the
suffixes by their first 2n lines: the rank of those is the place of the pair of ranks of n lines each among all distinct pairs,
which are sorted by ranges. Only suffixes whose rank another one shares go on, so that the rounds shrink with what still
repeats. Suffixes of one rank are an interval of the suffix array in which the longest common prefix is 2n lines at least;
any other length lies between two such ranks, that of the run's first n lines and that of its last n. For each place
the interval of the shortest run of ``min_chars`` characters is looked up, from the place on and up to it: any repeated run is
a union of these. Whoever is not the first of an interval is a later copy; what such copies cover together are
the maximal runs to delete. Intervals are told apart by ranks, not by walking along the array, so that Spark can split those
that hold a large part of all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import dropped, stored, with_number, with_row_id

MIN_CHARS = 50


def _name(*parts) -> list[Column]:
    """Two 64-bit hashes as one name of a line: at 128 bits different lines do not meet."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts, F.lit(2))]


def _intervals(rows: DataFrame, *names: str) -> DataFrame:
    """(names, first): what more than one place is called, and the first such place."""
    return rows.groupBy(*names).agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").drop("last")


def _ranked(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` whose name more than one place has, with rank, the name's place among all such names."""
    ranks = with_row_id(_intervals(rows, *names).select(*names), names, "rank")
    return rows.join(ranks, list(names))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, key, removed): the places, from 0 on and sorted, of the lines to delete; documents without any are left out.

    doc is the number of the id, null as the least, key the hash of the text. A line is deleted if it lies in a run of
    consecutive lines, ``min_chars`` characters or more in all, that also starts earlier: in a document of smaller id, or
    before in the same document, be it overlapping. Rows of one id stand at the same places; equal rows are one.
    """
    src = with_number(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("t is not null"), "id", "doc")
    src = src.select("doc", F.xxhash64("t").alias("key"), F.split("t", "\n", -1).alias("l"))
    lines = src.select("doc", "key", F.posexplode(F.transform("l", lambda x: F.struct(*[h.alias(n) for h, n in zip(_name(x), ("x", "y"), strict=True)], F.char_length(x).alias("n")))).alias("pos", "s"))
    at = (F.col("doc").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")
    lines = stored(lines.select("doc", "key", "pos", at.alias("at"), "s.*"))
    # only repeated lines can be part of a repeated run
    level = stored(_ranked(lines, "x", "y").dropDuplicates(["doc", "key", "pos"]).select("doc", "key", "pos", "at", "n", "rank"))
    dropped(lines)
    # of each stretch of neighbours: the shortest run from each line on, and the shortest up to it, that is long enough
    marks = stored(_windows(level, min_chars))
    top = marks.agg(F.max("len")).first()[0] or 0
    levels = [level]
    hits, intervals = _later(marks.filter("len = 1").join(level.select("doc", "key", "pos", "at", "rank"), ["doc", "key", "pos"]), "rank")
    temporary = [marks, intervals]
    n = 1
    while 2 * n <= top:
        # runs of n to 2n - 1 lines have been looked up by two ranks of n; now n doubles
        level = levels[-1].select("doc", "key", "pos", "at", "rank")
        after = level.select("doc", "key", (F.col("pos") - n).alias("pos"), F.col("rank").alias("r2"))
        pair = level.withColumnRenamed("rank", "r1").join(after, ["doc", "key", "pos"])
        level = stored(_ranked(pair, "r1", "r2").select("doc", "key", "pos", "at", "rank"))
        levels.append(level)
        n *= 2
        here = marks.filter((F.col("len") >= n) & (F.col("len") < 2 * n))
        tail = level.select("doc", "key", F.col("pos").alias("p2"), F.col("rank").alias("r2"))
        named = here.join(level, ["doc", "key", "pos"]).withColumn("p2", F.col("pos") + F.col("len") - n).join(tail, ["doc", "key", "p2"])
        more, intervals = _later(named, "len", "rank", "r2")
        hits = hits.unionByName(more)
        temporary.append(intervals)
    # runs over many empty lines overlap each other: of each only the lines beyond those that start before it
    ends = hits.groupBy("doc", "key", "pos").agg(F.max(F.col("pos") + F.col("len") - 1).alias("end"))
    before = Window.partitionBy("doc", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("from", F.greatest("pos", F.max("end").over(before) + 1)).filter("from <= end")
    found = stored(ends.select("doc", "key", F.explode(F.sequence("from", "end")).alias("pos")).groupBy("doc", "key").agg(F.array_sort(F.collect_list("pos")).alias("removed")))
    dropped(*temporary, *levels)
    return found


def _later(runs: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """The runs (doc, key, pos, len) that are not the first in their interval, and the stored intervals, which hold no rows of hot ones, so that Spark may split those of the runs."""
    intervals = stored(_intervals(runs, *names))
    return runs.join(intervals, list(names)).filter("first < at").select("doc", "key", "pos", "len"), intervals


def _windows(level: DataFrame, min_chars: int) -> DataFrame:
    """(doc, key, pos, len) of the shortest runs of repeated lines that reach ``min_chars``, from and up to each line.

    Any longer run is made of these.
    """
    of_doc = level.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("a"))
    # stretches without a gap, each as the characters before each line and in all
    gaps = F.expr("filter(sequence(0, size(a) - 1), i -> i = 0 OR a[i].pos <> a[i - 1].pos + 1)")
    parts = of_doc.withColumn("g", gaps).select("doc", "key", F.explode(F.expr("transform(g, (s, k) -> slice(a, s + 1, coalesce(get(g, k + 1), size(a)) - s))")).alias("a"))
    # empty lines add nothing: b has the others, k of them in a row reach min_chars or fewer do
    parts = parts.withColumn("b", F.expr("filter(a, x -> x.n > 0)")).filter("size(b) > 0")
    ahead = "aggregate(slice(b, k + 1, {m}), struct(0 AS c, 0 AS k), (s, x) -> IF(s.c >= {m}, s, struct(s.c + x.n AS c, s.k + 1 AS k)))"
    back = "aggregate(reverse(slice(b, greatest(0, k - {m} + 1) + 1, least({m}, k + 1))), struct(0 AS c, 0 AS k), (s, x) -> IF(s.c >= {m}, s, struct(s.c + x.n AS c, s.k + 1 AS k)))"
    # an empty line's run ahead ends with that of the next line of b, its run back starts with that of the one before
    whole = F.expr(
        f"""flatten(transform(sequence(0, size(b) - 1), k -> concat(
        flatten(transform(array({ahead.format(m=min_chars)}), s -> IF(s.c >= {min_chars}, transform(sequence(IF(k = 0, a[0].pos, b[greatest(k - 1, 0)].pos + 1), b[k].pos), p -> struct(p AS pos, b[k + s.k - 1].pos - p + 1 AS len)), array()))),
        flatten(transform(array({back.format(m=min_chars)}), s -> IF(s.c >= {min_chars}, transform(sequence(b[k].pos, coalesce(get(b, k + 1).pos - 1, a[size(a) - 1].pos)), p -> struct(b[k - s.k + 1].pos AS pos, p - b[k - s.k + 1].pos + 1 AS len)), array()))))))"""
    )
    return parts.select("doc", "key", F.explode(whole).alias("r")).select("doc", "key", "r.*").distinct()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text without its repeated lines, n_lines and n_removed.

    A null text stays null and has no lines; an empty text is one empty line; a text whose lines all go becomes empty.
    Columns of docs named n_lines or n_removed are replaced; repeated rows get equal results.
    """
    kept = docs.drop("n_lines", "n_removed")
    given = [c for c in kept.columns if c != text_col]
    found = repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    src = kept.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("given"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    src = with_number(src, "id", "doc")
    src = src.join(found.hint("shuffle_hash"), ["doc", "key"], "left")
    lines = F.split("t", "\n", -1)
    src = src.withColumn("l", F.when(F.col("removed").isNotNull(), lines))
    rest = F.expr("array_join(transform(array_except(sequence(0, size(l) - 1), removed), i -> l[i]), '\\n')")
    n = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.char_length("t") - F.char_length(F.translate("t", "\n", "")) + 1)
    out = src.select("given", F.when(F.col("removed").isNull(), F.col("t")).otherwise(rest).alias("t"), n.cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"))
    columns = [F.col("t").alias(c) if c == text_col else F.col(f"given.`{c}`") for c in kept.columns]
    return out.select(*columns, "n_lines", "n_removed")


#: The same rows in SQL for DuckDB.
ORACLE_SQL = f"""
WITH l AS (
    SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line, text IS NULL AS none
    FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)
), s AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l WHERE NOT none
), runs AS (
    SELECT a.doc_id, a.pos, min(b.pos) AS til FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + length(a.line) >= {MIN_CHARS} GROUP BY ALL
    UNION
    SELECT b.doc_id, max(a.pos) AS pos, b.pos AS til FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + length(a.line) >= {MIN_CHARS} GROUP BY b.doc_id, b.pos
), named AS (SELECT r.doc_id, r.pos, r.til, string_agg(s.line, chr(10) ORDER BY s.pos) AS run FROM runs r JOIN s ON s.doc_id = r.doc_id AND s.pos BETWEEN r.pos AND r.til GROUP BY ALL
), later AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS again FROM named
), gone AS (SELECT DISTINCT s.doc_id, s.pos FROM later JOIN s ON s.doc_id = later.doc_id AND s.pos BETWEEN later.pos AND later.til WHERE again)
SELECT l.doc_id, CAST(count(*) FILTER (NOT l.none) AS BIGINT) AS n_lines, CAST(count(gone.pos) AS BIGINT) AS n_removed,
    sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id
"""
