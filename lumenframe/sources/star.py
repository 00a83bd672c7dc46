"""STAR tables: blocks data_<name> of text cells, read and written as text by Spark.

Files are read whole, one a row, so that any store that Spark knows will do; a file is a task's unit, as its blocks have
no index. Cells are strings; casts give them types.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blocks(text: str) -> Iterator[tuple[str, list[str], list[list[str]]]]:
    """(name, columns, rows) of each block; a block's first line of another number of cells ends it.

    A block without loop_ is a table of one row, a column for each line ``_column value``.
    """
    for part in re.split(r"^data_", text, flags=re.M)[1:] if re.search(r"^data_", text, flags=re.M) else ["\n" + text]:
        name, _, body = part.partition("\n")
        columns: dict[int, str] = {}
        rows: list[list[str]] = []
        loop = one = False
        for line in body.split("\n"):
            cells = line.split()
            if line.strip() == "loop_" or (not loop and "loop_" in line):
                loop = True
            elif loop and not rows and line.lstrip().startswith("_"):
                at = int(cells[1][1:]) - 1 if len(cells) > 1 and re.fullmatch(r"#\d+", cells[1]) else len(columns)
                columns[at] = cells[0][1:]
            elif loop and columns:
                if len(cells) != len(columns):
                    if rows or cells:
                        break
                    continue
                rows.append(cells)
            elif not loop and line.lstrip().startswith("_") and len(cells) == 2:
                columns[len(columns)] = cells[0][1:]
                rows = [[*(rows[0] if rows else []), cells[1]]]
                one = True
        if loop or one:
            yield name.strip(), [columns[k] for k in sorted(columns)], rows


def tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the blocks that the files hold."""
    names = F.regexp_extract_all("value", F.lit(r"(?m)^data_(\S*)"), F.lit(1))
    return sorted(r[0] for r in spark.read.text(path, wholetext=True).select(F.explode(names)).distinct().collect())


def read(spark: SparkSession, path: str, table: str | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of one block of all files: _path, _row and its columns as strings.

    table: the block whose name begins so, else the first. Without ``columns`` those of the first file are taken;
    a column that a file lacks is null. ``limit`` holds for each file, within the read.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("_path"))
    if columns is None:
        first = files.orderBy("_path").limit(1).collect()
        columns = next((c for n, c, _ in blocks(first[0]["value"]) if table is None or n.startswith(table)), []) if first else []

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, name in zip(frame["value"], frame["_path"], strict=True):
                for n, found, rows in blocks(text):
                    if table is None or n.startswith(table):
                        cells = pd.DataFrame(rows[:limit], columns=found, dtype=str).reindex(columns=columns)
                        cells.insert(0, "_row", range(len(cells)))
                        cells.insert(0, "_path", name)
                        # plain objects: chunked string columns don't fit in the struct that Spark makes of a frame
                        yield cells.astype({c: object for c in cells.columns if c != "_row"})
                        break

    return files.mapInPandas(parse, ", ".join(["_path string", "_row long", *(f"`{c}` string" for c in columns)]))


def count_rows(spark: SparkSession, path: str, table: str | None = None) -> int:
    """Rows of the block in all files, by the same rules as ``read``."""
    return read(spark, path, table, columns=[]).count()


def as_text(df: DataFrame, name: str = "", order: list[str] | None = None) -> DataFrame:
    """(line, value): the table as lines of text, cells to the right of columns that are as wide as needed and two more."""
    order = order or []
    cells = [c for c in df.columns if c not in order or not c.startswith("_")]
    width = df.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in cells]).first()
    row = F.concat(*[F.lpad(F.col(f"`{c}`").cast("string"), F.greatest(F.length(F.col(f"`{c}`").cast("string")), F.lit((width[c] or 0))) + 2, F.lit(" ")) for c in cells])
    head = ["", f"data_{name}", "", "loop_", *(f"_{c} #{k + 1}" for k, c in enumerate(cells))]
    from lumenframe.operators.table import with_row_id

    rows = (with_row_id(df, order, "_line") if order else df.withColumn("_line", F.monotonically_increasing_id())).select((F.col("_line") + len(head)).alias("line"), row.alias("value"))
    return df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(head)], "line long, value string").unionByName(rows)


def write(named: dict[str, DataFrame], path: str, order: list[str] | None = None) -> None:
    """One file of all tables, one after the other, three empty lines between them. It has one writer, as the format has no parts."""
    out = None
    for k, (name, df) in enumerate(named.items()):
        lines = as_text(df, name, order).withColumn("table", F.lit(k))
        if out is not None:
            lines = lines.unionByName(df.sparkSession.createDataFrame([(-j, "", k) for j in (1, 2, 3)], "line long, value string, table int"))
        out = lines if out is None else out.unionByName(lines)
    out.orderBy("table", "line").select("value").coalesce(1).write.mode("overwrite").text(path)


def parameters(df: DataFrame, name: str) -> str:
    """A block without loop_ of a one-row table: a line for each column."""
    row = df.first()
    return "\n".join(["", f"data_{name}", "", *(f"_{c}  {row[c]}" for c in df.columns), ""])
