"""Path and name functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """What follows the last / or \\."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder(path: Column) -> Column:
    """The path up to and with its last slash of either kind; empty if it has none."""
    return F.regexp_extract(path, r"^(.*[/\\])?", 0)


def root_name(path: Column) -> Column:
    """The base name before its last dot."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The base name's last dot and what follows; empty without a dot."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def relative_path(path: Column, root: Column) -> Column:
    """``path`` without a leading ``root``; unchanged elsewhere."""
    return F.when(path.startswith(root), F.regexp_replace(F.substr(path, F.length(root) + 1), r"^[/\\]+", "")).otherwise(path)


def safe_name(name: Column) -> Column:
    """Characters that file names can't hold become underscores."""
    return F.regexp_replace(name, r"[\x00-\x1F\"<>|:*?/\\]", "_")


def shortened(name: Column, most: int) -> Column:
    """Names over ``most`` characters keep their end behind an ellipsis."""
    return F.when(F.length(name) > most, F.concat(F.lit("..."), F.expr("''") if most <= 3 else F.substring(name, -(most - 3), most - 3))).otherwise(name)


def stack_index(image: Column) -> Column:
    """The number before the @ of ``index@stack``; null without one."""
    return F.regexp_extract(image, r"^0*(\d+)@", 1).try_cast("int")


def stack_path(image: Column) -> Column:
    """What follows the @ of ``index@stack``."""
    return F.regexp_replace(image, r"^\d+@", "")


def stack_name(index: Column, path: Column) -> Column:
    """``index@stack`` with seven digits."""
    return F.format_string("%07d@%s", index.cast("int"), path)


def split_suffixes(text: Column) -> Column:
    """Entries between commas, semicolons and bars, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")
