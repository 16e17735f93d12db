"""Inventories from tables of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import base_name, extension

INVENTORY_COLUMNS = ["root", "parent", "path", "relative_path", "name", "size", "extension"]


def with_path_parts(files: DataFrame, root: str = "") -> DataFrame:
    """Inventory columns from ``path`` and ``size``; paths start with ``root``.

    ``parent`` ends in a slash, so that parent and name make up the path.
    """
    prefix = root.rstrip("/") + "/" if root else ""
    name = base_name(F.col("path"))
    return files.select(
        F.lit(root).alias("root"),
        F.left("path", F.length("path") - F.length(name)).alias("parent"),
        "path",
        F.substr("path", F.lit(len(prefix) + 1)).alias("relative_path"),
        name.alias("name"),
        "size",
        F.lower(extension(name)).alias("extension"),
    )


def scan_table(files: DataFrame, root: str = "", include_subdirs: bool = True) -> DataFrame:
    """Files of a path table at or below ``root``, or directly in it."""
    prefix = root.rstrip("/") + "/" if root else ""
    rest = F.substr("path", F.lit(len(prefix) + 1))
    found = files.filter(F.startswith("path", F.lit(prefix))) if prefix else files
    if not include_subdirs:
        found = found.filter(~F.contains(rest, F.lit("/")))
    return with_path_parts(found, root)
