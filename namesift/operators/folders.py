"""Folder lists and file counts of inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def child_folders(files: DataFrame, root: str, limit: int | None = None) -> DataFrame:
    """Folders right below ``root`` by name, and how many more there are than ``limit`` lets through.

    Without ``limit`` all are listed and none is left over. An inventory lists files, so folders without any do not show.
    """
    prefix = root.rstrip("/") + "/" if root else ""
    below = files.filter(F.startswith("path", F.lit(prefix))).select(
        F.substr("path", F.lit(len(prefix) + 1)).alias("rest")
    )
    folders = (
        below.filter(F.contains("rest", F.lit("/")))
        .select(F.substring_index("rest", "/", 1).alias("folder"))
        .distinct()
    )
    if limit is None:
        return folders.orderBy("folder").withColumn("more_folders", F.lit(0).cast("bigint"))
    more = F.greatest(folders.agg(F.count("*")).scalar() - limit, F.lit(0))
    return folders.orderBy("folder").limit(limit).withColumn("more_folders", more)


def inventory_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files per side of a comparison."""
    sides = left.select(F.lit("left").alias("side")).unionAll(right.select(F.lit("right").alias("side")))
    return sides.groupBy("side").agg(F.count("*").alias("files"))
