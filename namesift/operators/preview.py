"""Previews of name changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import clean_names
from .ordering import with_sorted_index
from .skew import split_lookup


def altered_only(rows: DataFrame, original: str = "original", new: str = "new_name") -> DataFrame:
    """Rows whose new name differs."""
    return rows.filter(F.col(new) != F.col(original))


def preview_changes(files: DataFrame, operations: Iterable) -> DataFrame:
    """(original, new_name, path) of the files whose name would change."""
    cleaned = clean_names(files.select("name", "path"), operations)
    return altered_only(cleaned.select(F.col("name").alias("original"), "new_name", "path"))


def preview_table(files: DataFrame, operations: Iterable, selection: DataFrame | None = None) -> DataFrame:
    """All files by folder: index, whether selected, both names, whether altered.

    ``selection`` holds names, or names with their ``parent``.
    """
    indexed = with_sorted_index(files.select("parent", "name"), "parent", "name")
    cleaned = clean_names(indexed, operations)
    if selection is None:
        marked = cleaned.withColumn("selected", F.lit(False))
    else:
        keys = [c for c in ("parent", "name") if c in selection.columns]
        chosen = selection.select(*keys).distinct().withColumn("_chosen", F.lit(True))
        counts = files.groupBy(*keys).agg(F.count("*").alias("_rows"))
        # A name that very many files share is looked up in several tasks.
        looked_up = split_lookup(cleaned, chosen, keys, counts, "_rows", ["parent", "idx"], how="left")
        marked = looked_up.withColumn("selected", F.coalesce("_chosen", F.lit(False)))
    return marked.select(
        "parent", "idx", "selected",
        F.col("name").alias("current"),
        F.col("new_name").alias("new"),
        (F.col("new_name") != F.col("name")).alias("altered"),
    )


def preview_summary(table: DataFrame) -> DataFrame:
    """Totals of a preview table: files, altered, selected, both."""
    return table.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("altered")).alias("altered"),
        F.count_if(F.col("selected")).alias("selected"),
        F.count_if(F.col("selected") & F.col("altered")).alias("selected_altered"),
    )
