"""Cleaning names of files as they arrive.

Name operations keep no state, so the same projections run on a stream.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.preview import preview_changes


def write_changes(files: DataFrame, operations: Iterable, path: str, checkpoint: str) -> StreamingQuery:
    """Append the changes of newly arriving files to a Parquet table.

    ``files`` is a streaming inventory with name and path. What is there is
    processed once, then the query stops.
    """
    return (
        preview_changes(files, operations)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
