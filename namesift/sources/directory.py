"""Inventories of live directories.

A tree is listed in rounds. The folders that are still to be opened are a table;
a round deals them out to tasks, which list each folder and return files and
subfolders in Arrow batches, and the subfolders are the next round's table. So
the driver knows the root and nothing else, a folder is one row wherever it lies
in the tree, and how many tasks list at a time follows the number of folders,
not the tree's first levels.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.stored import stored
from .inventory import with_path_parts

#: Entries of a folder that are held at a time, and folders that one task gets about.
BATCH_ENTRIES, FOLDERS_PER_TASK = 10_000, 32

FOUND = pa.schema([("path", pa.string()), ("size", pa.int64())])


def _described(entry: os.DirEntry) -> tuple[str, int | None] | None:
    """A file with its size, a folder to open with none; links to folders and what can't be read are neither."""
    try:
        if entry.is_file():
            return entry.path, entry.stat().st_size
        if entry.is_dir(follow_symlinks=False):
            return entry.path, None
    except OSError:
        pass
    return None


def list_folder(path: str) -> Iterator[pa.RecordBatch]:
    """The files and folders in a folder, which may be of any size; nothing if it can't be opened.

    A size of null tells a folder.
    """
    held: list[tuple[str, int | None]] = []
    try:
        with os.scandir(path) as entries:
            for entry in entries:
                if (described := _described(entry)) is not None:
                    held.append(described)
                if len(held) == BATCH_ENTRIES:
                    yield _batch(held)
                    held = []
    except OSError:
        pass
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[str, int | None]]) -> pa.RecordBatch:
    paths, sizes = zip(*rows, strict=True)
    # Bytes of a name that are no UTF-8 are replaced; such a folder can't be opened by its path again.
    paths = [os.fsencode(p).decode("utf-8", "replace") for p in paths]
    return pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], FOUND)


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path"):
            yield from list_folder(path.as_py())


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, size`` of all files at or below a folder that all executors have mounted.

    As many rounds as the tree is deep, each a written table, so that a lost
    executor costs no more than the folders it was listing. Links to folders are
    not followed.
    """
    folders, found = spark.createDataFrame([(root,)], "path string"), None
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = 1
    while count:
        tasks = max(1, min(count, most, -(-count // FOLDERS_PER_TASK) + spark.sparkContext.defaultParallelism))
        entries = stored(folders.repartition(tasks, F.xxhash64("path")).mapInArrow(_listed, "path string, size long"))
        files = entries.filter("size is not null")
        found = files if found is None else found.unionAll(files)
        folders = entries.filter("size is null").select("path")
        count = folders.count()
    return found


class FolderReader(DataSourceReader):
    """Lists what lies directly in a folder, in one task that holds a batch at a time."""

    def __init__(self, options):
        self.root = os.path.normpath(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.root)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for batch in list_folder(partition.value):
            yield batch.filter(batch.column("size").is_valid())


class FolderSource(DataSource):
    """``spark.read.format("file_inventory").load(directory)``: the files directly in a mounted directory."""

    @classmethod
    def name(cls) -> str:
        return "file_inventory"

    def schema(self) -> str:
        return "path string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def scan_inventory(spark: SparkSession, directory: str, include_subdirs: bool = True) -> DataFrame:
    """All regular files at or below a directory; a bad directory has none.

    With subdirectories the tree is listed right away.
    """
    root = os.path.normpath(directory)
    if include_subdirs:
        files = list_tree(spark, root)
    else:
        spark.dataSource.register(FolderSource)
        files = spark.read.format("file_inventory").load(root)
    return with_path_parts(files, root)


def scan_names(spark: SparkSession, directory: str) -> DataFrame:
    """Files directly in a directory, for cleaning."""
    return scan_inventory(spark, directory, include_subdirs=False)
