"""Intermediate tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as ``spark.checkpoint.dir`` names it.

    Only a local session may do without: it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="namesift-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


#: Spark's own setting: shuffle files of a query go when the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Write rows once and read them back.

    Later steps then neither repeat the work nor depend on shuffle files that
    go away with an executor, and they see real sizes and columns. The shuffle
    files that led to the table are not needed after that and are removed.
    ``settings`` hold for the session while the rows are written.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/namesift-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true", **(settings or {})}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    table = spark.read.schema(rows.schema).parquet(path)
    table.stored_at = path
    return table


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark reads, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again.

    Only for tables whose readers have themselves been stored: a result that
    still has to be computed needs them, also if an executor is lost.
    """
    for table in tables:
        delete_folder(table.sparkSession, table.stored_at)
