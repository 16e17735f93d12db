"""Splitting hot join keys.

A key that holds a large share of the rows would land in one task. The helpers
here count rows per key first and split the hot keys over several tasks. Without
a hot key the join is a plain one. No row is dropped.

How far a key is cut depends on its rows, or on the pairs it makes, alone and
not on its share of the table: a task gets no more with more data. The list of
hot keys is a stored table that is joined like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

#: Rows of a key that one task looks up, and rows of each side that meet in one task.
ROWS_PER_SHARE, ROWS_PER_SIDE = 100_000, 2_000


def hot_keys(counts: DataFrame, keys: list[str], count: str, min_rows: int, splits: str = "_splits") -> DataFrame | None:
    """Keys with more than ``min_rows`` rows and the number of shares to cut each into; None without any.

    ``counts`` has one row per key. Runs a job, so ``counts`` should come from
    a table.
    """
    hot = stored(
        counts.select(*keys, F.ceil(F.col(count) / float(min_rows)).cast("int").alias(splits)).filter(F.col(splits) > 1)
    )
    return None if hot.isEmpty() else hot


def _row_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("_rows"))


def _share(spread_by: list[str], splits: str) -> Column:
    # A hash, not a random number: a task that runs again sends each row to
    # the same place.
    return F.pmod(F.xxhash64(*spread_by), F.coalesce(splits, F.lit(1))).cast("int")


def _every_share(splits: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(splits, F.lit(1)) - 1))


def split_lookup(
    rows: DataFrame,
    other: DataFrame,
    keys: list[str],
    counts: DataFrame,
    count: str,
    spread_by: list[str],
    min_rows: int = ROWS_PER_SHARE,
    how: str = "inner",
) -> DataFrame:
    """Join of ``rows`` to ``other`` where ``rows`` may have hot keys: ``inner``, ``left`` or ``left_semi``.

    ``counts`` tells how many rows each key has at most. Rows of a hot key are
    spread by the columns ``spread_by``, and what ``other`` holds for it is
    repeated for each share.
    """
    hot = hot_keys(counts, keys, count, min_rows)
    if hot is None:
        return rows.join(other, keys, how)
    spread = rows.join(hot, keys, "left").withColumn("_share", _share(spread_by, "_splits"))
    repeated = other.join(hot, keys, "left").withColumn("_share", _every_share("_splits"))
    return spread.drop("_splits").join(repeated.drop("_splits"), [*keys, "_share"], how).drop("_share")


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_spread: list[str],
    right_spread: list[str],
    min_rows: int = ROWS_PER_SIDE,
    left_counts: DataFrame | None = None,
    right_counts: DataFrame | None = None,
    always_spread: bool = True,
) -> DataFrame:
    """Inner join in which both sides may have hot keys.

    The pairs of a hot key form a grid: each side is cut into shares and every
    share of one meets every share of the other in a task of its own. Columns
    other than the keys must differ between the sides. ``left_counts`` and
    ``right_counts`` have the keys and ``_rows``, where these are known; without
    ``always_spread`` a join that has no hot key is left to Spark.
    """
    cell = float(min_rows) ** 2
    l = (_row_counts(left, keys) if left_counts is None else left_counts).withColumnRenamed("_rows", "_l")
    r = (_row_counts(right, keys) if right_counts is None else right_counts).withColumnRenamed("_rows", "_r")
    shares = [
        F.ceil(F.col(own) * F.least(F.col(far), F.lit(min_rows)) / cell).cast("int").alias(name)
        for own, far, name in (("_l", "_r", "_ls"), ("_r", "_l", "_rs"))
    ]
    hot = stored(l.join(r, keys).select(*keys, *shares).filter("_ls > 1 or _rs > 1"))
    if hot.isEmpty():
        if not always_spread:
            return left.join(right, keys)
    else:
        left = left.join(hot, keys, "left").withColumn("_lshare", _share(left_spread, "_ls"))
        left = left.withColumn("_rshare", _every_share("_rs")).drop("_ls", "_rs")
        right = right.join(hot, keys, "left").withColumn("_rshare", _share(right_spread, "_rs"))
        right = right.withColumn("_lshare", _every_share("_ls")).drop("_ls", "_rs")
        keys = [*keys, "_lshare", "_rshare"]
    # The work grows with the pairs, not with the rows. Spreading the rows by key
    # keeps few bytes with many pairs from being packed into one task.
    return spread_rows(left, keys).join(right, keys).drop("_lshare", "_rshare")


def spread_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows hashed over the session's number of shuffle partitions."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *by)
