"""Numbering rows in sorted order without putting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Ranges that the rows are cut into, and sampled rows for each.
RANGES, SAMPLES_PER_RANGE = 256, 24


def _cuts(keyed: DataFrame) -> list[tuple]:
    """Ascending pairs of value and tie-breaker that cut the rows into about equal ranges.

    Rows are sampled, not values, so that a value with many rows is cut between
    its rows. The sample has ``RANGES * SAMPLES_PER_RANGE`` rows on average.
    """
    total = keyed.agg(F.count("*")).first()[0]
    if not total:
        return []
    share = min(1.0, RANGES * SAMPLES_PER_RANGE / total)
    sampled = keyed.filter(F.col("_value").isNotNull()).sample(share, seed=11)
    sample = [tuple(r) for r in sampled.select("_value", "_tie").orderBy("_value", "_tie").collect()]
    step = max(1, len(sample) // RANGES)
    return sample[step::step]


def _range_of(table: Column, count: int) -> Column:
    """How many cuts are at or below the row's pair, by binary search; null values come first."""
    strides = [1 << b for b in reversed(range(count.bit_length()))]
    if not strides:
        return F.lit(0)

    def step(at: Column, stride: Column) -> Column:
        cut = F.get(table, at + stride - 1)
        below = (cut["_value"] < F.col("_value")) | ((cut["_value"] == F.col("_value")) & (cut["_tie"] <= F.col("_tie")))
        return F.when(F.coalesce(below, F.lit(False)), at + stride).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in strides]), F.lit(0), step)


def with_sorted_index(rows: DataFrame, group: str, order: str, into: str = "idx") -> DataFrame:
    """Number the rows of each group from 1 in the order of a column.

    Rows are numbered within ranges of the order column and shifted by the
    number of rows in earlier ranges. A group may hold any share of the rows,
    and so may a value: its rows are told apart by a hash of all their columns.
    Null groups are a group, null values come first. The rows are stored first,
    so that a source that changes meanwhile is read once.
    """
    source = stored(rows)
    keyed = source.withColumns({"_value": F.col(order), "_tie": F.xxhash64(*source.columns), "_group": F.struct(group)})
    cuts = _cuts(keyed)
    kind = keyed.select("_value", "_tie").schema
    table = source.sparkSession.createDataFrame(cuts, kind).agg(F.sort_array(F.collect_list(F.struct("_value", "_tie"))))
    ranged = keyed.withColumn("_cuts", table.scalar()).withColumn("_range", _range_of(F.col("_cuts"), len(cuts))).drop("_cuts")
    earlier = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_group", "_range")
        .agg(F.count("*").alias("_rows"))
        .select("_group", "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_group", "_range").orderBy("_value", "_tie")
    return (
        ranged.withColumn("_number", F.row_number().over(within))
        .join(offsets, ["_group", "_range"])
        .select(*source.columns, (F.col("_offset") + F.col("_number")).cast("bigint").alias(into))
    )
