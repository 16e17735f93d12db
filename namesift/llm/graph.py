"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Each node ``u`` that isn't the smallest of its component, and the smallest as ``v``.

    ``edges`` has columns ``u`` and ``v``. Neighbours are hung on their smallest
    common neighbour, alternately the larger and the smaller ones, until nothing
    changes; that takes a number of rounds that grows with the logarithm of the
    size. Each round is a written table, so a lost executor costs no more than
    its tasks. Nodes with very many neighbours are counted before the shuffle,
    and the join that follows is one that Spark can split.
    """
    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # A forest of stars: no node hangs on two, and none that others hang on hangs itself.
        ends = now.select("u", F.lit(1).alias("hangs"), F.lit(False).alias("holds")).union(now.select("v", F.lit(0), F.lit(True)))
        if ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 or (hangs = 1 and holds)").isEmpty():
            return now
        now = stored(_small_star(_large_star(now)))
