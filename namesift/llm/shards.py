"""Shards by jump consistent hashing.

A key walks up a chain of shard numbers: from shard ``b`` it jumps to
``floor((b + 1) / u)``, with ``u`` drawn from a generator that the key seeds.
The last number below the shard count is its shard. With one more shard a key
either stays or moves to the new one, and no table of shards is kept.

The chain rises at each step, so it is over after as many steps as there are
shards. The generator is a 64-bit linear congruential one, computed in decimals
because it wraps around.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stored import stored
from .common import range_starts, ranged, text_rows

#: Fixed values of the published method.
MULTIPLIER, MODULUS, SHIFT, TOP = 2862933555777941757, 1 << 64, 1 << 33, 1 << 31

#: Rows that one task numbers about, beyond the session's number of partitions.
ROWS_PER_TASK = 1_000_000


def jump(key: Column, shards: int) -> Column:
    """A struct of the shard of ``key`` among ``shards`` and, as ``grown``, among one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    wide = "decimal(20,0)"
    seed = (key.cast(wide) + F.lit(Decimal(MODULUS)).cast(wide)) % F.lit(Decimal(MODULUS)).cast(wide)
    start = F.struct(
        F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"),
        F.lit(0).cast("long").alias("at"), seed.cast(wide).alias("state"),
    )

    def step(s: Column, _: Column) -> Column:
        state = ((s["state"] * F.lit(Decimal(MULTIPLIER)) + F.lit(Decimal(1))) % F.lit(Decimal(MODULUS)).cast(wide)).cast(wide)
        draw = F.floor(state / F.lit(Decimal(SHIFT))).cast("long")
        after = F.floor((s["at"] + 1).cast("double") * (F.lit(float(TOP)) / (draw + 1).cast("double"))).cast("long")
        moved = F.struct(
            F.when(s["at"] < shards, s["at"]).otherwise(s["shard"]).alias("shard"),
            s["at"].alias("grown"), after.alias("at"), state.alias("state"),
        )
        return F.when(s["at"] <= shards, moved).otherwise(s)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(shards)), start, step,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")),
    )


def shard_rows(docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with its shard and its slot there, by law ``key``.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. The id
    and the number of shards alone decide the shard; rows without an id go where
    key -1 goes. A null text has size 8. Slots number the rows of a shard from 0
    without gaps, in the order of their ids, null ids first; equal rows get
    neighbouring slots. No rows in, no rows out.

    Slots are not counted over a whole shard in one task: the rows are sorted
    into ranges, numbered inside them, and moved up by the shard's rows in the
    ranges before. The plan doesn't grow with the table.
    """
    rows = text_rows(docs, id_column, text_column)
    placed = rows.select(
        "doc_id", F.octet_length("text").cast("long").alias("_bytes"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        jump(F.coalesce("doc_id", F.lit(-1)), shards).alias("_to"),
    ).select("doc_id", "_bytes", "text_crc32", "_to.shard", F.col("_to.grown").alias("grown_shard"))
    numbered = ranged(stored(placed), ["shard", "doc_id", "_bytes", "text_crc32"], ROWS_PER_TASK)
    starts = range_starts(numbered, ["shard"]).drop("rows")
    return numbered.join(starts, ["shard", "range"]).select(
        "doc_id", (F.col("_bytes") + 8).alias("size"), "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.col("at") - F.col("first")).cast("long").alias("slot"), "grown_shard",
    )
