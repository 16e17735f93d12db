"""Helpers that several operators share: text columns, byte buffers, words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import stored

#: Text is worked on in slices of about so many bytes, so that memory follows
#: the slice (or the one longest text), not the size of an Arrow batch.
SLICE_BYTES = 2 << 20
#: A slice whose arrays, eight bytes for each of its own, fit into a core's cache.
CACHED_BYTES = 256 << 10
#: Few texts go to Python at a time; for ``stored``.
TEXT_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def text_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``; a null text is empty. Other columns go, whatever their names."""
    return docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"),
    )


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a range gets about, beyond the session's number of partitions.
ROWS_PER_RANGE = 1_000_000


def ranged(rows: DataFrame, order: list[str], rows_each: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows in order, each with its ``range`` and a number ``at`` that ascends by one within it.

    ``rows`` should come from a table: they are counted, sampled and read.
    """
    count = max(partitions_of(rows), rows.count() // rows_each + 1)
    spread = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    numbered = stored(spread.withColumn("at", F.monotonically_increasing_id()))
    return numbered.withColumn("range", F.shiftright("at", 33))


def range_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and range: its rows, its first ``at``, and as ``before`` the key's rows in the ranges before.

    A row is then number ``before + at - first`` of its key, if the order begins
    with the keys. There are no more rows than ranges and keys together.
    """
    counts = rows.groupBy(*keys, "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about ``limit`` bytes or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each text starts, with the end as last entry."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers whose bits all depend on all bits of the given ones."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_codes() -> np.ndarray:
    """A fixed 64-bit code for each byte value."""
    return mixed((np.arange(256, dtype=U64) + U64(1)) * U64(_BASE))


class Rolling:
    """Hashes of any stretches of a byte buffer.

    A stretch hashes to the sum of its byte codes times powers of an odd base.
    Prefix sums give that sum, and a power of the inverse makes it independent
    of the place.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._down = powers(_INVERSE, n + 1)
        self._sums = np.zeros(n + 1, U64)
        np.cumsum(byte_codes()[data] * powers(_BASE, n + 1)[:n], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all stretches of ``k`` bytes."""
        n = len(self._sums) - k
        return mixed((self._sums[k:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.empty(0, U64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1 modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(1 << n.bit_length(), base, U64)
        known[0] = 1
        known = np.cumprod(known, dtype=U64)
        if len(known) <= SLICE_BYTES * 4:  # tables for one very long text aren't kept
            _POWERS[base] = known
    return known[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and text numbers of the words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
    low = _LOWER[data]
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]  # a word ends with its text
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, Rolling(low).of(starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def windows_in_texts(owner: np.ndarray, size: int) -> np.ndarray:
    """Which positions start ``size`` entries of one owner."""
    if len(owner) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
