"""Stupid-backoff scores of documents under the counts of the whole corpus.

Documents are stored in chunks of some megabytes, as numbers of words in a
chunk's vocabulary. For each order, a chunk's different n-grams with their
counts are partitioned by hash into buckets, so that an n-gram has at most one
entry for each chunk however frequent it is. A bucket adds up its counts and
sends each chunk the totals of its n-grams, and joining these to the n-grams of
the chunk's documents gives the scores, which are summed per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import stored
from .common import TEXT_ROWS, U64, bytes_of, mixed, slices, text_rows, words_of
from .streams import runs

ORDER, BACKOFF = 3, 0.4
CHUNK_BYTES = 4 << 20
#: Text whose words are looked for at once.
WORDS_BYTES = 512 << 10
#: Entries that a bucket has on average.
BUCKET_ENTRIES = 1 << 20
#: Rows hold whole chunks, so few of them go to Python at a time.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
#: The same where rows are a chunk's part of a bucket.
MANY_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}

_FACTORS = mixed(np.arange(1, ORDER + 2, dtype=U64)) | U64(1)


def _packed(numbers: np.ndarray) -> bytes:
    """Mostly small numbers, byte by byte of all, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes(), 1)


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(width, -1).T).view(kind).ravel()


CHUNKS = "chunk long, ids array<long>, sizes binary, vocabulary binary, words binary, n long"


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId(), 0
    held: list[tuple[list, np.ndarray, np.ndarray]] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal made, held, size
        ids = [i for part in held for i in part[0]]
        sizes = np.concatenate([part[1] for part in held]).astype("<u4")
        vocabulary, words = np.unique(np.concatenate([part[2] for part in held]), return_inverse=True)
        made, held, size = made + 1, [], 0
        return pa.record_batch([
            pa.array([(task << 32) + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.tobytes()]),
            pa.array([vocabulary.tobytes()]), pa.array([_packed(words.astype("<u4"))]), pa.array([len(words)]),
        ], ["chunk", "ids", "sizes", "vocabulary", "words", "n"])

    for part in slices(batches, limit=WORDS_BYTES):
        data, offsets = bytes_of(part.column("text"))
        _, _, hashes, owner = words_of(data, offsets)
        held.append((part.column("doc_id").to_pylist(), np.bincount(owner, minlength=part.num_rows), hashes))
        size += len(data)
        if size >= CHUNK_BYTES:
            yield close()
    if held:
        yield close()


class _Chunk:
    """A stored chunk's words and n-grams. An n-gram stands at its last word."""

    def __init__(self, row: dict):
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.words = np.frombuffer(row["vocabulary"], U64)[_unpacked(row["words"], "<u4")]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams stand, and their hashes."""
        at = np.flatnonzero(self.place >= order - 1)
        hashes = np.full(len(at), U64(order))
        for j in range(order):
            hashes = hashes + self.words[at - j] * _FACTORS[j]
        return at, mixed(hashes)


def _entries(order: int, bits: int) -> Callable:
    """A chunk's different n-grams with their counts, a row for each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams, counts = np.unique(_Chunk(row).grams(order)[1], return_counts=True)
                bucket = (grams >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(grams) else np.empty(0, np.int64)
                ends = np.append(cuts[1:], len(grams))
                yield pa.record_batch([
                    pa.array(bucket[cuts]), pa.array(np.full(len(cuts), row["chunk"])),
                    pa.array([grams[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)], pa.binary()),
                    pa.array([counts[a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends, strict=False)], pa.binary()),
                ], ["bucket", "chunk", "grams", "counts"])

    return run


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk that came to a bucket, the totals of its n-grams in their order."""
    for group in runs(batches, ["bucket"]):
        grams = [np.frombuffer(g, U64) for g in group.column("grams").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in group.column("counts").to_pylist()])
        distinct, which = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(which, counts, len(distinct)).astype("<i8")[which]
        ends = np.cumsum([len(g) for g in grams])
        yield pa.record_batch([
            group.column("chunk"), group.column("bucket"), pa.array([_packed(t) for t in np.split(totals, ends[:-1])], pa.binary()),
        ], ["chunk", "bucket", "totals"])


def _scores(all_words: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row)
                n = len(chunk.words)
                others = (all_words - chunk.sizes)[chunk.owner].astype(float)
                score = np.full(n, np.nan)
                before = others  # how often the context of the order at hand stands in other documents
                for order in range(1, ORDER + 1):
                    parts = sorted((t["bucket"], t["totals"]) for t in row["totals"] if t["order"] == order)
                    totals = np.concatenate([np.empty(0, "<i8"), *(_unpacked(t, "<i8") for _, t in parts)])
                    at, grams = chunk.grams(order)
                    _, which = np.unique(grams, return_inverse=True)
                    _, own, times = np.unique(which + chunk.owner[at] * max(1, len(totals)), return_inverse=True, return_counts=True)
                    found = np.zeros(n)
                    found[at] = totals[which] - times[own]
                    seen = found > 0
                    if order == 1:
                        # A word that no other document has: one occurrence, one more step back.
                        score = np.log(np.where(seen, found, BACKOFF)) - np.log(np.maximum(others, 1))
                    else:
                        context = np.zeros(n)
                        context[1:] = before[:-1]
                        score = np.where(seen, np.log(np.where(seen, found, 1) / np.where(seen, context, 1)), score + np.where(chunk.place >= order - 1, np.log(BACKOFF), 0))
                    before = found
                count = len(chunk.sizes)
                yield pa.record_batch([
                    pa.array(row["ids"], pa.int64()), pa.array(chunk.sizes), pa.array(np.bincount(chunk.owner, score, count)),
                ], ["doc_id", "n_words", "log_score"])

    return run


def backoff_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, log_score, mean_score`` for every row.

    A word's score is the count of the n-gram that ends with it over the count
    of the n-gram's beginning, for the longest n up to ``ORDER`` that any other
    row holds, times ``BACKOFF`` for each step down from the longest n that fits
    into the document; a single word's count is taken over all words, and a word
    found nowhere else counts as one occurrence a further step down. Counts are
    those of the whole corpus without the row itself, so that copies vouch for
    each other. ``log_score`` sums natural logarithms; a row without words has 0,
    and a null ``mean_score``. Null ids and repeated rows are scored like others.
    No rows in, no rows out.
    """
    chunks = stored(text_rows(docs, id_column, text_column).mapInArrow(_chunks, CHUNKS), TEXT_ROWS)
    words = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(0, int(words / BUCKET_ENTRIES)).bit_length()
    totals = None
    for order in range(1, ORDER + 1):
        entries = chunks.mapInArrow(_entries(order, bits), "bucket long, chunk long, grams binary, counts binary")
        own = stored(
            entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_totals, "chunk long, bucket long, totals binary")
            .withColumn("order", F.lit(order)), MANY_ROWS,
        )
        totals = own if totals is None else totals.union(own)
    lists = totals.groupBy("chunk").agg(F.collect_list(F.struct("order", "bucket", "totals")).alias("totals"))
    scored = stored(
        chunks.join(lists, "chunk", "left").withColumn("totals", F.coalesce("totals", F.array().cast(lists.schema["totals"].dataType)))
        .mapInArrow(_scores(words), "doc_id long, n_words long, log_score double"), FEW_ROWS,
    )
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
