"""Dropping lines that many documents repeat.

A line's key is hashed, and the hashes, one row per document and key with the
places of its lines, are range-partitioned and sorted by hash and then by
document, the largest first. Streaming through a partition, the first document
of a hash is the one that keeps its lines; the next ones lose them once enough
documents have come. A hash that goes over the border of a partition can only be
judged with what lies beyond, so its rows are passed on and decided by counting
the documents of these few hashes. A hash that very many documents share so is
spread over partitions like any other.

The result is not text: each document gets a compressed bitmap of the lines that
stay.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import stored
from .common import partitions_of, slices, text_rows

#: Code points of a key, and documents that hold it, from which on its lines go.
LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3

HASHES = "h1 long, h2 long, doc long, class long, places binary"


def line_key(line: bytes) -> bytes:
    """White space at both ends removed, A-Z in lower case."""
    return line.strip().lower()


def _is_long(key: bytes) -> bool:
    return len(key) >= LEAST_LENGTH and (key.isascii() or len(key.decode()) >= LEAST_LENGTH)


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and key: the key's digest and the numbers of its lines."""
    for part in slices(batches):
        owner, digests, places = [], [], []
        for row, text in enumerate(part.column("text").to_pylist()):
            where: dict[bytes, list[int]] = {}
            for number, line in enumerate(text.encode().split(b"\n")):
                key = line_key(line)
                if _is_long(key):
                    where.setdefault(key, []).append(number)
            for key, numbers in where.items():
                owner.append(row)
                digests.append(hashlib.blake2b(key, digest_size=16).digest())
                places.append(np.array(numbers, "<u4").tobytes())
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(owner, pa.int64())
        yield pa.record_batch([
            pa.array(halves[:, 0]), pa.array(halves[:, 1]), part.column("doc").take(at), part.column("class").take(at), pa.array(places, pa.binary()),
        ], ["h1", "h2", "doc", "class", "places"])


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that lose their lines, and rows of a partition's first and last hash, which are ``open``.

    Only counts and the rows of at most ``LEAST_DOCUMENTS`` documents of the
    current hash are held.
    """
    key, first_key, keeper, documents, last_doc = None, None, None, 0, None
    held: list[tuple] = []  # rows that wait until enough documents have come
    out: list[tuple] = []

    def flush():
        nonlocal out
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.bool_()]
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h1", "h2", "doc", "class", "places", "open"])
        out = []
        return batch

    for batch in batches:
        h1, h2, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc"))
        # A hash with one row in the middle of a partition is alone: nothing to do.
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        lonely = np.ones(len(h1), bool)
        lonely[1:] &= ~same
        lonely[:-1] &= ~same
        if len(lonely):
            lonely[0] = lonely[-1] = False
        classes, places = batch.column("class"), batch.column("places")
        for i in np.flatnonzero(~lonely).tolist():
            now = (h1[i], h2[i])
            if now != key:
                first_key = first_key or now
                key, keeper, documents, last_doc, held = now, int(doc[i]), 0, None, []
            if doc[i] != last_doc:
                documents, last_doc = documents + 1, int(doc[i])
            row = (int(h1[i]), int(h2[i]), int(doc[i]), classes[i].as_py(), places[i].as_py())
            if key == first_key:
                out.append((*row, True))
            else:
                held.append(row)
                if documents >= LEAST_DOCUMENTS:
                    # Decided also if the hash goes on in the next partition: it began here.
                    out.extend((*r, False) for r in held if r[2] != keeper)
                    held = [r for r in held if r[2] == keeper]
            if len(out) >= 10_000:
                yield flush()
    if key is not None and key != first_key:
        # The end of the partition: what is left may go on in the next one.
        out.extend((*r, True) for r in held)
    yield flush()


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc, class, keep_bitmap`` of the documents that lose lines.

    ``doc`` is the id, ``class`` a hash of the text. The bitmap has a bit for
    each line, the first line's bit being the highest of the first byte, and is
    compressed by zlib; lines after its end stay.
    """
    rows = _identified(docs, id_column, text_column)
    hashed = rows.select("doc", "class", "text").mapInArrow(_hashes, HASHES)
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    ranged = hashed.repartitionByRange(4 * partitions_of(docs), *order).sortWithinPartitions(*order)
    streamed = stored(ranged.mapInArrow(_stream, f"{HASHES}, open boolean"))
    # At most two hashes for each partition.
    unsure = F.broadcast(stored(streamed.filter("open").select("h1", "h2").distinct()))
    # All rows of a hash that was cut, decided or not, tell how many documents have it.
    cut = streamed.join(unsure, ["h1", "h2"])
    totals = cut.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("_docs"), F.max("doc").alias("_keeper"))
    judged = cut.join(F.broadcast(totals), ["h1", "h2"]).filter((F.col("_docs") >= LEAST_DOCUMENTS) & (F.col("doc") != F.col("_keeper")))
    sure = streamed.join(unsure, ["h1", "h2"], "left_anti")
    dropped = sure.select("doc", "class", "places").union(judged.select("doc", "class", "places"))
    return dropped.groupBy("doc", "class").agg(F.collect_set("places").alias("places")).mapInArrow(
        _bitmaps, "doc long, class long, keep_bitmap binary"
    )


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column("places").to_pylist():
            gone = np.frombuffer(b"".join(places), "<u4")
            keep = np.ones(int(gone.max()) + 1, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(np.append(keep, np.ones(-len(keep) % 8, bool))).tobytes()))
        yield pa.record_batch([batch.column("doc"), batch.column("class"), pa.array(maps, pa.binary())], ["doc", "class", "keep_bitmap"])


def _identified(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    # Rows without id come before all others, so any other keeps its lines first.
    return text_rows(docs, id_column, text_column).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("class"), "text"
    )


def kept_lines(text: str, keep_bitmap: bytes | None) -> tuple[str, int, int]:
    """The text without the lines that the bitmap drops, its lines and the dropped ones."""
    lines = text.split("\n")
    if keep_bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), np.uint8))[: len(lines)]
    kept = [line for i, line in enumerate(lines) if i >= len(keep) or keep[i]]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = [kept_lines(t, b) for t, b in zip(part.column("text").to_pylist(), part.column("keep_bitmap").to_pylist(), strict=True)]
        yield pa.record_batch([
            part.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows]),
        ], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every row.

    Lines end at ``\\n``; a null or empty text is one empty line. A key of at
    least 20 code points that at least 3 ids hold goes everywhere but in the
    rows of the largest id. Rows that repeat an id count as one document. A row
    without id counts as smaller than all others. No rows in, no rows out.
    """
    rows = _identified(docs, id_column, text_column)
    marked = rows.join(keep_bitmaps(docs, id_column, text_column), ["doc", "class"], "left")
    return marked.select("doc_id", "text", "keep_bitmap").mapInArrow(
        _apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )
