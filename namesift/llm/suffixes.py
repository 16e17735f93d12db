"""Removing repeated passages by suffix arrays.

Whether a stretch of ``LENGTH`` bytes occurs in an earlier document is decided
by sorting suffixes. Suffixes that can share such a stretch are brought together
first: each stretch has an anchor, its ``GRAM``-byte substring with the smallest
hash, which depends on the stretch alone. Anchors that only one text has are
dropped. For the others, consecutive stretches with one anchor make a piece of
text, and the pieces of an anchor go to one bucket. Equal pieces are one, with
its smallest document. A bucket's pieces, one after another, are a string whose
suffix array (:mod:`gsaca`) puts equal stretches side by side.

A bucket with more than ``BUCKET`` different pieces is cut in four by how far
from the anchor its stretches begin, and each part by the longer substring its
stretches have in common, as often as needed; at the last level a bucket is a
single stretch. So no bucket is large and no occurrence is left out. All this
works on different pieces; how often and where each occurs is looked up once, in
the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stored import release, stored
from .common import CACHED_BYTES, Rolling, TEXT_ROWS, U64, bytes_of, mixed, slices
from .gsaca import suffix_arrays
from .streams import runs

LENGTH, GRAM = 50, 20
#: Offsets that an anchor can have in a stretch.
OFFSETS = LENGTH - GRAM + 1
#: Different pieces that one suffix array takes, and up to which numbers its string is of similar length.
BUCKET, FEW = 16, (3,)
#: Bytes of pieces worked on at a time.
BATCH_BYTES = 2 << 20
#: Anchors with their classes in a bucket on average, and in a chunk that is dealt out to buckets.
BUCKET_ENTRIES, CHUNK_ENTRIES = 1 << 20, 1 << 19
#: Texts, or a chunk's parts of a bucket, that go to Python at a time.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}
#: The bits of a hash that decide which is smallest.
UPPER = U64(0xFFFFFFFF00000000)


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of texts: text number, first byte, number of stretches, anchor's place and hash.

    The upper halves of hashes are compared; of equal ones in a stretch the
    leftmost counts.
    """
    grams = Rolling(data).grams(GRAM)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.empty(0, U64 if i == 4 else np.int64) for i in range(5))
    # The upper half of a hash with its place below: one minimum finds both.
    least = grams & UPPER
    least |= np.arange(len(grams), dtype=U64)
    width = 1
    while width < OFFSETS:
        step = min(width, OFFSETS - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    where = least.astype(np.uint32)
    inside = np.ones(n, bool)  # stretches that end with their text
    late = offsets[1:, None] - np.arange(1, LENGTH)
    inside[late[(late >= 0) & (late < n)]] = False
    change = where[1:] != where[:-1]
    first = np.flatnonzero(np.append(True, change | ~inside[:-1]) & inside)
    last = np.flatnonzero(np.append(change | ~inside[1:], True) & inside)
    where = where[first].astype(np.int64)
    return np.searchsorted(offsets, first, side="right") - 1, first, last - first + 1, where, grams[where]


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)])


def _by_class(anchor: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of anchor and text class, sorted by class."""
    order = np.lexsort((anchor, of))
    anchor, of = anchor[order], of[order]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]))[: len(of)]
    return anchor[new], of[new]


def _held_by_several(anchor: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sorted anchors: which entries' anchors have several classes, and each anchor's first entry, least and greatest class."""
    first = _starts(anchor)
    least, most = np.minimum.reduceat(of, first), np.maximum.reduceat(of, first)
    return np.repeat(least != most, np.diff(np.append(first, len(anchor)))), first, least, most


def _packed(anchor: np.ndarray, of: np.ndarray, bits: int) -> pa.RecordBatch:
    """Entries of anchor and class for the buckets.

    A bucket of an anchor gets the least and the greatest class that have it
    here. Where these differ, all classes here are known to share the anchor;
    such entries go to buckets of their classes, which come after the others.
    """
    order = np.argsort(anchor)
    anchor, of = anchor[order], of[order]
    several, first, least, most = _held_by_several(anchor, of)
    known, known_of = _by_class(anchor[several], of[several])
    both = least != most
    anchor, of = np.concatenate((anchor[first], anchor[first][both], known)), np.concatenate((least, most[both], known_of))
    # Anchors are least in their upper bits, so the lower ones tell the bucket.
    bucket = np.append(anchor[: len(anchor) - len(known)], known_of.view(U64)) & U64((1 << bits) - 1)
    bucket[len(anchor) - len(known) :] += U64(1 << bits)
    bucket = bucket.astype(np.uint16 if bits < 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, anchor, of = bucket[order], anchor[order], of[order]
    cuts = _starts(bucket)
    ends = np.append(cuts[1:], len(bucket))
    return pa.record_batch([
        pa.array(bucket[cuts].astype(np.int64)), *[pa.array([x[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()) for x in (anchor, of)],
    ], ["bucket", "anchors", "classes"])


def _anchors(bits: int) -> Callable:
    """Anchors and the text classes that have them: a packed row for each bucket of a chunk of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for part in slices(batches, limit=CACHED_BYTES):
            owner, _, _, _, anchor = anchored(*bytes_of(part.column("text")))
            if len(anchor):
                held.append((anchor, part.column("class").to_numpy(zero_copy_only=False)[owner]))
            if sum(len(a) for a, _ in held) >= CHUNK_ENTRIES:
                yield _packed(*map(np.concatenate, zip(*held, strict=True)), bits)
                held = []
        if held:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)), bits)

    return run


def _entries(group: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The anchors and classes of packed rows."""
    return tuple(np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("anchors", U64), ("classes", np.int64)))


def _lists(anchor: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """A row for each class, with its different anchors."""
    anchor, of = _by_class(anchor, of)
    first = _starts(of)
    ends = np.append(first, len(of)).astype(np.int32)
    return pa.record_batch([pa.array(of[first]), pa.ListArray.from_arrays(pa.array(ends), pa.array(anchor.view(np.int64)))], ["class", "anchors"])


def _shared(bits: int) -> Callable:
    """For each bucket and text class, the anchors that another class has too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["bucket"]):
            anchor, of = _entries(group)
            if group.column("bucket")[0].as_py() < 1 << bits:
                order = np.argsort(anchor)
                anchor, of = anchor[order], of[order]
                several = _held_by_several(anchor, of)[0]
                anchor, of = anchor[several], of[several]
            yield _lists(anchor, of)

    return run


def _parted(bits: int) -> Callable:
    """What ``_shared`` finds, with the classes in as many parts as there are buckets: a packed row for each bucket and part."""

    def parted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _shared(bits)(batches):
            if not found.num_rows:
                continue
            of = found.column("class").to_numpy()
            found = found.take(pa.array(np.argsort(of.view(U64) & U64((1 << bits) - 1), kind="stable")))
            of, lists = found.column("class").to_numpy(), found.column("anchors")
            part = (of.view(U64) & U64((1 << bits) - 1)).astype(np.int64)
            cuts = _starts(part)
            at = lists.offsets.to_numpy()
            anchor, of = lists.flatten().to_numpy(), np.repeat(of, np.diff(at))
            bounds = list(zip(at[cuts], at[np.append(cuts[1:], len(part))], strict=True))
            yield pa.record_batch([pa.array(part[cuts]), *[pa.array([x[i:j].tobytes() for i, j in bounds], pa.binary()) for x in (anchor, of)]], ["part", "anchors", "classes"])

    return parted


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text class, its anchors from all buckets."""
    for group in runs(batches, ["part"]):
        yield _lists(*_entries(group))


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The stretches of a byte buffer as an array of binaries."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each text whose anchors are among the row's ``anchors``."""
    for part in slices(batches, limit=CACHED_BYTES):
        data, offsets = bytes_of(part.column("text"))
        owner, start, count, where, anchor = anchored(data, offsets)
        lists = part.column("anchors")
        sizes = np.diff(lists.offsets.to_numpy())
        shared = mixed(lists.flatten().to_numpy().view(np.uint64) ^ mixed(np.repeat(np.arange(len(lists)), sizes).astype(U64)))
        kept = np.isin(mixed(anchor ^ mixed(owner.astype(U64))), shared)
        owner, start, count, where, anchor = (a[kept] for a in (owner, start, count, where, anchor))
        yield pa.record_batch([
            pa.array(anchor.view(np.int64)), part.column("doc").take(pa.array(owner)), part.column("class").take(pa.array(owner)),
            pa.array(start - offsets[owner]), pa.array((where - start).astype(np.int32)), _gather(data, start, count + LENGTH - 1),
        ], ["key", "doc", "class", "start", "reach", "piece"])


OCCURRENCES = "key long, doc long, class long, start long, reach int, piece binary"


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, limit: int, column: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut anew so that no key is in two and about ``limit`` bytes are in each."""
    held: list[pa.RecordBatch] = []
    for part in slices(batches, column=column, limit=limit):
        keys = part.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() == keys[0] == keys[-1]:
            held.append(part)
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if held or cut:
            yield pa.Table.from_batches([*held, part.slice(0, cut)]).combine_chunks().to_batches()[0]
        held = [part.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _least_documents(data: np.ndarray, bounds: np.ndarray, group: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of pieces in groups: its piece, and the smallest document that holds it."""
    sizes = np.diff(bounds)
    # A group's pieces, each closed by 1, and 0 as the end; bytes count from 2.
    last = np.append(group[1:] != group[:-1], True)
    widths = sizes + 1 + last
    ends = np.cumsum(widths)
    starts = ends - widths
    codes = np.zeros(int(ends[-1]), np.int16)
    codes[np.repeat(starts - bounds[:-1], sizes) + np.arange(len(data))] = data.astype(np.int16) + 2
    codes[starts + sizes] = 1
    first_of_group = np.append(True, group[1:] != group[:-1])
    order = suffix_arrays(codes, np.append(starts[first_of_group], ends[-1]))
    piece = np.repeat(np.arange(len(sizes)), widths)
    whole = np.arange(len(codes)) + LENGTH <= (starts + sizes)[piece]
    order = order[whole[order]]
    same = group[piece[order[1:]]] == group[piece[order[:-1]]]
    stretches = np.lib.stride_tricks.sliding_window_view(codes, LENGTH) if len(codes) >= LENGTH else codes[:, None]
    at = np.flatnonzero(same)
    for part in np.array_split(at, 1 + len(at) // 20_000):
        same[part] = (stretches[order[1:][part]] == stretches[order[:-1][part]]).all(axis=1)
    run = np.concatenate(([0], np.cumsum(~same)))
    least = np.minimum.reduceat(lows[piece[order]], np.flatnonzero(np.append(True, ~same)))[run]
    back = np.argsort(order)
    return piece[order][back], least[back]


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each different piece, the ranges of its stretches that an earlier document holds."""
    for part in whole_groups(batches, "key", BATCH_BYTES, "piece"):
        data, bounds = bytes_of(part.column("piece"))
        key, lows, highs = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "first", "last"))
        group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        count = np.bincount(group)[group]
        alone = count == 1
        # A piece without others has no suffixes to compare: all its stretches are in its documents.
        piece, begin, end, least = [np.flatnonzero(alone)], [np.zeros(int(alone.sum()), np.int64)], [np.diff(bounds)[alone] - LENGTH + 1], [lows[alone]]
        # Strings of similar length take their turns together.
        for low, high in zip((1, *FEW), (*FEW, len(count)), strict=True):
            chosen = np.flatnonzero((count > low) & (count <= high))
            if not chosen.size:
                continue
            sizes = np.diff(bounds)[chosen]
            inner = np.concatenate(([0], np.cumsum(sizes)))
            some = data[np.repeat(bounds[chosen] - inner[:-1], sizes) + np.arange(inner[-1])]
            of, found = _least_documents(some, inner, group[chosen], lows[chosen])
            new = np.append(True, (of[1:] != of[:-1]) | (found[1:] != found[:-1]))
            first = np.flatnonzero(new)
            begins = np.arange(len(of)) - np.searchsorted(of, of)
            piece.append(chosen[of[first]])
            begin.append(begins[first])
            end.append(begins[np.append(first[1:], len(of)) - 1] + 1)
            least.append(found[first])
        piece, begin, end, least = (np.concatenate(x) for x in (piece, begin, end, least))
        useful = least < highs[piece]
        piece, begin, end, least = piece[useful], begin[useful], end[useful], least[useful]
        at = pa.array(piece)
        yield pa.record_batch([part.column("key").take(at), part.column("digest").take(at), pa.array(begin), pa.array(end), pa.array(least)], ["key", "digest", "begin", "end", "least"])


def _quartered(pieces: DataFrame) -> DataFrame:
    """The stretches of each piece in four parts, by how far before the anchor they begin, with keys of their longer common part.

    ``low`` to ``high - 1`` bytes before the anchor begin the stretches of a
    bucket. ``whole, of, offset`` tell which piece a part is from, and where.
    """
    edges = [(F.col("low") + F.floor((F.col("high") - F.col("low")) * i / 4)).cast("int") for i in range(5)]
    stretches = F.octet_length("piece") - (LENGTH - 1)
    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        begin = F.greatest(F.lit(0), F.col("reach") - high + 1)
        count = F.least(stretches, F.col("reach") - low + 1) - begin
        cut = pieces.select("key", "digest", "first", "last", "reach", "piece", begin.alias("begin"), count.alias("count"), low.alias("low"), high.alias("high")).filter("count > 0 and high > low")
        common = F.expr(f"substring(piece, reach - low + 1, {LENGTH + 1} - high + low)")
        parts.append(cut.select(
            F.col("key").alias("whole"), F.col("digest").alias("of"), F.col("begin").cast("long").alias("offset"),
            F.xxhash64("key", "low", "high", common).alias("key"), F.expr(f"substring(piece, begin + 1, count + {LENGTH - 1})").alias("piece"),
            "first", "last", (F.col("reach") - F.col("begin")).alias("reach"), "low", "high",
        ))
    return reduce(DataFrame.union, parts)


def _distinct(pieces: DataFrame) -> DataFrame:
    """Each different piece of a bucket once, with its smallest and largest document."""
    return stored(pieces.groupBy("key", "piece").agg(
        F.xxhash64("piece").alias("digest"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.min(c).alias(c) for c in ("reach", "low", "high")],
    ))


RANGES = "key long, digest long, begin long, end long, least long"


def ranges(pieces: DataFrame) -> DataFrame:
    """``key, digest, begin, end, least``: stretches of a different piece, and the smallest document that holds them.

    Only those that some document with the piece has to give up. A bucket of one
    piece has all its stretches in that piece's documents, small buckets are
    solved, and large ones are quartered: their parts, each different one once,
    are buckets of their own, whose ranges are then put back at their places.
    With ``OFFSETS`` places for the anchor that ends after three turns.
    """
    counts = stored(pieces.groupBy("key").agg(
        F.count("*").alias("n"), F.min("digest").alias("digest"), F.min("first").alias("least"), F.max("last").alias("last"), F.max(F.octet_length("piece")).alias("bytes"),
    ))
    alone = counts.filter("n = 1 and least < last").select(
        "key", "digest", F.lit(0).cast("long").alias("begin"), (F.col("bytes") - (LENGTH - 1)).cast("long").alias("end"), "least"
    )
    several = stored(pieces.join(counts.filter("n > 1").select("key", "n"), "key"))
    small = several.filter(F.col("n") <= BUCKET).select("key", "digest", "piece", "first", "last")
    solved = small.repartition("key").sortWithinPartitions("key").mapInArrow(_solve, RANGES)
    large = several.filter(F.col("n") > BUCKET)
    if large.isEmpty():
        found = stored(alone.union(solved))
        release(pieces, counts, several)
        return found
    parts = stored(_quartered(large))
    below = ranges(_distinct(parts))
    places = parts.select("key", F.xxhash64("piece").alias("digest"), "whole", "of", "offset", "last")
    back = below.join(places, ["key", "digest"]).filter("least < last").select(
        F.col("whole").alias("key"), F.col("of").alias("digest"), (F.col("offset") + F.col("begin")).alias("begin"), (F.col("offset") + F.col("end")).alias("end"), "least"
    )
    found = stored(alone.union(solved).union(back))
    release(pieces, counts, several, parts, below)
    return found


def repeated_stretches(occurrences: DataFrame) -> DataFrame:
    """``doc, class, begin, end``: bytes of a document in stretches that an earlier one holds."""
    at_once = occurrences.select("key", "piece", F.col("doc").alias("first"), F.col("doc").alias("last"), "reach", F.lit(0).alias("low"), F.lit(OFFSETS).alias("high"))
    found = ranges(_distinct(at_once))
    places = occurrences.select("key", F.xxhash64("piece").alias("digest"), "doc", "class", "start")
    return places.join(found, ["key", "digest"]).filter("least < doc").select(
        "doc", "class", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end") + (LENGTH - 1)).alias("end")
    )


def _kept(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the union of spans, the bytes removed and the number of maximal runs."""
    if not len(spans):
        return text, 0, 0
    edges = np.zeros(len(text) + 1, np.int64)
    np.add.at(edges, spans[:, 0], 1)
    np.add.at(edges, spans[:, 1], -1)
    gone = np.cumsum(edges)[:-1] > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _cut(text: str, spans: pa.Scalar, copy: bool) -> tuple[bytes, int, int, int]:
    """What is kept, the bytes removed, the runs removed and all bytes."""
    raw = text.encode()
    if copy:
        return b"", len(raw), 1, len(raw)
    table = np.empty((0, 2), np.int64)
    if spans.is_valid:
        table = np.column_stack([f.to_numpy() for f in spans.values.flatten()])
    return (*_kept(raw, table), len(raw))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = [_cut(*r) for r in zip(part.column("text").to_pylist(), part.column("spans"), part.column("copy").to_pylist(), strict=True)]
        yield pa.record_batch([
            part.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in (3, 1, 2)),
            pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows]),
        ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


@F.arrow_udf(T.StringType())
def kept_text(text: pa.Array, spans: pa.Array, copy: pa.Array) -> pa.Array:
    """Each text without its spans; a character that is cut goes whole."""
    return pa.array([_cut(*r)[0].decode("utf-8", "ignore") for r in zip(text.to_pylist(), spans, copy.to_pylist(), strict=True)], pa.string())


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``row`` with all columns, ``doc_id``, ``text``, and ``doc`` and two hashes of the text to join by."""
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    key = docs[id_column].cast("long")
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("doc_id"),
        F.coalesce(key, F.lit((1 << 63) - 1)).alias("doc"),  # rows without id come after all others
        F.xxhash64(text).alias("class"), F.xxhash64(F.lit(1), text).alias("class2"), text.alias("text"),
    )


def _with_spans(rows: DataFrame) -> DataFrame:
    """The rows with ``spans`` to remove, and ``copy`` if all of the text goes."""
    long_rows = rows.filter(F.octet_length("text") >= LENGTH)
    # Equal texts are one: its first document is looked at, the others go whole.
    firsts = stored(long_rows.groupBy("class", "class2").agg(F.min("doc").alias("first"), F.sum(F.octet_length("text")).alias("bytes")))
    # One anchor for about every (OFFSETS + 1) / 2 bytes.
    entries = (firsts.agg(F.sum("bytes")).first()[0] or 0) * 2 // (OFFSETS + 1)
    bits = (entries // BUCKET_ENTRIES).bit_length()
    packed = long_rows.select("class", "text").mapInArrow(_anchors(bits), "bucket long, anchors binary, classes binary")
    parts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_parted(bits), "part long, anchors binary, classes binary")
    shared = stored(parts.repartition("part").sortWithinPartitions("part").mapInArrow(_gathered, "class long, anchors array<long>"), FEW_ROWS)
    wanted = firsts.join(shared, "class").select(F.col("first").alias("doc"), "class", "class2", "anchors")
    once = long_rows.select("doc", "class", "class2", "text").join(wanted, ["doc", "class", "class2"])
    occurrences = stored(once.select("doc", "class", "text", "anchors").mapInArrow(_pieces, OCCURRENCES), TEXT_ROWS)
    release(shared)
    spans = stored(
        repeated_stretches(occurrences).groupBy("doc", "class").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    )
    release(occurrences)
    later = long_rows.select("doc", "class", "class2").join(firsts, ["class", "class2"]).filter("doc > first")
    copies = stored(later.select("doc", "class", F.lit(True).alias("copy")).distinct())
    marked = rows.join(spans, ["doc", "class"], "left").join(copies, ["doc", "class"], "left")
    return marked.withColumn("copy", F.coalesce("copy", F.lit(False)))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    A byte is removed if a stretch of ``LENGTH`` bytes over it also occurs in a
    document with a smaller id; stretches are bytes of UTF-8 and stay within a
    document. Rows without id come after all others, and rows that repeat an id
    never count as earlier than one another. A null text is empty, and texts
    shorter than a stretch stay. No rows in, no rows out.
    """
    marked = _with_spans(_keyed(docs, id_column, text_column).drop("row"))
    return marked.select("doc_id", "text", "copy", "spans").mapInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows and columns, with the text as ``remove_repeats`` leaves it; a character that is cut goes whole."""
    marked = _with_spans(_keyed(docs, id_column, text_column))
    cut = F.when(F.col("copy") | F.col("spans").isNotNull(), kept_text("text", "spans", "copy"))
    changed = marked.select("row", cut.alias("_cut"))
    return changed.select(*[
        F.coalesce("_cut", F.col("row")[c]).alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns
    ])
