"""Byte-level BPE of whole texts, to ids and back.

Texts are cut into the pieces that the tokenizer's pattern defines, by comparing
the classes of neighbouring characters in one array. Each distinct piece is
encoded once per Python worker, by the library's own merge model, and its ids
are looked up by a 64-bit hash from then on.

A long piece that the pattern does not split is encoded as a tree: its halves
are encoded on their own, and around the join growing windows are encoded again
until the window begins with the left side's id and ends with the right side's
id at that place. All neighbouring ids then stand as some encoding has them,
which for merges in order of rank makes the whole the encoding of the text.

A long text is cut into segments at borders of pieces, or inside a piece with
no border for long, the segments are encoded in tasks of their own, and a task
for each text puts their ids together.
"""

from __future__ import annotations

import codecs
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, bytes_of, slices, text_rows
from .streams import runs

#: Bytes of an unsplit piece above which it is halved, and ids on each side of a join to begin with.
LEAF, WINDOW = 2048, 4
#: Bytes of a text above which its segments get tasks of their own, and bytes of a segment.
LONG_TEXT, SEGMENT = 1 << 18, 1 << 17
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 2_000_000

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
#: What follows an apostrophe in the pattern's contractions. Fixed values.
ONE_LETTER, TWO_LETTERS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """One tokenizer file with the ids of pieces seen so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        characters = _byte_characters()
        self._as_characters = {b: c for b, c in enumerate(characters)}
        added = self._tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        byte_of = {c: b for b, c in enumerate(characters)}
        count = max(self._tokenizer.get_vocab().values()) + 1
        table: list[bytes] = [b""] * count
        for token, i in self._tokenizer.get_vocab().items():
            table[i] = token.encode() if i in added else bytes(byte_of[c] for c in token)
        self.token_bytes = table
        self._sizes = np.array([len(t) for t in table], np.int64)
        self._starts = np.concatenate(([0], np.cumsum(self._sizes)))
        self._flat = np.frombuffer(b"".join(table), np.uint8)
        self.decimals = [str(i) for i in range(count)]
        self._classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._forget()

    # Pieces

    def _classify(self, codes: np.ndarray) -> np.ndarray:
        classes = self._classes[codes]
        for code in np.unique(codes[classes == UNKNOWN]):
            c = chr(code)
            for around, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                if len(self._tokenizer.pre_tokenizer.pre_tokenize_str(around + c + around)) == 1:
                    self._classes[code] = kind
                    break
            else:
                self._classes[code] = SPACE
            classes[codes == code] = self._classes[code]
        return classes

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where the pattern's pieces begin, for texts one after another.

        A piece is a stretch of one class. A space before a stretch of another
        class belongs to that stretch; other white space before one is a piece
        of its own; and an apostrophe takes the letters of a contraction.
        """
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(codes)
        if not n:
            return np.empty(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each character begins
        text_start = np.zeros(n + 1, bool)
        text_start[np.searchsorted(at, offsets[:-1])] = True
        text_start[n] = True
        classes = self._classify(codes)
        begins = text_start[:n].copy()
        begins[1:] |= classes[1:] != classes[:-1]
        begins[0] = True
        runs_at = np.flatnonzero(begins)
        after = np.append(runs_at[1:], n)
        blank = (classes[runs_at] == SPACE) & ~text_start[after]
        first, follow = runs_at[blank], after[blank]
        last = follow - 1
        begins[last] = True
        begins[follow[codes[last] == 32]] = False
        for i in np.flatnonzero((codes == 39) & begins).tolist():
            # A piece of the apostrophe and letters right after it.
            if i + 1 < n and classes[i + 1] == LETTER and not text_start[i + 1]:
                taken = 0
                if chr(codes[i + 1]) in ONE_LETTER:
                    taken = 1
                elif i + 2 < n and not text_start[i + 2] and chr(codes[i + 1]) + chr(codes[i + 2]) in TWO_LETTERS:
                    taken = 2
                if taken:
                    begins[i + 1] = False
                    if i + 1 + taken < n and classes[i + 1 + taken] == LETTER and not text_start[i + 1 + taken]:
                        begins[i + 1 + taken] = True
        return at[begins]

    # Ids

    def _merge(self, piece: bytes) -> list[int]:
        return [t.id for t in self._model.tokenize("".join(map(self._as_characters.__getitem__, piece)))]

    def unsplit(self, piece: bytes) -> list[int]:
        """Ids of one piece that isn't to be split, as a tree of halves if it is long."""
        if len(piece) <= LEAF:
            return self._merge(piece)
        half = len(piece) // 2
        return self.joined(self.unsplit(piece[:half]), self.unsplit(piece[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the text of ``left`` and ``right`` together, for ids of the two halves of a piece."""
        width = WINDOW
        while True:
            l, r = min(width, len(left)), min(width, len(right))
            ids = self._merge(b"".join(map(self.token_bytes.__getitem__, left[len(left) - l :] + right[:r])))
            agree_left = l == len(left) or ids[0] == left[len(left) - l]
            agree_right = r == len(right) or ids[-1] == right[r - 1]
            if agree_left and agree_right:
                return left[: len(left) - l] + ids + right[r:]
            width *= 2

    def _forget(self) -> None:
        self._hashes = np.empty(0, np.uint64)
        self._first = np.empty(0, np.int64)
        self._many = np.empty(0, np.int64)
        self._pool = np.empty(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        encoded = [self.unsplit(p) for p in pieces]
        if len(self._hashes) + len(hashes) > REMEMBERED:
            self._forget()
        many = np.array([len(e) for e in encoded], np.int64)
        first = len(self._pool) + np.cumsum(many) - many
        self._pool = np.concatenate((self._pool, np.fromiter((i for e in encoded for i in e), np.uint32)))
        hashes = np.concatenate((self._hashes, hashes))
        order = np.argsort(hashes, kind="stable")
        self._hashes = hashes[order]
        self._first = np.concatenate((self._first, first))[order]
        self._many = np.concatenate((self._many, many))[order]

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self._hashes, hashes)
        known = place < len(self._hashes)
        known[known] = self._hashes[place[known]] == hashes[known]
        return place, known

    def encode(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start, with the end as last entry.

        ``starts`` are the beginnings of the pieces, if they are known.
        """
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self.pieces(data, offsets) if starts is None else starts
        ends = np.append(starts[1:], len(data))
        distinct, example, which = np.unique(Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        place, known = self._places(distinct)
        if not known.all():
            missing = np.flatnonzero(~known)
            whole = data.tobytes()
            texts = [whole[a:b] for a, b in zip(starts[example[missing]].tolist(), ends[example[missing]].tolist(), strict=True)]
            if len(self._hashes) + len(missing) > REMEMBERED:  # all pieces of this call must be known together
                self._forget()
                missing = np.arange(len(distinct))
                texts = [whole[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
            self._learn(distinct[missing], texts)
            place, _ = self._places(distinct)
        first, many = self._first[place][which], self._many[place][which]
        before = np.concatenate(([0], np.cumsum(many)))
        ids = self._pool[np.repeat(first - before[:-1], many) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, offsets)]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``; a special token's string in a text becomes its id, as the library does."""
        data, offsets = bytes_of(texts)
        whole = data.tobytes()
        if not any(s.encode() in whole for s in self.special):
            return self.encode(data, offsets)
        ids, counts = [], [0]
        for text in texts.to_pylist():
            parts, last = [], 0
            for start, stop, special in self._specials(text):
                parts += [self._encode_plain(text[last:start]), np.array([special], np.uint32)]
                last = stop
            parts.append(self._encode_plain(text[last:]))
            ids.append(np.concatenate(parts))
            counts.append(len(ids[-1]))
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.cumsum(counts)

    def _specials(self, text: str) -> Iterator[tuple[int, int, int]]:
        at = 0
        while True:
            found = [(text.find(s, at), -len(s), i) for s, i in self.special.items() if text.find(s, at) >= 0]
            if not found:
                return
            start, size, special = min(found)
            at = start - size
            yield start, at, special

    def _encode_plain(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, special tokens as their strings."""
        sizes = self._sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self._flat[np.repeat(self._starts[ids] - before, sizes) + np.arange(sizes.sum())].tobytes()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded_slices(batches, path: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with column ``text``, cut into slices, each with the ids of its texts and where they start."""
    coder = codec(path)
    for part in slices(batches, limit=limit):
        ids, offsets = coder.encode_texts(part.column("text"))
        yield part, ids, offsets


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class _Digest:
    """Digests of the ids and of the decoded text of one document, part by part."""

    def __init__(self, coder: Codec):
        self.coder, self.count = coder, 0
        self.ids, self.text = hashlib.sha256(), hashlib.sha256()
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: np.ndarray) -> None:
        if len(ids):
            self.ids.update((("," if self.count else "") + ",".join(map(self.coder.decimals.__getitem__, ids.tolist()))).encode())
            self.text.update(self.decoder.decode(self.coder.decode(ids)).encode())
            self.count += len(ids)

    def done(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.decode(b"", True).encode())
        return self.count, self.ids.hexdigest(), self.text.hexdigest()


def _digests(path: str) -> Callable:
    def run(batches):
        for part, ids, offsets in encoded_slices(batches, path):
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                digest = _Digest(codec(path))
                digest.add(ids[a:b])
                rows.append(digest.done())
            n, i, d = zip(*rows, strict=True)
            yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", *DIGESTS.replace(" long", "").replace(" string", "").split(", ")])

    return run


def _segments(path: str, segment: int) -> Callable:
    """A row for each segment of a text.

    ``soft`` segments go on inside the piece before, ``starts`` are the
    beginnings of a segment's pieces, null if it is a part of one piece.
    """

    def segments_of(coder: Codec, text: str) -> Iterator[tuple[bytes, bool, bytes | None]]:
        last = 0
        for start, stop, _ in [*coder._specials(text), (len(text), len(text), 0)]:
            data = np.frombuffer(text[last:start].encode(), np.uint8)
            borders = np.append(coder.pieces(data, np.array([0, len(data)])), len(data))
            begin, soft = 0, False
            while begin < len(data):
                after = int(np.searchsorted(borders, begin, side="right"))
                to = int(np.searchsorted(borders, begin + segment, side="right")) - 1
                if to < after:  # the piece goes on for more than a segment
                    end, unsplit, ends_soft = begin + segment, True, True
                elif soft:
                    end, unsplit, ends_soft = int(borders[after]), True, False
                else:
                    end, unsplit, ends_soft = int(borders[to]), False, False
                starts = None if unsplit else (borders[after - 1 : to] - begin).tobytes()
                yield data[begin:end].tobytes(), soft, starts
                begin, soft = end, ends_soft
            if stop > start:
                yield text[start:stop].encode(), False, b""
            last = stop

    def run(batches):
        coder = codec(path)
        for row in slices(batches, limit=1):
            for i, (piece, soft, starts) in enumerate(segments_of(coder, row.column("text")[0].as_py())):
                yield pa.record_batch([
                    row.column("key"), row.column("other"), pa.array([i], pa.int64()), pa.array([soft]),
                    pa.array([starts], pa.binary()), pa.array([piece], pa.binary()),
                ], ["key", "other", "part", "soft", "starts", "piece"])

    return run


def _encode_segments(path: str) -> Callable:
    def run(batches):
        coder = codec(path)
        for rows in slices(batches, column="piece", limit=SEGMENT):
            encoded = []
            for piece, starts in zip(rows.column("piece").to_pylist(), rows.column("starts").to_pylist(), strict=True):
                if starts is None:
                    ids = np.array(coder.unsplit(piece), np.uint32)
                elif not starts:
                    ids = np.array([coder.special[piece.decode()]], np.uint32)
                else:
                    data = np.frombuffer(piece, np.uint8)
                    ids, _ = coder.encode(data, np.array([0, len(data)]), np.frombuffer(starts, np.int64))
                encoded.append(ids.astype("<u4").tobytes())
            yield pa.record_batch([*(rows.column(c) for c in ("key", "other", "part", "soft")), pa.array(encoded, pa.binary())], ["key", "other", "part", "soft", "ids"])

    return run


def _put_together(path: str) -> Callable:
    def run(batches):
        coder = codec(path)
        for group in runs(batches, ["key", "other"]):
            digest, open_ids = _Digest(coder), []
            tree: list[tuple[int, list[int]]] = []  # halves joined so far, with their heights

            def close():
                nonlocal tree
                while len(tree) > 1:
                    (_, left), (_, right) = tree[-2:]
                    tree[-2:] = [(0, coder.joined(left, right))]
                for _, ids in tree:
                    digest.add(np.array(ids, np.uint32))
                tree = []

            for soft, ids in zip(group.column("soft").to_pylist(), group.column("ids").to_pylist(), strict=True):
                if not soft:
                    close()
                tree.append((0, np.frombuffer(ids, "<u4").tolist()))
                while len(tree) > 1 and tree[-1][0] == tree[-2][0]:
                    (height, left), (_, right) = tree[-2:]
                    tree[-2:] = [(height + 1, coder.joined(left, right))]
            close()
            n, i, d = digest.done()
            yield pa.record_batch(
                [group.column("key").slice(0, 1), group.column("other").slice(0, 1), pa.array([n], pa.int64()), pa.array([i]), pa.array([d])],
                ["key", "other", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_decode(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
    long_text: int = LONG_TEXT, segment: int = SEGMENT,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row.

    ``path`` names a tokenizer file that every executor has. Ids are those of
    the whole text without special tokens added, ids in decimals joined by
    commas, then decoded back. A null text is empty: no ids, digests of nothing.
    Rows that repeat are repeated, null ids are kept. No rows in, no rows out.
    """
    rows = text_rows(docs, id_column, text_column)
    is_long = F.octet_length("text") > long_text
    short = rows.filter(~is_long).mapInArrow(_digests(path), f"doc_id long, {DIGESTS}")
    keys = [F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("other")]
    long = rows.filter(is_long)
    # Equal long texts are encoded once.
    cut = long.select(*keys, "text").dropDuplicates(["key", "other"]).mapInArrow(
        _segments(path, segment), "key long, other long, part long, soft boolean, starts binary, piece binary"
    )
    encoded = cut.repartition("key", "part").mapInArrow(_encode_segments(path), "key long, other long, part long, soft boolean, ids binary")
    whole = encoded.repartition("key").sortWithinPartitions("key", "other", "part").mapInArrow(_put_together(path), f"key long, other long, {DIGESTS}")
    named = long.select("doc_id", *keys).join(whole, ["key", "other"]).drop("key", "other")
    return short.unionByName(named)
