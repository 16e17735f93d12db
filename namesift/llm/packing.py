"""Hierarchical packing of documents into sequences of several lengths.

Documents are routed to tiers, the powers of two up to the context size. Whole
windows of the context size are cut off first; what is left of a document goes
to the smallest tier that holds it. A tier's windows begin with a remainder of
their own, and their gaps are filled from shorter tiers, cut to fit. All windows
are full, so that only the last sequence of a task is padded.

Windows of one tier are put into step groups of equal numbers of tokens, over
all tasks: a task numbers its windows, and a task's numbers go on from the counts
of the tasks before it, with the padded windows after all others. So only the
last group of a tier is short.

Each task packs the documents it reads as they come, holding what waits for a
window. No text and no piece is shuffled for it; the pieces, without ids, are a
written table that the counts are joined to.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import stored
from .bpe import encoded_slices
from .common import text_rows

CONTEXT, TIERS = 1024, (1024, 512, 256, 128, 64)
#: Remainders that may wait in a tier for shorter ones to fill their gaps.
WAITING = 64
#: Windows of the context size in a step group.
STEP_WINDOWS = 16

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


#: What a task tells of a piece: its window's number in the task and tier, and whether the window is padded.
NUMBERED = PIECES + ", window long, padded boolean"


class _Packer:
    """The windows of one task. Pieces are (document row, first id, ids).

    Step groups here are the task's own.
    """

    def __init__(self, task: int):
        self.task, self.sequences = task, 0
        self.pools = {t: deque() for t in TIERS}
        self.waiting = dict.fromkeys(TIERS, 0)
        self.windows = dict.fromkeys(TIERS, 0)
        self.out: list[tuple] = []

    def emit(self, tier: int, pieces: list[tuple], padded: bool = False) -> None:
        sequence = (self.task << 32) + self.sequences
        window = self.windows[tier]
        group = window // (STEP_WINDOWS * CONTEXT // tier)
        offset = 0
        for (doc_id, doc_tokens), start, ids in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, sequence, offset, tier,
                             (self.task << 32) + group * len(TIERS) + TIERS.index(tier), 0 if padded else window, padded))
            offset += len(ids)
        self.sequences += 1
        self.windows[tier] += 1

    def add(self, row: tuple, ids: np.ndarray) -> None:
        at = 0
        while len(ids) - at >= CONTEXT:
            self.emit(CONTEXT, [(row, at, ids[at : at + CONTEXT])])
            at += CONTEXT
        if at < len(ids):
            self.route((row, at, ids[at:].copy()))

    def route(self, piece: tuple) -> None:
        tier = min(t for t in TIERS if t >= len(piece[2]))
        self.pools[tier].append(piece)
        self.waiting[tier] += len(piece[2])

    def take(self, tier: int, space: int) -> tuple:
        """At most ``space`` ids of a waiting remainder of a tier; the rest of it is routed anew."""
        row, start, ids = self.pools[tier].popleft()
        self.waiting[tier] -= len(ids)
        if len(ids) > space:
            self.route((row, start + space, ids[space:]))
        return row, start, ids[:space]

    def pack(self, last: bool = False) -> None:
        for level, tier in enumerate(TIERS):
            pool = self.pools[tier]
            while pool:
                fillers = [*TIERS[level + 1 :], *([tier] if len(pool) > WAITING else [])]
                if len(pool[0][2]) + sum(self.waiting[t] for t in TIERS[level + 1 :]) < tier and len(pool) <= WAITING:
                    break  # until shorter documents come
                window = [self.take(tier, tier)]
                space = tier - len(window[0][2])
                for t in fillers:
                    while space and self.pools[t]:
                        window.append(self.take(t, space))
                        space -= len(window[-1][2])
                self.emit(tier, window)
        if last:
            rest = [p for t in TIERS for p in self.pools[t]]
            self.pools = {t: deque() for t in TIERS}
            window, space = [], CONTEXT
            for row, start, ids in rest:
                while len(ids):
                    window.append((row, start, ids[:space]))
                    start, space, ids = start + len(ids[:space]), space - len(ids[:space]), ids[space:]
                    if not space:
                        self.emit(CONTEXT, window)
                        window, space = [], CONTEXT
            if window:
                self.emit(CONTEXT, window, padded=True)

    def taken(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        names, kinds = zip(*(c.split() for c in NUMBERED.split(", ")), strict=True)
        kinds = [{"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[k] for k in kinds]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def _pack(path: str, end_id: int) -> Callable:
    def run(batches):
        packer = _Packer(TaskContext.get().partitionId())
        for part, ids, offsets in encoded_slices(batches, path):
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = np.empty(b - a + 1, "<u4")
                own[:-1], own[-1] = ids[a:b], end_id
                packer.add((doc_id, len(own)), own)
            packer.pack()
            yield packer.taken()
        packer.pack(last=True)
        yield packer.taken()

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence of at most ``CONTEXT`` ids.

    Returns the columns of ``PIECES``: the document, the piece's first id there
    and its length, a checksum of its ids, the document's ids, the sequence and
    the piece's place in it, the sequence's tier and its step group. A document
    is its ids and then ``end_id``; a null or empty text is ``end_id`` alone.
    Rows that repeat are packed each. No rows in, no rows out.
    """
    pieces = stored(text_rows(docs, id_column, text_column).mapInArrow(_pack(path, end_id), NUMBERED))
    task = F.shiftright("sequence_id", 32).alias("task")
    counts = pieces.groupBy("tier", "padded", task).agg((F.max("window") + 1).alias("windows"))
    before = Window.partitionBy("tier").orderBy("padded", "task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tier", "padded", "task", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("window")
    each = F.lit(STEP_WINDOWS * CONTEXT) / F.col("tier")
    of_tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")) - 1
    group = (F.floor(number / each) * len(TIERS) + of_tier).cast("long")
    joined = pieces.withColumn("task", task).join(starts, ["tier", "padded", "task"]).withColumn("step_group", group)
    return joined.select(*[c.split()[0] for c in PIECES.split(", ")])
