"""A trie of conversations by their turns, built shard by shard.

Every turn has a 16-byte digest of its role and text; a conversation is the
string of its digests. Conversations are sorted by that string and cut into
ranges. In a shard the digests become small numbers by a dictionary, and a
ternary search tree takes the different conversations, medians first, so that
the search trees among siblings are balanced. One traversal without recursion
adds up members, children, leaves and savings from the bottom up.

A node that a shard shares with a neighbour is a boundary node. As shards are
ranges, these are prefixes of a shard's first or last conversation, and how far
they agree with the neighbour's is known from the shards' ends alone. A node
counts as a leaf in the last shard that has it and is subtracted once in the
first one, so that the parts of a boundary node simply add up over shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import stored
from .common import partitions_of
from .streams import runs

#: Bytes of a turn's digest, original turns that a conversation can inherit at most, and conversations between givers.
DIGEST, SHARED, EVERY = 16, 8, 5
#: Turns that a shard holds about.
SHARD_TURNS = 100_000

#: What a shard tells of a node. Boundary nodes have a ``node`` and ``ends``, nodes below them a ``parent_node``.
PARTS = (
    "conv_id long, depth long, parent_conv_id long, parent_node binary, node binary, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, first_end long, ends binary"
)


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: digest and bytes of each turn, in order.

    Turns stand by ``turn``, null first, and those of one ``turn`` by digest.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"),
        F.struct(
            turns["turn"].cast("long").alias("turn"), F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
        ).alias("entry"),
    ).filter("conv_id is not null")
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("entry")).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, key, bytes``: each conversation with the first turns of its giver, as a string of digests.

    A conversation has at most five takers, so the join has no hot key.
    """
    own = stored(conversations(turns))
    giver = F.col("conv_id") - F.col("conv_id") % EVERY
    heads = own.filter(F.col("conv_id") == giver).select(F.col("conv_id").alias("giver"), F.slice("turns", 1, SHARED).alias("head"))
    taken = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % (SHARED + 1)).cast("int")
    joined = own.withColumns({"giver": giver, "taken": taken}).join(heads, "giver", "left")
    rest = F.slice("turns", F.col("taken") + 1, F.size("turns"))
    whole = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("taken")), F.slice("turns", 1, 0)), rest)
    merged = joined.select("conv_id", F.inline(F.array(F.struct(whole.alias("turns")))))
    digests = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return merged.select("conv_id", digests.alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))


def _agreement(a, b):
    """How many leading digests two keys share; null counts as no key at all."""

    @F.arrow_udf("int")
    def agreement(left: pa.Array, right: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(left, right, strict=True):
            if not x.is_valid or not y.is_valid:
                found.append(-1)
                continue
            p, q = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
            size = min(len(p), len(q))
            differ = np.flatnonzero(p[:size] != q[:size])
            found.append(int(differ[0] if differ.size else size) // DIGEST)
        return pa.array(found, pa.int32())

    return agreement(a, b)


def shards(built: DataFrame, shard_turns: int) -> DataFrame:
    """Conversations with their shard and what it shares with its neighbours: ``before`` and ``after``, -1 for nothing."""
    turns = built.agg(F.sum(F.size("bytes") + 1)).first()[0] or 0
    count = max(partitions_of(built), -(-turns // shard_turns))
    spread = built.repartitionByRange(int(count), "key", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    dealt = stored(spread)
    ends = dealt.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("shard")  # one row for each shard
    beside = ends.select("shard", "first", "last", F.lag("last").over(order).alias("left"), F.lead("first").over(order).alias("right"))
    known = stored(beside.select("shard", _agreement("left", "first").alias("before"), _agreement("last", "right").alias("after")))
    return dealt.join(known, "shard")


class Ternary:
    """A ternary search tree over sequences of numbers; node 0 is the empty sequence.

    ``down`` leads to the search tree of a node's children, ``low`` and ``high``
    to smaller and larger siblings.
    """

    def __init__(self):
        self.symbol, self.low, self.high, self.down = [-1], [-1], [-1], [-1]
        self.members, self.least, self.end = [0], [None], [-1]

    def _new(self, symbol: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, -1), (self.high, -1), (self.down, -1), (self.members, 0), (self.least, None), (self.end, -1)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, sequence: list[int], end: int, members: int, least: int) -> None:
        """Add ``members`` conversations of one sequence, numbered ``end``, the smallest of them ``least``."""
        symbol, at = self.symbol, 0
        self._count(0, members, least)
        for s in sequence:
            link, place, below = self.down, at, self.down[at]
            while below >= 0 and symbol[below] != s:
                link, place = (self.low if s < symbol[below] else self.high), below
                below = link[place]
            if below < 0:
                below = link[place] = self._new(s)
            self._count(below, members, least)
            at = below
        self.end[at] = end

    def _count(self, node: int, members: int, least: int) -> None:
        self.members[node] += members
        known = self.least[node]
        self.least[node] = least if known is None or least < known else known

    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """All nodes, each after its parent, with their parents and depths."""
        order, parent, depth = [], [-1] * len(self.symbol), [0] * len(self.symbol)
        open_nodes = [0]
        while open_nodes:
            node = open_nodes.pop()
            order.append(node)
            # The siblings below a node in their search tree have the same parent.
            for sibling in (self.low[node], self.high[node]):
                if sibling >= 0:
                    parent[sibling], depth[sibling] = parent[node], depth[node]
                    open_nodes.append(sibling)
            child = self.down[node]
            if child >= 0:
                parent[child], depth[child] = node, depth[node] + 1
                open_nodes.append(child)
        return order, parent, depth


def medians_first(count: int) -> Iterator[int]:
    """0 to ``count`` - 1, the middle of each range before its halves."""
    ranges = [(0, count)]
    for low, high in ranges:
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(low, middle), (middle + 1, high)]


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _way(tree: Ternary, sequence: list[int], digests: np.ndarray, depth: int) -> dict[int, bytes]:
    """The nodes down a sequence to a depth, the root first, by a name that all shards give them; none for -1."""
    if depth < 0:
        return {}
    at, name = 0, hashlib.blake2b(digest_size=DIGEST).digest()
    found = {at: name}
    for s in sequence[:depth]:
        at = tree.down[at]
        while tree.symbol[at] != s:
            at = tree.low[at] if s < tree.symbol[at] else tree.high[at]
        name = hashlib.blake2b(name + digests[s].tobytes(), digest_size=DIGEST).digest()
        found[at] = name
    return found


def shard_nodes(keys: list[bytes], ids: np.ndarray, sizes: list[np.ndarray], before: int, after: int) -> list[tuple]:
    """Rows of ``PARTS`` for the nodes of one shard, whose conversations are sorted by key and id.

    The nodes up to depth ``before`` on the way to the first conversation are
    also in an earlier shard, those up to ``after`` on the way to the last one in
    a later shard.
    """
    starts = [i for i, key in enumerate(keys) if not i or key != keys[i - 1]]
    stops = [*starts[1:], len(keys)]
    joined = b"".join(keys[i] for i in starts)
    known, codes = np.unique(np.array(memoryview(joined).cast("B")).view(f"S{DIGEST}"), return_inverse=True)
    digests = known.view(np.uint8).reshape(-1, DIGEST)
    offsets = np.concatenate(([0], np.cumsum([len(keys[i]) // DIGEST for i in starts]))).astype(int)
    bytes_in = np.zeros(len(known), np.int64)
    bytes_in[codes] = np.concatenate([sizes[i] for i in starts])
    sequences = [codes[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]

    tree = Ternary()
    for i in medians_first(len(starts)):
        tree.insert(sequences[i], i, stops[i] - starts[i], int(ids[starts[i] : stops[i]].min()))

    order, parent, depth = tree.walk()
    earlier, later = _way(tree, sequences[0], digests, before), _way(tree, sequences[-1], digests, after)
    boundary = {**earlier, **later}
    children, leaves, saved = ([0] * len(order) for _ in range(3))
    for node in reversed(order):
        new = node not in earlier
        saved[node] += (tree.members[node] - new) * int(bytes_in[tree.symbol[node]]) if node else 0
        leaves[node] += tree.down[node] < 0 and node not in later
        if node:
            up = parent[node]
            children[up] += new
            leaves[up] += leaves[node]
            saved[up] += saved[node]

    rows = []
    for node in order:
        up, end = parent[node], tree.end[node]
        ends = ids[starts[end] : stops[end]] if end >= 0 else ids[:0]
        counts = (tree.members[node], children[node], leaves[node], saved[node])
        names = (tree.least[node], depth[node], tree.least[up] if node and up not in boundary else None, boundary.get(up), boundary.get(node))
        if node in boundary:
            rows.append((*names, *counts, None, int(ends[0]) if len(ends) else None, ends.astype("<i8").tobytes()))
        else:
            rows.append((*names, *counts, hashlib.sha256(_joined(ends)).hexdigest(), None, None))
    return rows


def _nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (p.split() for p in PARTS.split(", "))])
    for shard in runs(batches, ["shard"]):
        lists = shard.column("bytes")
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes = np.split(lists.flatten().to_numpy(zero_copy_only=False), cuts[1:-1])
        ids = shard.column("conv_id").to_numpy(zero_copy_only=False)
        rows = shard_nodes(shard.column("key").to_pylist(), ids, sizes, shard.column("before")[0].as_py(), shard.column("after")[0].as_py())
        for start in range(0, len(rows), 10_000):
            columns = zip(*rows[start : start + 10_000], strict=True)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each boundary node's ends, from the parts of all shards one after another."""
    node, state, empty = None, None, True

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    for batch in batches:
        for name, ids in zip(batch.column("node"), batch.column("ends"), strict=True):
            if name.as_py() != node:
                if node is not None:
                    yield done()
                node, state, empty = name.as_py(), hashlib.sha256(), True
            part = _joined(np.frombuffer(ids.as_buffer(), "<i8"))
            if part:
                state.update(part if empty else b"," + part)
                empty = False
    if node is not None:
        yield done()


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each different beginning of the rebuilt conversations, the empty one included.

    Turns of a conversation stand by ``turn``, null first; turns that share a
    ``turn`` are ordered by a digest, and rows that repeat count each. A null role
    or text is empty. Rows without ``conv_id`` take no part. Conversation ``c``
    begins with the first h turns of ``c - c % 5`` (h by a hash of ``c``; fewer if
    that has fewer, none if it doesn't exist) and goes on with its own turns
    after its first h. Columns are those of ``RESULT``: the smallest member, the
    depth, the smallest member of the parent (null for the root), members,
    children, leaves below or at the node, bytes saved by holding each turn below
    or at it once, and the digest of the ids that end here. No rows in, no rows
    out.

    One conversation's digests, 24 bytes a turn, are held at a time by a task, and
    those of a shard, about ``shard_turns`` turns or one conversation.
    """
    dealt = shards(stored(rebuilt(turns)), shard_turns)
    grouped = dealt.repartition("shard").sortWithinPartitions("shard", "key", "conv_id")
    parts = stored(grouped.mapInArrow(_nodes, PARTS))
    shared = parts.filter("node is not null")
    chunks = shared.select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end")
    digests = chunks.drop("first_end").mapInArrow(_ends, "node binary, ends_sha256 string")
    sums = shared.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_node").alias("parent_node"),
        *[F.sum(c).alias(c) for c in RESULT[3:7]],
    )
    boundary = stored(sums.join(digests, "node"))
    columns = ["conv_id", "depth", "parent_conv_id", "parent_node", *RESULT[3:]]
    inner = parts.filter("node is null").select(*columns)
    whole = inner.union(boundary.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
    parents = boundary.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("_parent"))
    named = whole.join(parents, "parent_node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return named.select(*RESULT)
