"""A Merkle manifest of a dataset: leaf hashes, roots, and a proof for every row.

Leaves stand in order of their group and id. ``SIZE`` of them that follow one
another, from a multiple of ``SIZE`` on, form a block. A block keeps each of its
levels as one string of hex digests: the parents of a level are the hashes of its
fixed-width substrings, and the sibling of a node is the substring beside it. The
top nodes of the blocks are the leaves of the next, smaller table of blocks, and
so on until a group is one node; then the groups' roots are treated alike.

On the way back down each block adds its own siblings to the path that its top
node already has. So a row's path never leaves its block's rows: blocks are
joined to paths by number, one to one, and no group of rows is larger than
``SIZE``, whatever share of the table a language holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stored import stored
from .common import range_starts, ranged

#: Levels that a block covers, and the nodes that it takes.
LEVELS = 8
SIZE = 1 << LEVELS
HEX = 64


def _hash(value: Column) -> Column:
    return F.sha2(value, 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(docs: DataFrame, n_chars: Column) -> Column:
    first = [docs[c] for c in ("doc_id", "source", "lang")]
    return _hash(F.concat(*[_field(c) for c in (*first, n_chars, docs["text"])]))


def is_tampered(doc_id: Column) -> Column:
    """Rows that the check tampers with: 7 divides crc32 of the id as text. Rows without id aren't."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``key, doc_id, leaf, start``: a row's leaf, and the leaf it would have if tampered with, else null.

    ``key`` orders languages as their UTF-8 bytes do, with null first.
    """
    more = (docs["n_chars"].cast("decimal(20,0)") + 1).cast("string")
    start = F.when(is_tampered(docs["doc_id"]) & docs["n_chars"].isNotNull(), _leaf(docs, more))
    return docs.select(
        F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit("")).alias("key"),
        docs["doc_id"].cast("long").alias("doc_id"), _leaf(docs, docs["n_chars"]).alias("leaf"), start.alias("start"),
    )


def _guarded(count: Column) -> Column:
    """The numbers 1 to ``count``, none for 0."""
    return F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.expr("cast(array() as array<int>)"))


def _parents(level: Column) -> Column:
    """The level above: the hashes of pairs of nodes, the last node alone if there is no other."""
    pairs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / (2 * HEX)).cast("int") - 1)
    hashes = F.transform(pairs, lambda i: _hash(F.substring(level, i * (2 * HEX) + 1, F.lit(2 * HEX))))
    return F.array_join(hashes, "").cast("binary")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks of nodes ``rank, place, node`` with all their levels.

    ``count`` is the number of nodes that the group ``rank`` has. A block goes up
    ``LEVELS`` levels, or to the one node of a group that has no other block.
    """
    members = F.sort_array(F.collect_list(F.struct("place", "node", *carried)))
    grouped = nodes.groupBy("rank", F.shiftright("place", LEVELS).alias("block")).agg(
        members.alias("members"), F.max("count").alias("count")
    )
    height = F.when(F.col("count") > 1, F.length(F.bin(F.col("count") - 1))).otherwise(0)
    bottom = F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary")
    levels = F.aggregate(
        _guarded(F.least(height, F.lit(LEVELS))), F.array(bottom),
        lambda known, _: F.concat(known, F.array(_parents(F.element_at(known, -1)))),
    )
    return grouped.withColumn("levels", levels)


def _tops(blocks: DataFrame) -> DataFrame:
    """The top node of each block, as a node of the table above."""
    return blocks.select(
        "rank", F.col("block").alias("place"), F.element_at("levels", -1).cast("string").alias("node"),
        F.ceil(F.col("count") / SIZE).alias("count"),
    )


def _climb(nodes: DataFrame, most: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the bottom up, and ``rank, node, step``: each group's root and the table that ends in it.

    ``most`` is the number of nodes of the largest group. The loop runs once for
    each ``LEVELS`` levels.
    """
    steps, roots = [], None
    while True:
        blocks = stored(_blocks(nodes, carried))
        tops = _tops(blocks)
        done = tops.filter("count = 1").select("rank", "node", F.lit(len(steps)).alias("step"))
        roots = done if roots is None else roots.union(done)
        steps.append(blocks)
        if most <= SIZE:
            return steps, stored(roots)
        nodes, carried, most = tops.filter("count > 1"), [], -(-most // SIZE)


def _siblings(place: Column, levels: Column) -> Column:
    """For each level of a block below its top: L or R and the sibling beside a node, or nothing."""

    def beside(level: Column, height: Column) -> Column:
        own = F.call_function("shiftright", place % SIZE, height)
        other = own.bitwiseXOR(F.lit(1).cast("long"))
        node = F.substring(level, (other * HEX + 1).cast("int"), F.lit(HEX)).cast("string")
        return F.when(other * HEX >= F.octet_length(level), "").when(other < own, F.concat(F.lit("L"), node)).otherwise(F.concat(F.lit("R"), node))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), beside)


def _descend(steps: list[DataFrame], ends: DataFrame, carried: list[str]) -> DataFrame:
    """The members of the lowest blocks, each with ``path``, its siblings up to the last root, and ``subroot``.

    ``ends`` has, for each group, the step that ends in its root and the root's own path.
    """
    members = None
    for number in reversed(range(len(steps))):
        above = ends.filter(F.col("step") == number).select("rank", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if members is not None:
            above = above.union(members.select("rank", F.col("place").alias("block"), "path", "subroot"))
        own = carried if number == 0 else []
        found = F.transform("members", lambda m: F.struct(
            *[m[c].alias(c) for c in ("place", "node", *own)],
            F.concat(_siblings(m["place"], F.col("levels")), F.col("path")).alias("route"),
        ))
        members = steps[number].join(above, ["rank", "block"]).select("rank", "subroot", F.inline(found)).withColumnRenamed("route", "path")
    return members


def _folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(node: Column, beside: Column) -> Column:
        other = F.substring(beside, 2, HEX)
        pair = F.when(beside == "", node).when(F.startswith(beside, F.lit("L")), F.concat(other, node)).otherwise(F.concat(node, other))
        return _hash(pair)

    return F.aggregate(path, start, up)


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    A leaf is the SHA-256 of ``doc_id, source, lang, n_chars, text``, each as its
    number of UTF-8 bytes, a colon and its value, or ``-`` if null. Leaves of a
    language stand by id, rows without id first, rows that repeat an id by leaf;
    equal rows have leaves of their own. Each pair of neighbours has the hash of
    both as parent, a last one without neighbour that of itself alone, until one
    is left, the ``subroot``; subroots in order of language, null first, give the
    ``root`` likewise. ``proof_sha256`` is the hash of a leaf's siblings from the
    bottom up. ``folded_root`` is computed from them and the leaf, which of some
    rows (``is_tampered``) is made with ``n_chars`` one larger; it then differs
    from the root. No rows in, no rows out. Other columns are not read.
    """
    rows = ranged(stored(leaves(docs)), ["key", "doc_id", "leaf"])
    first_places = stored(range_starts(rows, ["key"]))
    groups = ranged(stored(first_places.groupBy("key").agg(F.sum("rows").alias("count"))), ["key"])
    most, count = groups.agg(F.max("count"), F.count("*")).first()
    if not count:
        return rows.sparkSession.createDataFrame([], RESULT)

    before = range_starts(groups, []).select("range", "first", "before")
    rank = (F.col("before") + F.col("at") - F.col("first")).alias("rank")
    ranks = stored(groups.select("key", "count", "range", "at").join(before, "range").select("key", "count", rank))
    known = first_places.join(ranks, "key").select("key", "range", "first", "before", "rank", "count")
    nodes = rows.join(known, ["key", "range"]).select(
        "rank", (F.col("before") + F.col("at") - F.col("first")).alias("place"), F.col("leaf").alias("node"), "doc_id", "start", "count",
    )
    steps, subroots = _climb(nodes, most, ["doc_id", "start"])

    tops = subroots.select(F.lit(0).cast("long").alias("rank"), F.col("rank").alias("place"), "node", F.lit(count).alias("count"))
    top_steps, top = _climb(tops, count, [])
    root, last = top.select("node", "step").first()
    nothing = F.expr("cast(array() as array<string>)").alias("path")
    end = top.select("rank", F.lit(last).alias("step"), nothing, F.lit(root).alias("subroot"))
    paths = _descend(top_steps, end, []).select(F.col("place").alias("rank"), F.col("node").alias("subroot"), "path")
    found = _descend(steps, stored(paths.join(subroots.select("rank", "step"), "rank")), ["doc_id", "start"])

    siblings = F.array_join(F.transform("path", lambda s: F.substring(s, 2, HEX)), "")
    folded = _folded(F.coalesce("start", "node"), F.col("path"))
    return found.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root).alias("root"),
        _hash(siblings).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
