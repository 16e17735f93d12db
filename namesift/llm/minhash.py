"""Near-duplicates by MinHash bands and sequential Bayesian verification.

Each text is a set of hashed shingles and gets a MinHash signature. Texts with
equal sets are one node. Nodes that agree on a band of the signature are
candidates. A candidate pair is compared one batch of the signature after the
other; after each batch, with the agreements seen so far, the posterior of its
similarity says how likely it still reaches the threshold, and the pair goes
once that is below ``MISS``. What survives is confirmed on the full sets.

Bands may hold very many near copies. Their pairs are never all formed: in each
round a node is compared with one other of its buckets, the links found so far
are contracted to components, and only buckets with several components go on.
First that other is the one that shares most bands, which in a group of copies
is the one most like all others. After ``ROUNDS`` of these, the nodes of buckets that are still open are described by how they differ from one of them,
and only those whose differences have enough in common are compared (see
``_Crowds``). That bound is exact, so no candidate is left out.
"""

from __future__ import annotations

from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import split_join, split_lookup
from ..operators.stored import stored
from .common import CACHED_BYTES, TEXT_ROWS, U64, bytes_of, mixed, slices, text_rows, windows_in_texts, words_of
from .graph import components

WORDS = 5
#: The chance that a pair just at the threshold agrees on no band.
UNSEEN = 5e-7
#: Values of a band at most, and of a signature before bands get fewer values.
PER_BAND, LONG = 5, 256


def bands_for(percent: int) -> tuple[int, int]:
    """Bands, and values in each, by which a link is missed with probability ``UNSEEN`` at most."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    for each in range(PER_BAND, 0, -1):
        apart = 1 - (percent / 100) ** each
        count = ceil(log(UNSEEN) / log(apart)) if apart else 1
        if count * each <= LONG:
            break
    return count, each


#: Values of a signature at 85 percent: 25 bands of 5.
LENGTH = bands_for(85)[0] * bands_for(85)[1]
#: Values compared at a time, and the chance of pruning a pair that is a link.
BATCH, MISS = 25, 1e-9
ROUNDS = 1
#: Nodes of each side of an entry that meet in one task.
BLOCK = 2000


def _odd(count: int) -> np.ndarray:
    """Fixed odd factors; a longer list begins with the shorter one."""
    return mixed(np.arange(1, count + 1, dtype=U64)) | U64(1)


_FACTORS = _odd(2 * WORDS + 2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and their text numbers."""
    _, _, words, owner = words_of(data, offsets)
    at = windows_in_texts(owner, WORDS)
    hashes = words[at] * _FACTORS[0]
    for j in range(1, WORDS):
        hashes += words[at + j] * _FACTORS[j]
    of = owner[at]
    count = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.searchsorted(owner, np.arange(len(count)))
    short = np.flatnonzero((count > 0) & (count < WORDS))
    whole = count[short].astype(U64) * _FACTORS[WORDS]  # a short text is one shingle of all its words
    for j in range(WORDS - 1):
        has = count[short] > j
        whole[has] += words[first[short[has]] + j] * _FACTORS[j]
    hashes, of = mixed(np.concatenate((hashes, whole))), np.concatenate((of, short))
    order = np.argsort(hashes)
    order = order[np.argsort(of[order].astype(np.uint16 if len(count) < 1 << 16 else np.int64), kind="stable")]
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], of[new]


PROFILE = "doc_id long, n_shingles long, h1 long, h2 long, signature binary"


def _profile(length: int):
    """Set sizes, digests and signatures of ``length`` values."""
    factors = _odd(2 * length)

    def profile(batches):
        for part in slices(batches, limit=CACHED_BYTES):
            data, offsets = bytes_of(part.column("text"))
            hashes, of = shingle_sets(data, offsets)
            count = np.bincount(of, minlength=part.num_rows)
            full = np.flatnonzero(count)
            first = np.searchsorted(of, full)
            signature = np.zeros((part.num_rows, length), np.uint32)
            digests = np.zeros((2, part.num_rows), U64)
            if len(full):
                work = np.empty_like(hashes)
                for j in range(length):
                    np.multiply(hashes, factors[2 * j], out=work)
                    np.add(work, factors[2 * j + 1], out=work)
                    signature[full, j] = np.minimum.reduceat(work, first) >> U64(32)
                for j in range(2):
                    digests[j, full] = np.add.reduceat(mixed(hashes + _FACTORS[j]), first)
            yield pa.record_batch([
                part.column("doc_id"), pa.array(count.astype(np.int64)), *[pa.array(d.view(np.int64)) for d in digests],
                pa.array([s.tobytes() if n else None for s, n in zip(signature, count, strict=True)], pa.binary()),
            ], ["doc_id", "n_shingles", "h1", "h2", "signature"])

    return profile


def _digests(batches):
    """The set of each text by size and digests, with the row's id and text hashes."""
    for part in slices(batches, limit=CACHED_BYTES):
        hashes, of = shingle_sets(*bytes_of(part.column("text")))
        count = np.bincount(of, minlength=part.num_rows)
        full = np.flatnonzero(count)
        digests = np.zeros((2, part.num_rows), U64)
        if len(full):
            for j in range(2):
                digests[j, full] = np.add.reduceat(mixed(hashes + _FACTORS[j]), np.searchsorted(of, full))
        yield pa.record_batch([
            *[part.column(c) for c in ("doc_id", "t1", "t2")], pa.array(count.astype(np.int64)), *[pa.array(d.view(np.int64)) for d in digests],
        ], ["doc_id", "t1", "t2", "n_shingles", "h1", "h2"])


def _sets(batches):
    for part in slices(batches, limit=CACHED_BYTES):
        hashes, of = shingle_sets(*bytes_of(part.column("text")))
        ends = np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)
        yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], ["node", "shingles"])


def least_agreements(percent: int, length: int = LENGTH) -> list[int]:
    """For 0 to ``length`` values compared, the agreements below which a pair goes.

    With a uniform prior, the similarity after m agreements in n has the
    posterior Beta(m + 1, n - m + 1), whose part above t is the chance of at
    most m successes in n + 1 trials with probability t.
    """
    t, least = percent / 100, []
    for n in range(length + 1):
        tail, m = 0.0, -1
        while tail < MISS:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        least.append(m)
    return least


def survivors(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two signature tables no batch prunes."""
    alive = np.arange(len(left))
    agreed = np.zeros(len(left), np.int64)
    length = left.shape[1]
    for start in range(0, length, BATCH):
        stop = min(start + BATCH, length)
        agreed = agreed + (left[alive, start:stop] == right[alive, start:stop]).sum(axis=1)
        keep = agreed >= least[stop]
        alive, agreed = alive[keep], agreed[keep]
    return alive


def _signatures(column: pa.Array, length: int) -> np.ndarray:
    return bytes_of(column)[0].view(np.uint32).reshape(-1, length)


def _plausible(least: list[int]):
    length = len(least) - 1

    @F.arrow_udf(T.BooleanType())
    def plausible(left: pa.Array, right: pa.Array) -> pa.Array:
        flags = np.zeros(len(left), bool)
        flags[survivors(_signatures(left, length), _signatures(right, length), least)] = True
        return pa.array(flags)

    return plausible


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


class _Search:
    """Nodes, their signatures, band buckets and full sets, as stored tables."""

    def __init__(self, docs: DataFrame, percent: int):
        self.percent = percent
        bands, per_band = bands_for(percent)
        self.least = least_agreements(percent, bands * per_band)
        rows = text_rows(docs)
        self.profile = stored(rows.mapInArrow(_profile(bands * per_band), PROFILE), TEXT_ROWS)
        in_graph = self.profile.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        self.nodes = stored(
            in_graph.groupBy("h1", "h2", "n_shingles")
            .agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"))
        )
        keys = F.array(*[
            F.xxhash64(F.lit(i), F.substring("signature", 1 + 4 * per_band * i, 4 * per_band)) for i in range(bands)
        ])
        band_rows = self.nodes.select("node", F.explode(keys).alias("band"))
        shared = band_rows.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
        self.buckets = stored(band_rows.join(shared, "band"))
        weights = self.buckets.groupBy("node").agg(F.sum("members").alias("weight"))
        # Signatures and sets are needed for nodes that share a band only.
        self.signed = stored(self.nodes.select("node", "n_shingles", "signature").join(weights, "node"))
        candidates = self.signed.select(F.col("node").alias("doc_id")).distinct()
        self.sets = stored(rows.join(candidates, "doc_id", "left_semi").mapInArrow(_sets, "node long, shingles array<bigint>"), TEXT_ROWS)
        self.plausible = _plausible(self.least)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` whose full sets are similar enough, as edges ``u, v``."""
        a, b = (self.signed.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "ab")
        near = stored(
            pairs.join(a, "a").join(b, "b").filter(_sizes_allow(F.col("na"), F.col("nb"), self.percent))
            .filter(self.plausible("sa", "sb")).select("a", "b")
        )
        return self.confirmed(near)

    def confirmed(self, near: DataFrame) -> DataFrame:
        a, b = (self.sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        either = F.size("sa") + F.size("sb") - common
        return near.join(b, "b").join(a, "a").filter(100 * common >= self.percent * either).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def one_each(self, members: DataFrame, turn: int) -> DataFrame:
        """Pairs ``a, b`` of each node and one member of another component in its buckets."""
        if turn:
            order = F.struct(F.xxhash64(F.lit(turn), "node").alias("by"), "node")
        else:
            order = F.struct((-F.col("weight")).alias("by"), "node")
            members = members.join(self.signed.select("node", "weight"), "node")
        first = members.groupBy("band").agg(F.min(F.struct(order.alias("order"), "component")).alias("_hub"))
        met = members.join(first, "band").filter(F.col("component") != F.col("_hub.component"))
        picked = met.groupBy("node").agg(F.min("_hub.order").alias("_order"))
        other = F.col("_order")["node"]
        return picked.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b")).distinct()

    def open_buckets(self, stars: DataFrame) -> DataFrame:
        """Members with their components, of the buckets that hold more than one component."""
        named = self.buckets.join(stars.select(F.col("u").alias("node"), F.col("v").alias("_c")), "node", "left")
        named = named.withColumn("component", F.coalesce("_c", "node")).drop("_c")
        mixed_ones = named.groupBy("band").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a != _b")
        return named.join(mixed_ones.select("band"), "band")


class _Crowds:
    """Open nodes that reach each other by open buckets, as differences from a set that is typical of them.

    The pivot of a crowd is the set of the node that shares most bands. With dA
    as the shingles in either A or the pivot but not in both, what differs
    between A and C is |dA| + |dC| - 2 |dA & dC|. At a similarity of p percent
    no more than (100 - p) / (100 + p) of |A| + |C| shingles may differ, so with
    ``excess`` = (100 + p) |dA| - (100 - p) |A|, the differences of a link have
    (excess of A + excess of C) / (2 (100 + p)) entries in common at least.
    What all of a crowd have in common plays no part in this.
    """

    def __init__(self, search: _Search, members: DataFrame):
        self.percent = search.percent
        self.whole, self.less = 100 + search.percent, 100 - search.percent
        first = members.groupBy("band").agg(F.min("node").alias("v"))
        edges = members.join(first, "band").filter("node != v").select(F.col("node").alias("u"), "v").distinct()
        named = components(edges).select(F.col("u").alias("node"), F.col("v").alias("_crowd"))
        nodes = members.select("node").distinct().join(named, "node", "left").withColumn("crowd", F.coalesce("_crowd", "node")).drop("_crowd")
        nodes = stored(nodes.join(search.signed.select("node", "weight").distinct(), "node"))
        # An id with several texts is one node with several sets.
        sets = nodes.join(search.sets, "node").withColumn("form", F.xxhash64("shingles"))
        pivots = nodes.groupBy("crowd").agg(F.max_by("node", F.struct("weight", "node")).alias("node"))
        forms = pivots.join(search.sets, "node").groupBy("crowd").agg(F.min(F.struct("node", "shingles")).alias("one"))
        pivot = stored(forms.select("crowd", F.col("one.node").alias("pivot"), F.col("one.shingles").alias("_pivot")))
        differs = F.concat(F.array_except("shingles", "_pivot"), F.array_except("_pivot", "shingles"))
        apart = sets.join(pivot, "crowd").select("crowd", "pivot", "node", "form", F.size("shingles").cast("long").alias("n"), F.size("_pivot").cast("long").alias("np"), differs.alias("differs"))
        apart = stored(apart.withColumn("m", F.size("differs").cast("long")).withColumn("excess", self.whole * F.col("m") - self.less * F.col("n")))
        least = apart.groupBy("crowd").agg(F.min(F.struct("excess", "node")).alias("least"))
        self.nodes = apart.join(least, "crowd").withColumns({
            "to_pivot": self.whole * F.col("m") <= self.less * (F.col("n") + F.col("np")), "to_least": F.col("excess") + F.col("least.excess") <= 0,
        })

    def certain(self) -> DataFrame:
        """Links ``u, v`` that sizes alone decide: to the pivot, and to the crowd's node with the smallest excess.

        Two nodes whose excesses add up to 0 at most are linked, and then both
        are linked to that node.
        """
        to_pivot = self.nodes.filter("to_pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        to_least = self.nodes.filter("to_least").select(F.col("node").alias("u"), F.col("least.node").alias("v"))
        return to_pivot.union(to_least).filter("u != v").distinct()

    def pairs(self, stars: DataFrame) -> DataFrame:
        """Pairs ``a, b`` that neither components nor certain links put together and whose differences may have enough entries in common.

        Entries are ordered from rare to common within the crowd. Two lists with
        c entries in common share one of the first size - c + 1 of each, and at
        the first shared place both have c entries left.
        """
        hub = F.when(F.col("to_pivot"), F.col("pivot")).when(F.col("to_least"), F.col("least.node")).otherwise(F.xxhash64(F.lit(3), "node", "form")).alias("hub")
        nodes = self.nodes.select("crowd", "node", "form", "n", "m", "excess", "differs", hub)
        named = nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("_c")), "node", "left")
        named = stored(named.withColumn("component", F.coalesce("_c", "node")).drop("_c"))
        # The pivot's own pairs are decided, and its empty difference tells nothing of the others.
        rest = named.filter("m > 0")
        crowds = rest.groupBy("crowd").agg(
            *[f(c).alias(f"{name}_{c}") for c in ("component", "hub") for f, name in ((F.min, "least"), (F.max, "most"))], F.min("excess").alias("lowest")
        ).filter("least_component != most_component and least_hub != most_hub")
        rest = stored(rest.join(crowds.select("crowd", "lowest"), "crowd"))
        entries = rest.select("crowd", "node", "form", F.explode("differs").alias("entry"))
        counts = stored(entries.groupBy("crowd", "entry").agg(F.count("*").alias("held")).filter("held > 1"))
        held = split_lookup(entries, counts, ["crowd", "entry"], counts, "held", ["node"])
        shared = held.groupBy("node", "form").agg(F.sort_array(F.collect_list(F.struct("held", "entry"))).alias("shared"))
        # A partner has at least the crowd's lowest excess, and at least as many differences as
        # the triangle of both sets and the pivot asks for.
        bound = F.greatest(F.col("lowest"), F.col("excess") - F.ceil(200 * self.less * F.col("n") / self.percent))
        needed = F.greatest(F.lit(1), F.ceil((F.col("excess") + bound) / (2 * self.whole)))
        own = F.col("m") - F.size("shared")  # entries that no other node has come first
        leading = F.greatest(F.lit(0), F.col("m") - needed + 1 - own).cast("int")
        postings = stored(rest.join(shared, ["node", "form"]).select(
            "crowd", "node", "component", "hub", "n", "excess", "m", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), leading)).alias("at", "of"),
        ).select("crowd", "node", "component", "hub", "n", "excess", (F.col("m") - F.col("own") - F.col("at")).alias("left"), F.col("of.entry").alias("entry")))
        a, b = (postings.select("crowd", "entry", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "hub", "n", "excess", "left")]) for x in "ab")
        both = split_join(a, b, ["crowd", "entry"], ["node_a"], ["node_b"], BLOCK)
        possible = (
            (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & (F.col("hub_a") != F.col("hub_b")) & _sizes_allow(F.col("n_a"), F.col("n_b"), self.percent)
            & (2 * self.whole * F.least("left_a", "left_b") >= F.col("excess_a") + F.col("excess_b"))
        )
        return both.filter(possible).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with the size of its shingle set and its component.

    Returns ``doc_id, n_shingles, component_id, kept``. Words are what
    ``[\\x20\\x09-\\x0D]`` separates, A-Z in lower case; a text with fewer than five
    words is one shingle, and one without words has the empty set and no links.
    Texts are linked if 100 * common >= ``percent`` * all of their shingles.
    ``component_id`` is the smallest id reachable by links, and the row that
    holds it is kept. Rows that repeat an id are one document with several
    texts. A row without id has no links and is kept, with a null component.
    No rows in, no rows out.
    """
    return _decided(docs, percent, id_column, text_column).select("doc_id", "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame, percent: int, id_column: str, text_column: str) -> DataFrame:
    """The rows of ``near_duplicates`` with the digests of their sets."""
    search = _Search(docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")), percent)
    stars = stored(search.signed.limit(0).select(F.col("node").alias("u"), F.col("node").alias("v")))
    tested = stars.select(F.col("u").alias("a"), F.col("v").alias("b"))
    for turn in range(ROUNDS + 1):
        members = stored(search.open_buckets(stars))
        if members.isEmpty():
            break
        if turn < ROUNDS:
            pairs = search.one_each(members, turn)
        else:
            crowds = _Crowds(search, members)
            pairs = crowds.pairs(stars)
            stars = stars.union(crowds.certain())
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        stars = components(stars.union(search.links(pairs)))
    known = search.nodes.select("h1", "h2", "n_shingles", "node")
    rows = search.profile.select("doc_id", "n_shingles", "h1", "h2").join(known, ["h1", "h2", "n_shingles"], "left")
    node = F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id"))
    joined = rows.select("doc_id", "n_shingles", "h1", "h2", node.alias("node")).join(stars.select(F.col("u").alias("node"), "v"), "node", "left")
    component = F.coalesce("v", "node")
    return joined.select("doc_id", "n_shingles", "h1", "h2", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``near_duplicates`` keeps.

    Of an id with rows that are kept and rows that are not, rows go by their sets.
    """
    decided = stored(_decided(docs, percent, id_column, text_column).filter("doc_id is not null"))
    fates = stored(decided.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("all")).filter("not all"))
    dropped = fates.filter("not some").select(F.col("doc_id").alias("id"))
    split = fates.filter("some").select("doc_id")
    gone = decided.filter("not kept").join(split, "doc_id", "left_semi").select("doc_id", "n_shingles", "h1", "h2").distinct()
    hashed = text_rows(docs, id_column, text_column).join(split, "doc_id", "left_semi").withColumns(
        {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}
    )
    sets = hashed.mapInArrow(_digests, "doc_id long, t1 long, t2 long, n_shingles long, h1 long, h2 long")
    texts = stored(sets.join(gone, ["doc_id", "n_shingles", "h1", "h2"], "left_semi").select(F.col("doc_id").alias("id"), "t1", "t2").distinct(), TEXT_ROWS)
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_column].cast("long").alias("id"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
    )
    found = rows.join(dropped, "id", "left_anti").join(texts, ["id", "t1", "t2"], "left_anti")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])
