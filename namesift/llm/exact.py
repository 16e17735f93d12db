"""Exact duplicates by a content sort.

Sampled splitters cut the texts into ranges, each range is sorted by content
(Spark's sort spills to disk), and in that order equal texts stand side by side,
so that comparing each text in full with the one before it finds all runs of
copies. Splitters are pairs of a text's beginning and an id: a text with very
many copies is cut between ids, and its runs in several ranges are put together
by the digest afterwards. Only ids and digests are stored or joined, and texts
move once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import stored
from .common import partitions_of, text_rows

#: Characters of a text that a splitter holds, and sampled rows for each range.
HEAD, SAMPLES_PER_RANGE = 48, 24


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digest(norm: Column) -> Column:
    return F.sha2(F.encode(norm, "UTF-8"), 256)


def splitters(rows: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Ascending pairs of text beginning and id that cut the rows into about equal ranges.

    The sample has ``SAMPLES_PER_RANGE * ranges`` rows on average, whatever the
    number of rows, and only steers where rows go.
    """
    total = rows.count()
    if not total or ranges < 2:
        return []
    share = min(1.0, SAMPLES_PER_RANGE * ranges / total)
    sample = sorted((r[0], r[1]) for r in rows.sample(share, seed=7).select("_head", "_id").collect())
    step = max(1, len(sample) // ranges)
    return sorted(set(sample[step::step]))


def _cut_table(cuts: list[tuple[str, int]]) -> Column:
    return F.from_json(F.lit(json.dumps([{"h": h, "k": k} for h, k in cuts])), "array<struct<h:string,k:bigint>>")


def range_of(head: Column, key: Column, cuts: list[tuple[str, int]]) -> Column:
    """How many splitters are at or below the pair, by binary search."""
    if not cuts:
        return F.lit(0)
    table = _cut_table(cuts)
    strides = [1 << b for b in reversed(range(len(cuts).bit_length()))]

    def step(at: Column, stride: Column) -> Column:
        cut = F.get(table, at + stride - 1)
        low = (cut["h"] < head) | ((cut["h"] == head) & (cut["k"] <= key))
        return F.when(F.coalesce(low, F.lit(False)), at + stride).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in strides]), F.lit(0), step)


def in_several(head: Column, number: Column, cuts: list[tuple[str, int]]) -> Column:
    """Whether a splitter at either end of the range has this text beginning, so that equal texts may be in other ranges."""
    if not cuts:
        return F.lit(False)
    table = _cut_table(cuts)
    ends = [F.when((number + i >= 0), F.get(table, number + i)["h"] == head) for i in (-1, 0)]
    return F.coalesce(ends[0], F.lit(False)) | F.coalesce(ends[1], F.lit(False))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with the row that stays for its text.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``. Texts are equal
    if they are identical once each run of white space is one space; a null text
    is empty. Of equal texts the smallest id stays, null ids come last, and of
    rows that repeat that id one stays. No rows in, no rows out.
    """
    rows = text_rows(docs, id_column, text_column).select(
        "doc_id", normalised(F.col("text")).alias("_norm")
    ).withColumn("_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("_head", F.substring("_norm", 1, HEAD))
    cuts = splitters(rows, 4 * partitions_of(docs))
    ranged = rows.select("doc_id", "_norm", "_id", range_of(F.col("_head"), F.col("_id"), cuts).alias("_range"))
    order = Window.partitionBy("_range").orderBy("_norm", "_id")
    new = F.coalesce(F.col("_norm") != F.lag("_norm").over(order), F.lit(True))
    marked = ranged.withColumn("_new", new)
    run = F.sum(F.col("_new").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    slim = stored(marked.select(
        "_range", run.alias("_run"), "_new", "doc_id", digest(F.col("_norm")).alias("text_sha256")
    ))
    runs = slim.groupBy("_range", "_run", "text_sha256").agg(F.min("doc_id").alias("_min"), F.count("*").alias("_rows"))
    groups = runs.groupBy("text_sha256").agg(
        F.min("_min").alias("keep_id"), F.sum("_rows").alias("group_size"), F.min("_range").alias("_first")
    )
    known = runs.drop("_min", "_rows").join(groups, "text_sha256").drop("text_sha256")
    return slim.join(known, ["_range", "_run"]).select(
        "doc_id", "keep_id", "group_size", (F.col("_new") & (F.col("_range") == F.col("_first"))).alias("kept"), "text_sha256"
    )


def _head(text: Column) -> Column:
    """How the normalised text begins; most texts need not be normalised as a whole for it."""
    front = normalised(F.left(text, F.lit(8 * HEAD)))
    return F.substring(F.when(F.length(front) >= HEAD, front).otherwise(normalised(text)), 1, HEAD)


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, of which ``exact_duplicates`` keeps the id; of equal rows one.

    Rows go through the content sort whole, once, and the first of each run of
    equal texts is written. Only runs that a splitter cuts are looked at again,
    by digests. Null ids come last; of rows that repeat an id and a text, those
    alike but for white space included, the first by its text stays. No rows in,
    no rows out.
    """
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text.alias("_text"), _head(text).alias("_head"),
        F.coalesce(docs[id_column].cast("long"), F.lit((1 << 63) - 1)).alias("_id"),
    )
    cuts = splitters(rows, 4 * partitions_of(docs))
    head = F.col("_head")
    ranged = rows.withColumn("_range", range_of(head, F.col("_id"), cuts)).withColumn("_split", in_several(head, F.col("_range"), cuts))
    dealt = ranged.select("_row", "_id", "_range", "_split").repartition(partitions_of(docs), "_range")
    # Normalised only now, so that one text moves and not two.
    raw = F.coalesce(F.col("_row")[text_column].cast("string"), F.lit(""))
    order = Window.partitionBy("_range").orderBy("_norm", "_id", "_raw")
    marked = dealt.withColumns({"_raw": raw, "_norm": normalised(raw)}).withColumn("_before", F.lag("_norm").over(order))
    new = F.coalesce(F.col("_norm") != F.col("_before"), F.lit(True))
    firsts = stored(marked.filter(new).select("_row", "_range", "_split", F.when(F.col("_split"), digest(F.col("_norm"))).alias("_digest")))
    split = firsts.filter("_split")
    least = split.groupBy("_digest").agg(F.min("_range").alias("_range"))
    kept = firsts.filter("not _split").select("_row").union(split.join(least, ["_digest", "_range"], "left_semi").select("_row"))
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
