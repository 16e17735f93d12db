"""Preparing a corpus for training: from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame that is written and read again as the next one's docs.
All stages but the last return the columns of their docs, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm import exact, minhash, packing, quality, suffixes
from namesift.llm.queries import tokenizer_path
from namesift.operators.stored import stored


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, fitted to ``labels``, don't reject.

    Rows that repeat, and rows without id or text, are judged each by their own
    text; an empty table stays empty.
    """
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space, that with the smallest id.

    Null texts are empty ones, null ids come last, and of rows that repeat an id
    and text one stays.
    """
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Groups are linked at 80 percent of shared five-word shingles. Rows without id
    and texts without words have no near-duplicates and stay.
    """
    return minhash.without_near_copies(docs, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one holds; ``n_chars`` follows the text.

    Rows without id count as last, rows that repeat an id not as earlier than one
    another.
    """
    cut = suffixes.without_repeats(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of several lengths; a null text is its end mark alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs)
    return docs


#: The rules, bands and packing orders of the stages have no form in SQL.
ORACLE_SQL = None
