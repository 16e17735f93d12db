"""Tokens of file names and their counts, computed row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import stem

# Runs of plain letters or of digits (fixed value); all else separates.
TOKEN = r"[a-z]+|\p{Nd}+"


def tokenize(name: Column) -> Column:
    """Lower-cased tokens of the stem, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(stem(name)), F.lit(TOKEN), F.lit(0))


def token_bag(name: Column) -> Column:
    """Tokens in sorted order, joined by spaces.

    Names with equal bags score alike against every other name.
    """
    return F.array_join(F.sort_array(tokenize(name)), " ")


def bag_tokens(bag: Column) -> Column:
    """Tokens of a bag, repeats kept; an empty bag has none."""
    return F.filter(F.split(bag, " "), lambda token: token != "")


def term_counts(tokens: Column) -> Column:
    """Array of (token, tf), one per distinct token."""
    return F.transform(
        F.array_distinct(tokens),
        lambda token: F.struct(
            token.alias("token"),
            F.size(F.filter(tokens, lambda other: other == token)).cast("bigint").alias("tf"),
        ),
    )
