"""Pairwise scores and their display texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from .names import stem
from .tokens import term_counts, tokenize

# Defaults and limits (fixed values).
DEFAULT_NAME_THRESHOLD = 0.7
NAME_WEIGHT = 0.6
SIZE_WEIGHT = 0.4
NAME_EXACT = 0.95
NAME_VERY_SIMILAR = 0.8
SIZE_EXACT = 0.99
SIZE_VERY_CLOSE = 0.95
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")

#: Numbers that the character places of a batch of texts take at most, but for a single text.
MOST_WORDS = 4 << 20


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of matching characters of two texts, by longest common blocks.

    No built-in computes it. The measure depends on the order of its
    arguments.
    """
    return pd.Series(
        [
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


def _bits(texts: list[str], codes: dict[str, int], words: int) -> np.ndarray:
    """For each text and character code, the text's places of that character as bits of ``words`` numbers."""
    table = np.zeros((len(texts), len(codes) + 1, words), np.uint64)
    for row, text in zip(table, texts, strict=True):
        for at, c in enumerate(text):
            row[codes[c], at // 64] |= np.uint64(1 << at % 64)
    return table


def common_subsequence(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Length of the longest common subsequence of each pair, for all pairs at once.

    Bit i of a pair's state says whether character i of the left text adds
    nothing yet; each character of the right text changes all of them by one
    addition.
    """
    sides = [side.dictionary_encode() for side in (left, right)]
    of_left, of_right = (s.indices.to_numpy(zero_copy_only=False) for s in sides)
    lefts, rights = (s.dictionary.to_pylist() for s in sides)
    codes = {c: i for i, c in enumerate(sorted(set().union(*lefts)))}
    words = max(1, -(-max(map(len, lefts), default=0) // 64))
    if len(left) > 1 and len(lefts) * (len(codes) + 1) * words > MOST_WORDS:
        half = len(left) // 2
        return np.concatenate([common_subsequence(left[:half], right[:half]), common_subsequence(left[half:], right[half:])])
    table = _bits(lefts, codes, words)
    longest = max(map(len, rights), default=0)
    coded = np.full((longest, len(rights)), len(codes), np.int64)  # the last code stands for no character of any left text
    for j, text in enumerate(rights):
        coded[: len(text), j] = [codes.get(c, len(codes)) for c in text]
    state = np.full((words, len(left)), ~np.uint64(0))
    for place in coded:
        places = table[of_left, place[of_right]]
        carry = np.zeros(len(left), np.uint64)
        for w in range(words):
            old = state[w]
            hit = old & places[:, w]
            total = old + hit
            carried = total + carry
            carry = ((total < old) | (carried < total)).astype(np.uint64)
            state[w] = carried | (old & ~hit)
    sizes = np.array([len(t) for t in lefts], np.int64)[of_left]
    found = np.zeros(len(left), np.int64)
    for w in range(words):
        inside = np.clip(sizes - 64 * w, 0, 64)
        unused = ~state[w] & np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside % 64).astype(np.uint64)) - np.uint64(1))
        found += np.bitwise_count(unused)
    return found


@F.arrow_udf(BooleanType())
def subsequence_reaches(left: pa.Array, right: pa.Array, threshold: pa.Array) -> pa.Array:
    """Whether the longest common subsequence allows a sequence similarity of the threshold."""
    if not len(left):
        return pa.array([], pa.bool_())
    both = (pa.compute.utf8_length(left).to_numpy(zero_copy_only=False) + pa.compute.utf8_length(right).to_numpy(zero_copy_only=False)).astype(float)
    ratio = np.divide(2.0 * common_subsequence(left, right), both, out=np.ones(len(left)), where=both > 0)
    return pa.array(ratio >= threshold.to_numpy(zero_copy_only=False))


def name_similarity(name1: Column, name2: Column) -> Column:
    """Sequence similarity of two lower-cased stems."""
    return sequence_ratio(F.lower(stem(name1)), F.lower(stem(name2)))


def tfidf_similarity(name1: Column, name2: Column, idf: Column) -> Column:
    """Cosine of two names under a given map of token to idf.

    Tokens missing from the map weigh 1.0. For scoring given pairs; the
    matching job does not use it.
    """

    def weights(name: Column) -> Column:
        return F.map_from_entries(
            F.transform(
                term_counts(tokenize(name)),
                lambda t: F.struct(t["token"], t["tf"] * F.coalesce(idf[t["token"]], F.lit(1.0))),
            )
        )

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    left, right = weights(name1), weights(name2)
    dot = total(
        F.transform(F.map_entries(left), lambda e: e["value"] * F.coalesce(right[e["key"]], F.lit(0.0)))
    )
    norms = [F.sqrt(total(F.transform(F.map_values(m), lambda v: v * v))) for m in (left, right)]
    known = name1.isNotNull() & name2.isNotNull()
    return F.when(known & ((norms[0] == 0) | (norms[1] == 0)), F.lit(0.0)).otherwise(
        dot / F.nullif(norms[0] * norms[1], F.lit(0.0))
    )


def size_similarity(size1: Column, size2: Column) -> Column:
    """Smaller size over larger; two empty files agree fully."""
    smaller, larger = F.least(size1, size2), F.greatest(size1, size2)
    both = size1.isNotNull() & size2.isNotNull()
    return F.when(both & (size1 == size2), F.lit(1.0)).when(
        both, smaller.cast("double") / F.nullif(larger, F.lit(0)).cast("double")
    )


def confidence(name_sim: Column, size_sim: Column, mode: str = "weighted") -> Column:
    """Overall score: weighted mean of both, or the name score alone."""
    if mode == "name":
        return name_sim
    if mode != "weighted":
        raise ValueError(f"unknown confidence mode {mode!r}")
    return name_sim * NAME_WEIGHT + size_sim * SIZE_WEIGHT


def match_reasons(name_sim: Column, size_sim: Column) -> Column:
    """One phrase on the names and one on the sizes. The phrases are fixed values."""
    on_name = (
        F.when(name_sim >= NAME_EXACT, "Name exact match")
        .when(name_sim >= NAME_VERY_SIMILAR, "Name very similar")
        .otherwise("Name similar")
    )
    on_size = (
        F.when(size_sim >= SIZE_EXACT, "Size exact match")
        .when(size_sim >= SIZE_VERY_CLOSE, "Size very close")
        .otherwise("Size similar")
    )
    return F.when(
        name_sim.isNotNull() & size_sim.isNotNull(), F.concat_ws(", ", on_name, on_size)
    )


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _one_decimal(number: Column) -> Column:
    """A number with one decimal, rounded half to even on its exact binary value.

    Ten times the number is a sum of two exact products; the rounding error of
    that sum is exact as well, and its sign decides where the sum alone is a tie.
    """

    def written(value: Column) -> Column:
        eight, two = F.abs(value) * 8.0, F.abs(value) * 2.0
        tenfold = eight + two
        rest = tenfold - eight
        error = (eight - (tenfold - rest)) + (two - rest)
        parts = F.struct(F.floor(tenfold).alias("whole"), (tenfold - F.floor(tenfold)).alias("part"), error.alias("error"))

        def tenths(p: Column) -> Column:
            odd = p["whole"] % 2 == 1
            up = (p["part"] > 0.5) | ((p["part"] == 0.5) & ((p["error"] > 0) | ((p["error"] == 0) & odd)))
            return p["whole"] + F.when(up, 1).otherwise(0)

        digits = _bound(_bound(parts, tenths), lambda t: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string")))
        # From 2^50 on a double has no second decimal.
        return F.when(F.abs(value) < float(1 << 49), F.concat(F.when(value < 0, "-").otherwise(""), digits)).otherwise(
            F.format_string("%.1f", value)
        )

    # Far from a tie the tenths are those of any rounding.
    tenfold = F.abs(number) * 10.0
    clear = (tenfold < 1e9) & (F.abs(tenfold - F.floor(tenfold) - 0.5) > 1e-4)
    nearest = F.floor(tenfold + 0.5)
    whole, tenth = F.call_function("div", nearest, F.lit(10)), nearest % 10
    plain = F.concat(F.when(number < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), tenth.cast("string"))
    return F.when(clear, plain).otherwise(_bound(number, written))


def format_size(size: Column) -> Column:
    """Size in the largest unit that keeps the number below 1024."""
    divisor, unit = F.lit(float(1024 ** (len(SIZE_UNITS) - 1))), F.lit(SIZE_UNITS[-1])
    for power, name in reversed(list(enumerate(SIZE_UNITS[:-1]))):
        fits = size < 1024 ** (power + 1)
        divisor, unit = F.when(fits, float(1024**power)).otherwise(divisor), F.when(fits, name).otherwise(unit)
    return F.when(size.isNotNull(), F.concat(_one_decimal(size.cast("double") / divisor), F.lit(" "), unit))


def format_percent(share: Column) -> Column:
    """Share as a percentage with one decimal."""
    return F.when(share.isNotNull(), F.concat(_one_decimal(share * 100), F.lit("%")))
