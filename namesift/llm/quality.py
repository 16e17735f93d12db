"""Quality scores from a sparse ensemble of rules.

Boosted trees over statistics of a text propose rules: each path from a root is
a conjunction of thresholds. A logistic model with a lasso penalty over these
rules keeps few of them. What is left is compiled into one Spark column
expression over the statistics, so that scoring is a projection.

Only the fit is bounded: it sees at most ``TRAIN_ROWS`` labelled rows, those
first by a hash of the id. Every row is scored on its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHED_BYTES, U64, bytes_of, mixed, slices, windows_in_texts, words_of

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
LASSO, STEPS = 0.002, 400

STATISTICS = (
    "words", "word_bytes", "letters", "capitals", "digits", "symbols", "spaces", "line_bytes",
    "repeats", "distinct", "bare_symbols", "symbol_ends", "short_words", "exclamations",
)

_CODE = np.arange(256)
_CAPITAL = (_CODE >= 65) & (_CODE <= 90)
_SMALL = (_CODE >= 97) & (_CODE <= 122)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_SPACE = np.isin(_CODE, [32, 9, 10, 11, 12, 13])
_LETTER = _CAPITAL | _SMALL | (_CODE >= 128)
_SYMBOL = (_CODE > 32) & (_CODE < 127) & ~(_LETTER | _DIGIT)
_SYMBOL_END = _SYMBOL & ~np.isin(_CODE, list(b".,;:?!'\")"))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; shares of nothing are 0."""
    data, offsets = bytes_of(texts)
    n, size = len(texts), np.diff(offsets)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    def share(part, whole):
        return np.divide(part, whole, out=np.zeros(n), where=whole > 0)

    starts, ends, hashes, owner = words_of(data, offsets)

    def words(flags=None, of=owner):
        return np.bincount(of if flags is None else of[flags], minlength=n).astype(float)

    n_words = words()
    pairs = windows_in_texts(owner, 2)
    again = pairs[hashes[pairs] == hashes[pairs + 1]]
    own = mixed(hashes + owner.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, first = np.unique(own, return_index=True)
    with_letter = np.concatenate(([0], np.cumsum(_LETTER[data] | _DIGIT[data])))
    bare = with_letter[ends] == with_letter[starts]
    letters = count(_LETTER[data])
    return np.column_stack([
        np.log1p(n_words), share(np.bincount(owner, ends - starts, n), n_words), share(letters, size),
        share(count(_CAPITAL[data]), count((_CAPITAL | _SMALL)[data])), share(count(_DIGIT[data]), size),
        share(count(_SYMBOL[data]), size), share(count(_SPACE[data]), size), np.log1p(size / (count(data == 10) + 1)),
        share(words(of=owner[again]), n_words), share(words(of=owner[first]), n_words), share(words(bare), n_words),
        share(words(_SYMBOL_END[data[ends - 1]]) if len(ends) else np.zeros(n), n_words),
        share(words(ends - starts <= 3), n_words), share(count(data == 33), size),
    ])


@F.arrow_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in STATISTICS]))
def text_statistics(texts: pa.Array) -> pa.Array:
    """``STATISTICS`` of each text as a struct; a null text counts as empty."""
    texts = pa.compute.fill_null(texts, "")
    parts = [statistics(part.column("text")) for part in slices([pa.record_batch([texts], ["text"])], limit=CACHED_BYTES)]
    table = np.concatenate(parts) if parts else np.empty((0, len(STATISTICS)))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], list(STATISTICS))


#: A statistic's number, a threshold, and whether the value must be above it.
Condition = tuple[int, float, bool]


@dataclass(frozen=True)
class Rules:
    """Conjunctions with their weights; a score is the logistic of the sum of those that hold."""

    intercept: float
    weighted: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, stats: Column) -> Column:
        """The rules as one column expression over a struct of statistics."""
        total = F.lit(float(self.intercept))
        for conditions, weight in self.weighted:
            holds = F.lit(True)
            for statistic, threshold, above in conditions:
                value = stats[STATISTICS[statistic]]
                holds = holds & ((value > threshold) if above else (value <= threshold))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for statistic, threshold, above in rule:
        held &= (x[:, statistic] > threshold) == above
    return held


def propose_rules(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """The paths of boosted trees, each once."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    margin = np.full(len(y), np.log(rate / (1 - rate)))
    rules: dict[tuple[Condition, ...], None] = {}

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        found = (1e-6, -1, -1)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            code = codes[f][rows]
            gl = np.cumsum(np.bincount(code, g[rows], len(cut) + 1))
            hl = np.cumsum(np.bincount(code, h[rows], len(cut) + 1))
            gain = gl[:-1] ** 2 / (hl[:-1] + 1) + (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + 1) - whole
            at = int(np.argmax(gain))
            if gain[at] > found[0]:
                found = (float(gain[at]), f, at)
        return found

    def grow(rows, path, g, h, depth):
        gain, f, at = best(rows, g, h) if depth and len(rows) > 10 else (0, -1, -1)
        if f < 0:
            margin[rows] -= RATE * g[rows].sum() / (h[rows].sum() + 1)
            return
        above = codes[f][rows] > at
        for side in (False, True):
            rule = (*path, (f, float(cuts[f][at]), side))
            rules[tuple(sorted(rule))] = None
            grow(rows[above == side], rule, g, h, depth - 1)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), (), p - y, p * (1 - p), DEPTH)
    return list(rules)


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules and lasso weights for statistics ``x`` and labels ``y`` of 0 and 1.

    Without rows of both labels there is nothing to tell apart: the score is
    then the share of label 1, or 1 without any row.
    """
    if not len(y) or y.min() == y.max():
        return Rules(20.0 if not len(y) or y.min() == 1 else -20.0, ())
    rules = propose_rules(x, y)
    held = np.column_stack([_holds(x, r) for r in rules]).astype(float)
    centre = held.mean(axis=0)
    a = held - centre
    bound = np.linalg.norm(a, 2) ** 2 / (4 * len(y)) + 0.25
    w = v = np.zeros(len(rules))
    b, t = 0.0, 1.0
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-(a @ v + b))) - y
        step = v - a.T @ miss / len(y) / bound
        after = np.sign(step) * np.maximum(np.abs(step) - LASSO / bound, 0)
        b -= miss.mean() / 0.25
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = after + (t - 1) / t_after * (after - w), after, t_after
    kept = [(r, float(c)) for r, c in zip(rules, w, strict=True) if c]
    return Rules(float(b - centre @ w), tuple(kept))


def held_out(doc_id: Column) -> Column:
    """Rows kept from the fit: crc32 of the id as text leaves 1 modulo 3. Rows without id aren't."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Rules:
    """Rules fitted to at most ``TRAIN_ROWS`` labelled rows that aren't held out.

    Labels without id or quality don't count; of several for one id the highest does.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = known.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS).collect()
    if not chosen:
        return fit_rules(np.empty((0, len(STATISTICS))), np.empty(0))
    table = spark.createDataFrame(chosen, "_id long, _label int")
    rows = docs.select(docs[id_column].cast("long").alias("_id"), docs[text_column].cast("string").alias("_text"))
    rows = rows.join(F.broadcast(table), "_id").select("_id", "_label", text_statistics("_text").alias("_stats"))
    flat = rows.select("_id", "_label", "_stats.*").orderBy(F.xxhash64("_id"), "_id", *STATISTICS).limit(TRAIN_ROWS).toPandas()
    return fit_rules(flat[list(STATISTICS)].to_numpy(float), flat["_label"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    A null or empty text has statistics of 0 and is scored like any other. Rows
    that repeat are scored each. No rows in, no rows out.
    """
    rules = fit_quality(docs, labels, id_column, text_column)
    key = docs[id_column].cast("long")
    scored = docs.select(key.alias("doc_id"), text_statistics(docs[text_column].cast("string")).alias("_stats"))
    scored = scored.select("doc_id", rules.score(F.col("_stats")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with their own columns, that the fitted rules don't reject."""
    rules = fit_quality(docs, labels, id_column, text_column)
    return docs.filter(rules.score(text_statistics(docs[text_column].cast("string"))) >= 0.5)
