"""Language identification by n-gram filters that hold all languages at once.

A language's n-grams are those that make up at least ``MIN_SHARE`` of all n-grams
of its training texts, counted over all of them. Each language has a Bloom filter
of the same size and the same hashes, and the filters are sliced by bit: a
position holds one word whose bit L says whether the filter of language L is set
there. The words at an n-gram's positions, joined by AND, are the set of all
languages that have it.

A text's n-grams are looked up once each time they occur, and the bits of the
words are counted for each language. A filter says yes by mistake at a known
rate, its share of set bits to the power of the hashes, so that the hits of a
language are corrected for it. The language with most corrected hits decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stored import stored
from .common import U64, mixed, slices

#: Characters of an n-gram, and the least share of a language's n-grams that one of its own has.
#: No language has more than 1 / ``MIN_SHARE`` of them, which bounds the filters.
GRAM, MIN_SHARE = 4, 2e-5
#: Hashes of a filter, and positions for each n-gram of the largest language at least.
HASHES, ROOM = 4, 12
#: Languages that one model takes at most.
MOST_LANGUAGES = 256
#: Characters of a text that are worked on at a time; words stay whole.
CHUNK = 1 << 20
WORD = 64
UNKNOWN = "und"


def letters_of(text: Column) -> Column:
    """Words of letters in lower case, one space before and after each; a null text has none."""
    words = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _factors(count: int) -> np.ndarray:
    return mixed(np.arange(101, 101 + count, dtype=U64)) | U64(1)


def grams(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words with the spaces around them, and their text numbers.

    Texts are as ``letters_of`` gives them. An n-gram of a word shorter than
    ``size`` is the word with both its spaces.
    """
    joined = "".join(texts.to_pylist())
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    blank = codes == 32
    spaces = np.flatnonzero(blank)
    # How far the next space is, which ends an n-gram that begins here; a text's last space begins none.
    after = np.cumsum(blank)
    reach = np.append(spaces, len(codes))[after] - np.arange(len(codes)) + 1
    factors = _factors(size + 1)
    found, of = [], []
    for width in range(3, size + 1):
        starts = reach >= size if width == size else blank & (reach == width)
        at = np.flatnonzero(starts[: max(0, len(codes) - width + 1)])
        at = at[owner[at] == owner[at + width - 1]]
        hashes = np.repeat(factors[size:] * U64(width), len(at))
        for j in range(width):
            hashes += codes[at + j].astype(U64) * factors[j]
        found.append(hashes)
        of.append(owner[at])
    return mixed(np.concatenate(found)), np.concatenate(of)


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts as they are; a single long one in pieces that end with words, as n-grams do."""
    if len(texts) != 1 or len(text := texts[0].as_py()) <= CHUNK:
        yield texts
        return
    start = 0
    while start < len(text) - 1:
        stop = text.find(" ", min(start + CHUNK, len(text) - 1))
        yield pa.array([text[start : stop + 1]], pa.string())
        start = stop


def _counts(size: int):
    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs = part.column("lang").dictionary_encode()
            for texts in chunks(part.column("text")):
                hashes, of = grams(texts, size)
                codes = langs.indices.to_numpy(zero_copy_only=False)[of]
                for code, name in enumerate(langs.dictionary):
                    seen, count = np.unique(hashes[codes == code], return_counts=True)
                    yield pa.record_batch([
                        pa.array([name.as_py()] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(count.astype(np.int64)),
                    ], ["lang", "gram", "hits"])

    return counts


def held_out(doc_id: Column) -> Column:
    """Rows kept from the fit: crc32 of the id as text leaves 2 modulo 4. Rows without id aren't."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def positions(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of n-grams in filters of 2 to the power ``bits`` positions, one hash after the other."""
    step = mixed(hashes ^ U64(0x5851F42D4C957F2D)) | U64(1)
    for i in range(HASHES):
        yield ((hashes + U64(i) * step) >> U64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Filters:
    """Bloom filters of all languages, sliced by bit.

    ``words`` has a row for each 64 languages and a column for each position.
    ``mistakes`` is the rate at which each filter says yes to an n-gram it
    doesn't hold.
    """

    languages: tuple[str, ...]
    bits: int
    size: int
    words: np.ndarray
    mistakes: np.ndarray

    def sets(self, hashes: np.ndarray, row: int) -> np.ndarray:
        """For each n-gram, the languages among 64 that have it, as bits."""
        found = np.full(len(hashes), ~U64(0))
        for at in positions(hashes, self.bits):
            found &= self.words[row][at]
        return found

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits of each language (columns) in each text (rows), and the texts' n-grams."""
        table, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for part in chunks(texts):
            hashes, of = grams(part, self.size)
            count += np.bincount(of, minlength=len(texts))
            for language in range(len(self.languages)):
                if language % WORD == 0:
                    sets = self.sets(hashes, language // WORD)
                has = ((sets >> U64(language % WORD)) & U64(1)).astype(bool)
                table[:, language] += np.bincount(of[has], minlength=len(texts))
        return np.maximum(0, table - count[:, None] * self.mistakes) / (1 - self.mistakes), count

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's language by number, and its share of all languages' corrected hits."""
        hits, _ = self.hits(texts)
        best = hits.argmax(axis=1)  # of equal ones the first, which has most training n-grams
        total = hits.sum(axis=1)
        score = np.divide(hits[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0)
        return best, score


def build(languages: list[str], language: np.ndarray, hashes: np.ndarray, size: int = GRAM) -> Filters:
    """Filters that hold, for each n-gram of ``hashes``, the language numbered ``language``."""
    largest = int(np.bincount(language, minlength=1).max()) if len(language) else 1
    bits = max(10, int(np.ceil(log2(max(1, largest * ROOM)))))
    words = np.zeros((max(1, -(-len(languages) // WORD)), 1 << bits), U64)
    bit = U64(1) << (language % WORD).astype(U64)
    for at in positions(hashes, bits):
        np.bitwise_or.at(words, (language // WORD, at), bit)
    filled = [((words[i // WORD] >> U64(i % WORD)) & U64(1)).mean() for i in range(len(languages))]
    # A filter that is full tells nothing: all its hits may be mistakes.
    mistakes = np.minimum(np.array(filled, float).reshape(-1) ** HASHES, 1 - 1e-9)
    return Filters(tuple(languages), bits, size, words, mistakes)


def fit_languages(docs: DataFrame, size: int = GRAM, min_share: float = MIN_SHARE, id_column: str = "doc_id", text_column: str = "text") -> Filters:
    """Filters from the texts of all rows that have a language and aren't held out.

    Counts cover all of these texts; they are added up in each task before the
    shuffle. What comes to the driver is at most 1 / ``min_share`` n-grams for
    each of ``MOST_LANGUAGES`` languages; with more languages this fails.
    """
    known = docs.select(
        docs[id_column].alias("id"), letters_of(docs[text_column]).alias("text"), docs["lang"].cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & ~held_out(F.col("id"))).select("lang", "text")
    seen = known.mapInArrow(_counts(size), "lang string, gram long, hits long")
    counts = stored(seen.groupBy("lang", "gram").agg(F.sum("hits").alias("hits")))
    totals = stored(counts.groupBy("lang").agg(F.sum("hits").alias("total")))
    if totals.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = [r.lang for r in totals.orderBy(F.desc("total"), "lang").collect()]
    chosen = counts.join(totals, "lang").filter(F.col("hits") >= min_share * F.col("total")).select("lang", "gram").toArrow()
    number = {name: i for i, name in enumerate(names)}
    encoded = chosen.column("lang").combine_chunks().dictionary_encode()
    of = np.array([number[name] for name in encoded.dictionary.to_pylist()], np.int64)[encoded.indices.to_numpy(zero_copy_only=False)]
    hashes = chosen.column("gram").to_numpy().view(np.uint64)
    return build(names, of, hashes, size)


def predict_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    ``lang_pred`` is a language of the training rows, or ``und`` if the text is
    null or has no letter, or if there are no training rows; then the score is 0.
    The score is the winner's share of all languages' corrected hits. A text
    whose n-grams no language has gets the language with most training n-grams,
    with a score of 0; ties go to that language too, then by name. Rows that
    repeat are predicted each; rows without id are not held out. No rows in, no
    rows out.
    """
    filters = fit_languages(docs, id_column=id_column, text_column=text_column)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    text = docs[text_column].cast("string")

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        for part in slices(batches):
            best, score = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
            if model.languages:
                some = part.column("some").to_numpy(zero_copy_only=False)
                found = model.decide(part.column("text"))
                best, score = np.where(some, found[0], best), np.where(some, found[1], score)
            yield pa.record_batch([
                part.column("doc_id"), part.column("held_out"), names.take(pa.array(best)), pa.array(score),
            ], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(
        docs[id_column].cast("long").alias("doc_id"), held_out(docs[id_column]).alias("held_out"), letters_of(docs[text_column]).alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("some"),
    )
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
