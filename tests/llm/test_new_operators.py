"""The trie of conversations, language filters and Merkle manifest, on small tables with awkward rows."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from namesift.llm import languages, merkle, tries  # noqa: E402
from namesift.llm.queries import QUERIES  # noqa: E402
from namesift.llm.queries import table as read  # noqa: E402

SF = "/root/testdata/sf0.001"


def by_row(row):
    return [(v is not None, v if v is not None else 0) for v in row]


def same(found, want):
    assert sorted(map(tuple, found), key=by_row) == sorted(want, key=by_row)


TURNS = "conv_id long, turn long, role string, text string, key string, shard long, node int, bytes string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "b") for r in rows], TURNS).repartition(3)


def talks(seed=1):
    r = random.Random(seed)
    rows = []
    for c in range(60):
        rows += [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "ß", "", None])) for t in range(r.randint(1, 12))]
    rows += [(c, t, "user", "all the same") for c in range(100, 160) for t in range(4)]  # copies
    rows += [(None, 1, "user", "lost"), (7, None, "user", "no turn"), (7, None, None, None), (7, 1, "user", "a"), (7, 1, "user", "a")]
    rows += [(-3, 0, "user", "below"), (-5, 0, "user", "giver below")]
    rows += [(300, t, "user", f"long {t % 7}") for t in range(150)] + [(301, t, "user", f"long {t % 7}") for t in range(150)]
    return rows


@pytest.mark.parametrize("shard_turns", [5, 100, 100_000])
def test_trie_equals_brute_force(spark, shard_turns):
    rows = talks()
    found = tries.prefix_trie(talk(spark, rows), shard_turns).collect()
    same(found, brute.prefix_trie(rows))


def test_trie_of_nothing_of_one_turn_and_of_one_conversation_in_many(spark):
    assert tries.prefix_trie(talk(spark, [])).count() == 0
    assert tries.prefix_trie(talk(spark, [(None, 1, "user", "x")])).count() == 0
    for rows in ([(4, 1, "user", "x")], [(c, t, "user", str(t)) for c in range(0, 500, 5) for t in range(3)]):
        same(tries.prefix_trie(talk(spark, rows), 20).collect(), brute.prefix_trie(rows))


def test_search_trees_are_balanced():
    tree = tries.Ternary()
    for i in tries.medians_first(1023):
        tree.insert([i], i, 1, i)
    height, level = 0, [tree.down[0]]
    while level:
        height, level = height + 1, [n for at in level for n in (tree.low[at], tree.high[at]) if n >= 0]
    assert height == 10


ROWS = "doc_id long, source string, lang string, n_chars long, text string, key string, leaf string, place long, rank long, path string"


def leaves(spark, rows):
    return spark.createDataFrame([(*r, "k", "l", 3, 4, "p") for r in rows], ROWS).repartition(3)


def awkward_rows():
    r = random.Random(2)
    rows = [(i, r.choice(["s", None, "ß"]), r.choice(["en", "de", "日本", "z", None]), r.choice([None, 0, 9, 99]), r.choice(["", None, "x" * 9, "日本"])) for i in range(90)]
    rows += [(None, None, None, None, None), (None, "s", "en", 5, "t"), (3, "s", "en", 5, "t"), (3, "s", "en", 5, "t"), (-8, "s", "en", 9, "-")]
    rows += [(1000 + i, "s", "fr", 3, "y") for i in range(1100)]  # more than one block, the last not full
    rows += [(5000, "s", "alone", (1 << 63) - 1, "x" * 100_000)]
    return rows


def test_manifest_equals_brute_force(spark):
    rows = awkward_rows()
    same(merkle.manifest(leaves(spark, rows)).collect(), brute.manifest(rows))


def test_manifest_over_many_steps(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SIZE", 4)
    rows = [(i, "s", f"l{i % 23}" if i % 3 else "en", i, "t") for i in range(300)]
    same(merkle.manifest(leaves(spark, rows)).collect(), brute.manifest(rows))


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(leaves(spark, [])).collect() == []
    for rows in ([(7, "s", "en", 1, "t")], [(7, "s", None, 1, "t"), (8, "s", "", 1, "t")]):
        same(merkle.manifest(leaves(spark, rows)).collect(), brute.manifest(rows))


def test_tampering_shows(spark):
    found = merkle.manifest(leaves(spark, awkward_rows())).collect()
    assert any(not r.verified for r in found)
    for r in found:
        assert r.verified == (r.folded_root == r.root)


def prose(seed, words, letters):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(words))


LETTERS = {"aa": "abcde", "bb": "defgh", "cc": "日本語中"}
DOCS = "doc_id long, text string, lang string, source string, id int, some string, held_out int"


def speech(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "x", 2) for r in rows], DOCS).repartition(3)


def corpus():
    return [(i, prose(i, 40, LETTERS[lang]), lang) for i, lang in enumerate(list(LETTERS) * 40)]


def out_of_fit(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_languages(spark):
    odd = [(None, "edcba abcde", "aa"), (900, None, "aa"), (901, "", "bb"), (902, "12 .!", "bb"), (903, "abcab cabba", None), (903, "fghh gfhg", None),
           (904, "Ωμέγα", None), (905, "DE GH!", None), (906, "中" * 3000, None), (907, prose(5, 3000, "abcde"), None)]
    rows = corpus() + odd
    found = languages.predict_languages(speech(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out) for r in found) == sorted((i is None, i or 0, out_of_fit(i)) for i, _, _ in rows)
    lang = {r.doc_id: r.lang_pred for r in found}
    assert [lang[i] for i, _, _ in corpus()] == [x for _, _, x in corpus()]
    assert [lang[i] for i in (900, 901, 902, 905, 906, 907)] == ["und", "und", "und", "bb", "cc", "aa"]
    assert {r.lang_pred for r in found if r.doc_id == 903} == {"aa", "bb"}
    unknown = next(r for r in found if r.doc_id == 904)
    assert unknown.lang_pred in LETTERS and unknown.score == 0
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_are_not_inputs(spark):
    rows = corpus()
    swapped = [(i, t, {"aa": "bb", "bb": "aa", "cc": None}[x] if out_of_fit(i) else x) for i, t, x in rows]
    a, b = (sorted(map(tuple, languages.predict_languages(speech(spark, r)).collect())) for r in (rows, swapped))
    assert a == b


def test_languages_without_training_rows(spark):
    assert languages.predict_languages(speech(spark, [])).count() == 0
    found = languages.predict_languages(speech(spark, [(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]


def test_grams_equal_plain_python():
    texts = [" das ist a ", "  ", " ßü ", " 日本語テキスト "]
    want = []
    for i, text in enumerate(texts):
        for word in text.split():
            word = f" {word} "
            want += [(i, word[j : j + 4]) for j in range(max(1, len(word) - 3))]
    hashes, of = languages.grams(pa.array(texts), 4)
    assert sorted(of.tolist()) == sorted(i for i, _ in want)
    assert len(set(hashes.tolist())) == len({g for _, g in want})


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " " + prose(3, 500, "abcde") + " "
    whole = sorted(languages.grams(pa.array([text]), 4)[0].tolist())
    monkeypatch.setattr(languages, "CHUNK", 100)
    parts = list(languages.chunks(pa.array([text])))
    assert len(parts) > 10
    assert sorted(h for p in parts for h in languages.grams(p, 4)[0].tolist()) == whole


def test_filters_find_all_languages_and_know_their_mistakes():
    r = np.random.default_rng(4)
    hashes = r.integers(0, 1 << 63, 90_000).astype(np.uint64)
    of = np.repeat(np.arange(90), 1000)
    model = languages.build([f"l{i:02}" for i in range(90)], of, hashes)
    assert model.words.shape[0] == 2
    both = languages.build(["x", "y"], np.array([0, 1, 1]), np.array([5, 5, 9], np.uint64))
    assert both.sets(np.array([5, 9], np.uint64), 0).tolist() == [3, 2]
    for language in (0, 63, 64, 89):
        sets = model.sets(hashes, language // 64) >> np.uint64(language % 64) & np.uint64(1)
        assert sets[of == language].all()
        assert abs(sets[of != language].mean() - model.mistakes[language]) < 0.001


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_languages(spark):
    sf = SF.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in read(spark, sf, "documents").select("doc_id", "lang").collect()}
    found = QUERIES["op12_language_filters"](spark, sf).collect()
    assert len(found) == len(lang)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in found if r.held_out]) > 0.99
