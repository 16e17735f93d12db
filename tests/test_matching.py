import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from namesift import functions as fn
from namesift.functions import scores
from namesift.operators import candidates, skew, vectors
from namesift.operators.match import MATCH_COLUMNS, find_duplicates, match_report


def stem_and_ext(name):
    i = name.rfind(".")
    return (name[:i], name[i:].lower()) if 0 < i < len(name) - 1 else (name, "")


def tokens(name):
    return re.findall(r"[a-z]+|\d+", stem_and_ext(name)[0].lower())


def brute_force(left, right, threshold, use_tfidf):
    """All scores as one matrix of left by right files, masked by extension."""
    names = [name for name, _ in left + right]
    bags = [Counter(tokens(n)) for n in names]
    vocabulary = sorted(set().union(*bags)) if bags else []
    if use_tfidf and vocabulary:
        counts = np.array([[bag[t] for t in vocabulary] for bag in bags], float)
        weighted = counts * np.log(len(names) / (counts > 0).sum(axis=0))
        length = np.linalg.norm(weighted, axis=1, keepdims=True)
        unit = np.divide(weighted, length, out=np.zeros_like(weighted), where=length > 0)
        scores = unit[: len(left)] @ unit[len(left) :].T
    else:
        stems = [stem_and_ext(n)[0].lower() for n in names]
        scores = np.array([[SequenceMatcher(None, a, b).ratio() for b in stems[len(left) :]] for a in stems[: len(left)]])
    scores = scores.reshape(len(left), len(right))
    kind = np.array([stem_and_ext(n)[1] for n in names])
    kept = (kind[: len(left), None] == kind[len(left) :]) & (scores >= threshold - 1e-12)
    return {(int(i), int(j)): round(float(scores[i, j]), 9) for i, j in zip(*np.nonzero(kept), strict=True)}


def table(spark, files, root):
    rows = [(name, f"{root}/{i}", size) for i, (name, size) in enumerate(files)]
    return spark.createDataFrame(rows, "name string, path string, size long")


def found_by(spark, left, right, threshold, use_tfidf):
    matches = find_duplicates(table(spark, left, "l"), table(spark, right, "r"), threshold, use_tfidf)
    rows = matches.collect()
    pairs = {(int(r["file1_path"][2:]), int(r["file2_path"][2:])): round(r["name_similarity"], 9) for r in rows}
    assert len(pairs) == len(rows)
    return pairs


WORDS = ["report", "final", "Invoice", "photo", "draft", "été", "照片", "2024", "01", "17", "backup", "copy", "zebra"]


def random_files(seed, n):
    rng = random.Random(seed)
    files = []
    for _ in range(n):
        words = rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(1, 5))
        name = words[0] + "".join(rng.choice([" ", "_", "-", ".", ""]) + w for w in words[1:])
        files.append((name + rng.choice([".txt", ".TXT", ".pdf", ""]), rng.choice([0, 10, 99, 100, 1000])))
    # A third of the files are copies of one name.
    return files + [("report final.txt", 7)] * (n // 3)


LEFT, RIGHT = random_files(1, 60), random_files(2, 60)


@pytest.mark.parametrize("threshold", [0.05, 0.5, 0.7, 0.95, 1.0])
def test_tfidf_equals_brute_force(spark, threshold):
    assert found_by(spark, LEFT, RIGHT, threshold, True) == brute_force(LEFT, RIGHT, threshold, True)


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.9, 1.0])
def test_sequence_equals_brute_force(spark, threshold):
    assert found_by(spark, LEFT, RIGHT, threshold, False) == brute_force(LEFT, RIGHT, threshold, False)


@pytest.mark.parametrize("use_tfidf", [True, False])
def test_zero_threshold_keeps_every_pair_of_an_extension(spark, use_tfidf):
    left, right = LEFT[:12] + [("---.txt", 1)], RIGHT[:12]
    assert found_by(spark, left, right, 0.0, use_tfidf) == brute_force(left, right, 0.0, use_tfidf)


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    for name in ("split_join", "split_lookup"):
        original = getattr(skew, name)
        low = lambda *args, _f=original, **kw: _f(*args, **kw, min_rows=3)
        for module in ("candidates", "vectors", "match"):
            target = __import__(f"namesift.operators.{module}", fromlist=[module])
            if hasattr(target, name):
                monkeypatch.setattr(target, name, low)
    assert found_by(spark, LEFT, RIGHT, 0.6, True) == brute_force(LEFT, RIGHT, 0.6, True)
    assert found_by(spark, LEFT, RIGHT, 0.8, False) == brute_force(LEFT, RIGHT, 0.8, False)
    assert found_by(spark, LEFT[:9], RIGHT[:9], 0.0, True) == brute_force(LEFT[:9], RIGHT[:9], 0.0, True)


def test_hot_key_list_is_bounded(spark):
    counts = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("n")).unionAll(
        spark.createDataFrame([(-1, 2500)], "k long, n int")
    )
    hot = skew.hot_keys(counts, ["k"], "n", min_rows=1)
    assert [r["k"] for r in hot.collect()] == [-1]


def test_identical_lone_files_score_zero(spark):
    files = [("report.pdf", 5)]
    assert found_by(spark, files, files, 0.7, True) == {}
    assert found_by(spark, files, files, 0.0, True) == {(0, 0): 0.0}


def test_no_tokens_anywhere_falls_back_to_sequence(spark):
    assert found_by(spark, [("---.txt", 1), ("照片.txt", 1)], [("--+.txt", 1)], 0.6, True) == {(0, 0): round(2 / 3, 9)}


def test_empty_side(spark):
    assert found_by(spark, [], RIGHT[:3], 0.7, True) == {}
    assert found_by(spark, [], [], 0.7, True) == {}


def test_long_names(spark):
    base = "abcdefghij klmnop qrstuv " * 9
    left = [(base + "one.txt", 1), ("x" * 210 + ".txt", 1)]
    right = [(base + "two.txt", 1), (base[5:] + "three.txt", 1), ("x" * 230 + "y.txt", 1)]
    for threshold in (0.3, 0.8):
        assert found_by(spark, left, right, threshold, False) == brute_force(left, right, threshold, False)


def test_match_record_and_order(spark):
    left = table(spark, [("alpha one.txt", 100), ("beta two.txt", 0)], "l")
    right = table(spark, [("Alpha_one.TXT", 50), ("beta two.txt", 0), ("gamma.txt", 1)], "r")
    matches = find_duplicates(left, right)
    assert matches.columns == MATCH_COLUMNS
    first, second = matches.collect()
    assert (first["file1_path"], first["file2_path"], first["confidence"]) == ("l/1", "r/1", pytest.approx(1.0))
    assert first["reasons"] == "Name exact match, Size exact match"
    assert second["size_similarity"] == 0.5 and second["confidence"] == pytest.approx(0.8)
    assert second["reasons"] == "Name exact match, Size similar"
    by_name = find_duplicates(left, right, confidence="name").collect()
    assert [r["confidence"] for r in by_name] == pytest.approx([1.0, 1.0])
    report = match_report(matches).first()
    assert (report["full_path_1"], report["size_1"], report["name_match"]) == ("l/1", "0.0 B", "100.0%")


def test_sequence_similarity_depends_on_order(apply):
    got = apply(fn.name_similarity, [("tide", "diet"), ("diet", "tide"), ("", ""), (None, "a")], "a string, b string")
    assert got == [0.25, 0.5, 1.0, None]


def test_size_similarity(apply):
    got = apply(fn.size_similarity, [(0, 0), (0, 5), (50, 100), (7, 7), (None, 1)], "a long, b long")
    assert got == [1.0, 0.0, 0.5, 1.0, None]


def test_reasons(apply):
    got = apply(fn.match_reasons, [(0.95, 0.99), (0.94999, 0.95), (0.7, 0.5)], "a double, b double")
    assert got == [
        "Name exact match, Size exact match", "Name very similar, Size very close", "Name similar, Size similar",
    ]


def test_format_size(apply):
    sizes = [0, 1023, 1280, 1024**2 - 1, 3 * 1024**3, 5 * 1024**5, 4000 * 1024**5, None]
    expected = ["0.0 B", "1023.0 B", "1.2 KB", "1024.0 KB", "3.0 GB", "5.0 PB", "4000.0 PB", None]
    assert apply(fn.format_size, sizes, "v long") == expected


def test_scalar_cosine_with_unknown_tokens(apply):
    idf = F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(0.0))
    got = apply(lambda a, b: fn.tfidf_similarity(a, b, idf), [("a x", "a y"), ("b", "b"), ("a a x", "x")], "a string, b string")
    assert got == pytest.approx([4 / 5, 0.0, 1 / math.sqrt(17)])


def test_term_tables(spark):
    files = spark.createDataFrame([("a a b.txt", 1), ("b c", 2), ("--", 3)], "name string, id int")
    tf = {(r["id"], r["token"]): r["tf"] for r in vectors.term_frequencies(files, ["id"]).collect()}
    assert tf == {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1, (2, "c"): 1}
    idf = {r["token"]: (r["df"], round(r["idf"], 9)) for r in vectors.inverse_document_frequencies(files).collect()}
    assert idf == {t: (n, round(math.log(3 / n), 9)) for t, n in (("a", 1), ("b", 2), ("c", 1))}
    norms = {r["id"]: r["norm"] for r in vectors.vector_norms(files, ["id"]).collect()}
    assert norms[3] == 0.0 and norms[2] == pytest.approx(math.hypot(math.log(1.5), math.log(3)))


def test_candidates_carry_no_files_of_the_other_side(spark):
    groups = spark.createDataFrame([(".t", "a b", 1, 0), (".t", "a c", 1, 0)], "extension string, key string, left_files int, right_files int")
    assert candidates.cosine_pairs(vectors.unit_vectors(groups), 0.1).count() == 0


def test_norms_of_repeated_paths(spark):
    rows = [("/a/x", "alpha one.txt"), ("/a/x", "alpha one.txt"), ("/a/y", "beta"), ("/b/z", "one two"), ("/b/n", None), ("/b/e", "---")]
    files = spark.createDataFrame(rows, "path string, name string")
    found = sorted((r.path, round(r.norm, 9)) for r in vectors.vector_norms(files, ["path"]).collect())
    idf = {t: math.log(6 / sum(t in tokens(n or "") for _, n in rows)) for t in ("alpha", "one", "beta", "two")}
    want = sorted((p, round(math.sqrt(sum(idf[t] ** 2 for t in tokens(n or ""))), 9)) for p, n in rows)
    assert found == want


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(here, row[j])
            before = here
    return row[-1]


def test_common_subsequence_of_all_lengths():
    rng = random.Random(7)
    draw = lambda: "".join(rng.choice("abé照😀") for _ in range(rng.choice([0, 1, 9, 63, 64, 65, 128, 150])))
    lefts, rights = [draw() for _ in range(200)], [draw() + "z" for _ in range(200)]
    found = scores.common_subsequence(pa.array(lefts), pa.array(rights))
    assert found.tolist() == [longest_common(a, b) for a, b in zip(lefts, rights, strict=True)]


def test_subsequence_tables_stay_small(monkeypatch):
    lefts, rights = [f"{i:03}x" for i in range(300)], [f"{i:03}" for i in range(300)]
    want = scores.common_subsequence(pa.array(lefts), pa.array(rights)).tolist()
    monkeypatch.setattr(scores, "MOST_WORDS", 100)
    assert scores.common_subsequence(pa.array(lefts), pa.array(rights)).tolist() == want == [3] * 300


def test_each_pair_meets_once(spark, monkeypatch):
    groups = spark.createDataFrame([(".txt", f"name {i % 7} {i}", i % 2, 1 - i % 2) for i in range(40)], "extension string, key string, left_files int, right_files int")
    for rows in (2000, 3):
        monkeypatch.setattr(candidates, "split_join", lambda *a, _n=rows, **kw: skew.split_join(*a, **kw, min_rows=_n))
        pairs = candidates._sequence_candidates(groups, 0.1).select("left_key", "right_key").collect()
        assert len(pairs) == len(set(pairs)) == 400


def test_files_of_a_hot_name_are_cut_by_their_pairs(spark, monkeypatch):
    cells = []
    original = skew.split_join
    monkeypatch.setattr(skew, "spread_rows", lambda rows, by, _f=skew.spread_rows: cells.append((rows, by)) or _f(rows, by))
    from namesift.operators import match

    monkeypatch.setattr(match, "split_join", lambda *a, **kw: original(*a, **kw, min_rows=20))
    left = [("same name.txt", i) for i in range(200)] + [("other one.txt", 1)]
    right = [(f"same name {chr(97 + i)}.txt", i) for i in range(26)] + [("unlike.txt", 5)]
    assert found_by(spark, left, right, 0.5, False) == brute_force(left, right, 0.5, False)
    cut = [(rows, by) for rows, by in cells if "_lshare" in by]  # the others are of the search for pairs
    assert cut
    for rows, by in cut:
        assert max(r["count"] for r in rows.groupBy(*by).count().collect()) <= 60


def test_file_pairs_are_formed_after_the_last_shuffle(spark, monkeypatch):
    from namesift.operators import match

    for name, value in (("FILES_PER_LIST", 3), ("MATCHES_PER_TASK", 40), ("LEAST_PER_TASK", 10), ("PLACES", 7), ("FILES_PER_PLACE", 4)):
        monkeypatch.setattr(match, name, value)
    kinds = [("same name.txt", 5), ("same name.TXT", None), ("same name two.txt", 5), ("other.pdf", 0)]
    left = spark.createDataFrame([(*kinds[i % 4], None if i == 8 else f"l/{i * 7 % 41:02}") for i in range(41)], "name string, size long, path string")
    right = spark.createDataFrame([(*kinds[i % 4], f"r/{i:02}") for i in range(30)], "name string, size long, path string")
    for use_tfidf, threshold in ((True, 0.1), (False, 0.5), (True, 0.0)):
        matches = find_duplicates(left, right, threshold, use_tfidf)
        plan = matches._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode(file2_files") < plan.index("RepartitionByExpression")
        rows = matches.collect()
        assert matches.rdd.getNumPartitions() > 4  # more pairs, more tasks
        ends = [(stem_and_ext(n)[1], *p) for n, *p in map(tuple, left.select("name", "path").collect())]
        assert len(rows) == sum((e, f) in ((".txt", ".txt"), (".pdf", ".pdf")) for e, _ in ends for f in [stem_and_ext(kinds[i % 4][0])[1] for i in range(30)])
        order = [(r.confidence is None, -(r.confidence or 0), r.file1_path is not None, r.file1_path or "", r.file2_path) for r in rows]
        assert order == sorted(order) and len(set(order)) > len(rows) // 2
        assert sorted(map(str, rows)) == sorted(map(str, find_duplicates(left, right, threshold, use_tfidf, ordered=False).collect()))
