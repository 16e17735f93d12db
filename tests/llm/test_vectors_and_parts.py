"""Vectors, suffix arrays, components and the tree of merges on their own."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from namesift.llm import bpe, graph, gsaca, neighbours  # noqa: E402


def vectors(n, seed=1, size=12):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((20, size))
    return centres[r.integers(0, 20, n)] + 0.4 * r.standard_normal((n, size))


def exact_neighbours(ids, x, query, k=10):
    score = np.sqrt(((x - x[ids == query][0]) ** 2).sum(axis=1))
    own = ids != query
    order = np.lexsort((ids[own], score[own]))[:k]
    return list(zip(ids[own][order].tolist(), score[own][order].tolist(), strict=True))


def test_recall(spark):
    x, ids = vectors(3000), np.arange(3000)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest_vectors(table).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(found) == list(range(0, 3000, 100))
    hits = 0
    for query, ranked in found.items():
        assert sorted(ranked) == list(range(1, 11))
        scores = [ranked[i][1] for i in range(1, 11)]
        assert scores == sorted(scores)
        for v, s in ranked.values():
            assert s == np.sqrt(((x[v] - x[query]) ** 2).sum())
        hits += len({v for v, _ in ranked.values()} & {v for v, _ in exact_neighbours(ids, x, query)})
    assert hits >= 0.9 * 300


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 40)
    monkeypatch.setattr(neighbours, "EPOCHS", 20)
    r = np.random.default_rng(5)
    centres = r.standard_normal((300, 12))
    scanned = {}
    for n in (600, 6000):
        x = centres[r.integers(0, 300, n)] + 0.05 * r.standard_normal((n, 12))
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
        search = neighbours.Search(table, 50, "vec_id", "embedding")
        assert search.index.count() == n
        scanned[n] = search.scanned()
        found = {}
        for row in neighbours.nearest_vectors(table, every=50).collect():
            found.setdefault(row.query_id, set()).add(row.vec_id)
        hits = sum(len(found[q] & {v for v, _ in exact_neighbours(np.arange(n), x, q)}) for q in range(0, n, 50))
        assert hits >= 0.9 * 10 * len(range(0, n, 50))
    assert search.partitions > 2 * neighbours.PARTITIONS
    assert scanned[6000] < scanned[600]


def test_few_clustered_vectors_give_all_ranks(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = 10 * np.repeat(np.eye(8), 5, axis=0) + 0.01 * r.standard_normal((40, 8))
    fit = neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda sample: (fit(sample)[0], 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert neighbours.nearest_vectors(table.limit(0)).collect() == []
    found = {}
    for row in neighbours.nearest_vectors(table, every=5).collect():
        found.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert sorted(found) == list(range(0, 40, 5))
    for query, ranked in found.items():
        assert [f[0] for f in sorted(ranked)] == list(range(1, 11))
        assert [f[1:] for f in sorted(ranked)] == exact_neighbours(np.arange(40), x, query)


def test_equal_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0])]
    good = [(i, [1.0, 2.0]) for i in range(100, 160)] + [(200, [1.0, 2.5]), (200, [1.0, 2.5])]
    table = spark.createDataFrame([(i, v, i) for i, v in bad + good], "vec_id long, embedding array<double>, part long")
    found = {}
    for r in neighbours.nearest_vectors(table).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert found == {100: {i + 1: 101 + i for i in range(10)}, 200: {i + 1: 100 + i for i in range(10)}}
    assert neighbours.nearest_vectors(table.filter("vec_id < 8")).count() == 0
    assert neighbours.nearest_vectors(table.filter("vec_id in (100, 101)")).count() == 1


def test_cut_is_balanced_and_follows_clusters():
    x = np.concatenate([c + 0.1 * np.random.default_rng(i).standard_normal((100, 8)) for i, c in enumerate(5 * np.eye(8)[:4])])
    part = neighbours.cut_graph(neighbours.nearest(x, x, 10, True), 4)
    assert np.bincount(part).tolist() == [100] * 4
    assert all(len(set(part[i * 100 : i * 100 + 100])) == 1 for i in range(4))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_suffix_arrays(letters):
    r = random.Random(letters)
    for _ in range(60):
        strings = [[r.randint(1, letters) for _ in range(r.randint(0, 40))] + [0] for _ in range(r.randint(1, 8))]
        bounds = np.cumsum([0, *map(len, strings)])
        found = gsaca.suffix_arrays(np.array(sum(strings, [])), bounds)
        for k, s in enumerate(strings):
            assert (found[bounds[k] : bounds[k + 1]] - bounds[k]).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(50), r.randrange(50)) for _ in range(30)] + [(7, 7)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = graph.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.u: r.v for r in found.collect()} == {n: m for n, m in root.items() if n != m}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tree_of_merges(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    coder, tokenizer = bpe.Codec(path), tokenizers.Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "LEAF", 8)
    monkeypatch.setattr(bpe, "WINDOW", 1)
    r = random.Random(7)
    for _ in range(200):
        text = "".join(r.choice(["a", "b", "th", "ing", "é", "日", "er", "aa"]) for _ in range(r.randint(1, 120)))
        assert coder.unsplit(text.encode()) == tokenizer.encode(text, add_special_tokens=False).ids
