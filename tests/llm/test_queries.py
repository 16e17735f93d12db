"""The registered queries over the whole smallest tables, where SQL has no form for them."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from namesift.llm import quality  # noqa: E402
from namesift.llm.checks import CHECKS  # noqa: E402
from namesift.llm.queries import QUERIES, table  # noqa: E402

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect())


def test_near_duplicates(spark, rows):
    found = QUERIES["op2_minhash_bayes"](spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == brute.near_duplicates(rows)


def test_scores(spark, rows):
    found = sorted(map(tuple, QUERIES["op4_stupid_backoff"](spark, SF).select("doc_id", "n_words", "log_score").collect()))
    want = sorted(brute.backoff_scores(rows))
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert np.allclose([f[2] for f in found], [w[2] for w in want])


def test_repeats(spark, rows):
    found = QUERIES["op10_suffix_groups"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute.removed_repeats(rows)]


def test_tokens_of_all_documents(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    found = {r.doc_id: r for r in QUERIES["op5_tree_bpe"](spark, SF).collect()}
    assert set(found) == set(ids)
    for i, own in ids.items():
        r = found[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), sha(",".join(map(str, own))), sha(tokenizer.decode(own, skip_special_tokens=False)))
    pieces: dict = {}
    sequences: dict = {}
    for p in QUERIES["op1_tier_packing"](spark, SF).collect():
        pieces.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, own in ids.items():
        own, at = np.array([*own, 0], "<u4"), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(own), zlib.crc32(own[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(own)
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_quality_rules_on_all_documents(spark, rows):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rules = quality.fit_quality(docs, labels)
    x = quality.statistics(pa.array([t or "" for _, t in rows]))
    total = np.full(len(rows), rules.intercept)
    for conditions, weight in rules.weighted:
        total += weight * np.all([(x[:, f] > cut) == above for f, cut, above in conditions], axis=0)
    want = {i: s for (i, _), s in zip(rows, 1 / (1 + np.exp(-total)), strict=True)}
    found = {r.doc_id: r for r in QUERIES["op6_quality_rules"](spark, SF).collect()}
    assert set(found) == set(want) and rules.weighted
    for i, score in want.items():
        assert abs(found[i].score - score) < 1e-12 and found[i].predicted == int(found[i].score >= 0.5)
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_held_out_quality(spark):
    sf = SF.replace("0.001", "0.1")
    scores = {r.doc_id: r for r in QUERIES["op6_quality_rules"](spark, sf).collect()}
    labels = table(spark, sf, "labels").select("doc_id", "quality").collect()
    pairs = [(scores[r.doc_id].predicted, r.quality) for r in labels if scores[r.doc_id].held_out]
    assert np.mean([a == b for a, b in pairs]) > 0.97


def test_recall(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table(spark, SF, "embeddings").collect()}
    ids, x = np.array(list(vectors)), np.array(list(vectors.values()))
    hits = total = 0
    found = QUERIES["op8_learned_partitions"](spark, SF).collect()
    for query in ids[ids % 100 == 0]:
        score = np.sqrt(((x - vectors[query]) ** 2).sum(axis=1))
        score[ids == query] = np.inf
        want = set(ids[np.lexsort((ids, score))[:10]].tolist())
        hits += len(want & {r.vec_id for r in found if r.query_id == query})
        total += len(want)
    assert hits >= 0.9 * total


@pytest.mark.parametrize("name", CHECKS)
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for name_of in ("documents", "conversations"):
        con.sql(f"create view {name_of} as select * from '{SF}/{name_of}.parquet'")
    answer, frame = con.sql(CHECKS[name]), QUERIES[name](spark, SF)
    columns = sorted(answer.columns)
    assert columns == sorted(frame.columns)
    want = [dict(zip(answer.columns, r, strict=True)) for r in answer.fetchall()]
    found = [r.asDict() for r in frame.collect()]
    assert sorted(str([r[c] for c in columns]) for r in found) == sorted(str([r[c] for c in columns]) for r in want)


def test_pipeline(spark, rows, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SF, "documents")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "exact_dedup":
            assert len(set(after.values())) == len(after) == len({t for _, t in before})
        if name == "near_dedup":
            assert set(after) == {r[0] for r in brute.near_duplicates(before, 80) if r[0] == r[2]}
        if name == "repeats":
            assert after == {r[0]: r[4].decode("utf-8", "ignore") for r in brute.removed_repeats(before)}
    assert {r.doc_id for r in docs.collect()} == set(after)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, count):
    r = np.random.default_rng(seed)
    return [f"w{n}" for n in r.integers(0, 10**9, count)]


def test_near_copies_between_80_and_85_percent(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for i, changed in enumerate([9, 10, 11, 13] * 3):
        own = words(i, 104)  # 100 shingles
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[: 104 - changed] + words(100 + i, changed)))]
    similar = {k: (100 - k) / (100 + k) for k in (9, 10, 11, 13)}
    assert 0.8 <= similar[11] < similar[9] < 0.85 > 0.8 > similar[13]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert kept == {r[0] for r in brute.near_duplicates(rows, 80) if r[0] == r[2]}
    assert {2 * i + 1 for i in range(12)} & kept == {2 * i + 1 for i in range(12) if i % 4 == 3}


def test_stages_on_awkward_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(20).collect()]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(None, good[0], None, None, None), (None, None, None, None, None), (7, good[7], "en", "s", 1), (7, good[8], "en", "s", 1), (90, "", "en", "s", 0), (91, good[3].replace(" ", "  "), "en", "s", 2)]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (spark.createDataFrame([], DOCUMENTS), spark.createDataFrame(rows, DOCUMENTS)):
            out = stage(spark, docs, SF)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            found = out.collect()
            if not docs.take(1):
                assert not found, name
            elif name == "exact_dedup":
                norm = lambda t: " ".join(re.split(r"[ \t-\r]+", t or ""))
                assert sorted(norm(r.text) for r in found) == sorted({norm(r[1]) for r in rows})
                assert all(r.doc_id == min(x[0] for x in rows if x[0] is not None and norm(x[1]) == norm(r.text)) for r in found)
            elif name in ("quality", "near_dedup"):
                assert {(r.doc_id, r.text) for r in found} <= {r[:2] for r in rows}
            elif name == "repeats":
                assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
