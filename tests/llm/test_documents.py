"""The operators on documents, over small tables with awkward rows, against plain Python."""

import hashlib
import os
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from namesift.llm import bpe, exact, lines, minhash, ngrams, packing, quality, shards, suffixes  # noqa: E402

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")

SCHEMA = "doc_id long, text string, class string, doc long, row int, _norm string, part string"


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(words))


def texts():
    base, passage = prose(1, 120), prose(2, 20)
    near = base.split()
    near[60] = "changed"
    odd = [None, "", " ", "a", "one two three four", "ONE Two\tthree\nfour", "\n\n", "ß" * 30, "日本語 テキスト" * 20, "x" * 9000,
           "<|endoftext|> in the middle", "a b's don't 12 !?\r\n", base, base.replace(" ", "  "), " ".join(near), base.upper(),
           prose(3, 50) + passage + prose(4, 50), passage + prose(5, 30), "start " + passage, prose(6, 3000)]
    line = "a line that several documents hold\n"
    odd += [line + prose(7, 10), prose(8, 10) + "\n  A Line that several documents hold ", line * 3 + "end", line]
    return list(enumerate(odd, 10))


@pytest.fixture(scope="module")
def rows():
    return texts()


def table(spark, rows):
    """Extra columns carry names that the operators use inside."""
    return spark.createDataFrame([(i, t, "c", 1, 2, "n", "p") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


def collected(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_near_duplicates(docs, rows):
    found = collected(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert found == [(*r, r[0] == r[2]) for r in brute.near_duplicates(rows)]


def test_near_copies_of_many_kinds(spark):
    r = random.Random(4)
    base = [str(r.random()) for _ in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 8):
            words[r.randrange(150)] = str(r.random())
        rows.append((i, " ".join(words)))
    found = collected(minhash.near_duplicates(table(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == brute.near_duplicates(rows)


def test_open_pairs_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = [(i, prose(9, 80) + " " + prose(i // 3, 3)) for i in range(20)]
    found = collected(minhash.near_duplicates(table(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == brute.near_duplicates(rows)


@pytest.mark.parametrize("own", [2, 6])
def test_crowds_of_near_copies_leave_few_pairs(spark, monkeypatch, own):
    r = random.Random(own)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(400):
        words = list(base)
        for at in r.sample(range(100), own):
            words[at] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    left = []
    pairs = minhash._Crowds.pairs
    monkeypatch.setattr(minhash._Crowds, "pairs", lambda *a: left.append(pairs(*a)) or left[-1])
    found = collected(minhash.near_duplicates(table(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert found == brute.near_duplicates(rows)
    assert left and left[-1].count() < 0.1 * 400 * 399 / 2


def test_pivot_with_several_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in r.sample(range(60), i % 5):
            words[at] = f"x{r.randrange(10**9)}"
        texts.append(" ".join(words))
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)]  # ids 0 to 9 have two texts
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(brute.shingles(t))
    linked = lambda a, b: any(100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b])
    for a in sets:
        for b in sets:
            assert not linked(a, b) or found[a] == found[b]


def test_pruning_keeps_pairs_at_the_threshold():
    least = minhash.least_agreements(85)
    assert least[0] == 0 and all(a <= b for a, b in zip(least, least[1:], strict=False))
    draws = np.random.default_rng(1).random((20_000, minhash.LENGTH)) < 0.85
    left = np.zeros(draws.shape, np.uint32)
    assert len(minhash.survivors(left, (~draws).astype(np.uint32), least)) == len(draws)
    far = np.random.default_rng(2).random((1000, minhash.LENGTH)) < 0.5
    assert len(minhash.survivors(left[:1000], (~far).astype(np.uint32), least)) < 20


def changed_ends(words, changes):
    """Pairs of texts; the second has other words at its end, one shingle for each."""
    rows = []
    for i, k in enumerate(changes):
        own = [f"w{i}x{j}" for j in range(words)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[: words - k], *(f"n{i}x{j}" for j in range(k))]))]
    return rows


def test_bands_follow_the_threshold(spark):
    assert minhash.bands_for(85) == (25, 5)
    for percent in range(1, 101):
        bands, each = minhash.bands_for(percent)
        assert (1 - (percent / 100) ** each) ** bands <= minhash.UNSEEN
        assert len(minhash.least_agreements(percent, bands * each)) == bands * each + 1
    rows = changed_ends(104, [30, 32, 33, 34] * 10)  # similarities 0.54, 0.52, 0.50 and below
    found = collected(minhash.near_duplicates(table(spark, rows), 50), "doc_id", "n_shingles", "component_id")
    assert found == brute.near_duplicates(rows, 50)


def test_lines(docs, rows):
    held = {}
    for i, t in rows:
        for line in (t or "").encode().split(b"\n"):
            key = line.strip().lower()
            if len(key.decode()) >= 20:
                held.setdefault(key, set()).add(i)
    want = []
    for i, t in rows:
        split = (t or "").split("\n")
        gone = [len(held.get(k := x.encode().strip().lower(), ())) >= 3 and i != max(held[k]) for x in split]
        kept = "\n".join(x for x, g in zip(split, gone, strict=True) if not g)
        want.append((i, len(split), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(w[2] for w in want) == 5  # one line in two documents, three in another
    assert collected(lines.drop_repeated_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_line_over_partition_borders(spark):
    rows = [(i, f"the same line in all documents\nown line of document {i}") for i in range(300)]
    found = {r.doc_id: r.n_dropped for r in lines.drop_repeated_lines(table(spark, rows)).collect()}
    assert found == {i: int(i != 299) for i in range(300)}


def test_scores(docs, rows):
    found = collected(ngrams.backoff_scores(docs), "doc_id", "n_words", "log_score")
    want = sorted(brute.backoff_scores(rows))
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert np.allclose([f[2] for f in found], [w[2] for w in want])


def test_repeats(docs, rows):
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute.removed_repeats(rows)]
    assert collected(suffixes.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    cut = {r.doc_id: r.text for r in suffixes.without_repeats(docs).collect()}
    assert {i: t or "" for i, t in cut.items()} == {r[0]: r[4].decode("utf-8", "ignore") for r in brute.removed_repeats(rows)}


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 2)
    passage = prose(30, 16)
    rows = [(i, prose(100 + i, 12) + passage + prose(200 + i % 3, 12)) for i in range(12)]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute.removed_repeats(rows)]
    assert collected(suffixes.remove_repeats(table(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_shared_anchors_move_packed():
    """A chunk sends an anchor to its bucket twice at most, however many texts have it, and no text loses a shared one."""
    r = np.random.default_rng(8)
    for bits in (0, 2, 3):
        anchor = r.integers(0, 60, 4000).astype(np.uint64)
        of = r.integers(-9, 9, 4000) * (anchor.astype(np.int64) % 7 > 1)
        chunks = [suffixes._packed(anchor[i::5], of[i::5], bits) for i in range(5)]
        for c in chunks:
            sent = [a for b, p in zip(*(c.column(x).to_pylist() for x in ("bucket", "anchors")), strict=True) if b < 1 << bits for a in np.frombuffer(p, np.uint64).tolist()]
            assert max(Counter(sent).values()) <= 2
        rows = pa.Table.from_batches(chunks).sort_by("bucket").to_batches(max_chunksize=3)
        found = {(c, a) for b in suffixes._shared(bits)(rows) for c, own in zip(*(b.column(x).to_pylist() for x in ("class", "anchors")), strict=True) for a in own}
        held = {}
        for a, c in zip(anchor.tolist(), of.tolist(), strict=True):
            held.setdefault(a, set()).add(c)
        assert found == {(c, a) for a, classes in held.items() if len(classes) > 1 for c in classes}


def test_shared_anchors_go_back_packed():
    """A bucket sends a row to each part of the classes, however many classes it has, and a class gets all its anchors in one row."""
    r = np.random.default_rng(10)
    for bits in (0, 3):
        anchor = r.integers(0, 900, 6000).astype(np.uint64)
        of = r.integers(-(1 << 62), 1 << 62, 500)[r.integers(0, 500, 6000)]
        chunks = [suffixes._packed(anchor[i::5], of[i::5], bits) for i in range(5)]
        rows = pa.Table.from_batches(chunks).sort_by("bucket").to_batches(max_chunksize=3)
        sent = pa.Table.from_batches(suffixes._parted(bits)(rows))
        assert sent.num_rows <= 2 << 2 * bits
        lists = [x for b in suffixes._gathered(sent.sort_by("part").to_batches(max_chunksize=5)) for x in zip(*(b.column(c).to_pylist() for c in ("class", "anchors")), strict=True)]
        held = {}
        for a, c in zip(anchor.tolist(), of.tolist(), strict=True):
            held.setdefault(a, set()).add(c)
        want = {}
        for a, classes in held.items():
            for c in classes if len(classes) > 1 else ():
                want.setdefault(c, set()).add(a)
        assert len(lists) == len(want)
        assert {c: set(own) for c, own in lists} == want


def test_anchor_is_the_leftmost_least_gram():
    r = np.random.default_rng(9)
    texts = [r.choice(list(b"ab"), n).astype(np.uint8).tobytes() for n in (50, 400, 51, 900, 49, 70)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    grams = suffixes.Rolling(data).grams(suffixes.GRAM)
    want = {(i, s, min(range(s, s + suffixes.OFFSETS), key=lambda g: (int(grams[g]) >> 32, g))) for i in range(len(texts)) for s in range(offsets[i], offsets[i + 1] - suffixes.LENGTH + 1)}
    pieces = list(zip(*(x.tolist() for x in suffixes.anchored(data, offsets)), strict=True))
    assert {(i, s, where) for i, start, count, where, _ in pieces for s in range(start, start + count)} == want
    assert all(h == int(grams[where]) for *_, where, h in pieces)


def test_tables_of_texts_stay_small():
    """What a slice of texts needs at a time follows the slice."""
    texts = pa.record_batch([pa.array(range(400)), pa.array([prose(i, 2000) for i in range(40)] * 10)], ["doc_id", "text"])
    for run in (minhash._profile(10), minhash._sets, lambda batches: [quality.text_statistics.func(b.column("text")) for b in batches]):
        tracemalloc.start()
        for _ in run([texts]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 48 << 20


def test_groups_stay_whole_over_batches():
    r = np.random.default_rng(6)
    for _ in range(200):
        keys = np.sort(r.integers(-4, 4, r.integers(1, 30)))
        table = pa.table({"key": keys, "piece": [b"x" * int(n) for n in r.integers(1, 9, len(keys))], "row": np.arange(len(keys))})
        batches = table.to_batches(max_chunksize=int(r.integers(1, 6)))
        found = [(set(b["key"].to_pylist()), b["row"].to_pylist()) for b in suffixes.whole_groups(batches, "key", 12, "piece")]
        assert sum((f[1] for f in found), []) == list(range(len(keys)))
        assert sum(len(f[0]) for f in found) == len(set(keys.tolist()))


def test_repeats_over_batch_borders(spark):
    passages = [prose(300 + k, 12) for k in range(30)]
    rows = [(i, prose(400 + i, 8) + passages[i % 30] + prose(600 + i, 8)) for i in range(90)]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute.removed_repeats(rows)]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for size in (2, 3, 5):
            spark.conf.set(setting, size)
            assert collected(suffixes.remove_repeats(table(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    finally:
        spark.conf.set(setting, before)


def encoded(rows):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return tokenizer, {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}


@pytest.mark.parametrize("sizes", [{}, {"long_text": 200, "segment": 64}])
def test_encode_and_decode(docs, rows, sizes):
    tokenizer, ids = encoded(rows)
    want = []
    for i, own in sorted(ids.items()):
        text = tokenizer.decode(own, skip_special_tokens=False)
        want.append((i, len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert collected(bpe.encode_decode(docs, PATH, **sizes), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_packing(docs, rows):
    _, ids = encoded(rows)
    pieces = packing.pack_documents(docs, PATH).collect()
    for i, own in ids.items():
        own, at = np.array([*own, 0], "<u4"), 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(own[at : at + p.length].tobytes())
            at += p.length
        assert at == len(own)
    for sequence in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == sequence), key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert sum(p.length for p in own) <= packing.CONTEXT


def test_step_groups_are_equal_over_tasks(spark):
    rows = [(i, prose(i, 10 + 40 * (i % 9))) for i in range(300)]
    pieces = packing.pack_documents(table(spark, rows).repartition(7), PATH).collect()
    size, of, tiers = Counter(), {}, {}
    for p in pieces:
        size[p.sequence_id] += p.length
        of[p.sequence_id], tiers[p.step_group] = p.step_group, p.tier
        assert tiers[p.step_group] == p.tier
    windows = Counter(of.values())
    for tier in set(tiers.values()):
        groups = sorted(g for g in tiers if tiers[g] == tier)
        assert all(windows[g] == packing.STEP_WINDOWS * packing.CONTEXT // tier for g in groups[:-1])
        padded = [s for s, g in of.items() if tiers[g] == tier and size[s] < tier]
        assert len(padded) <= (7 if tier == packing.CONTEXT else 0)
        assert all(of[s] >= of[t] for s in padded for t in of if tiers[of[t]] == tier and size[t] == tier)


def test_packing_pads_little():
    r = np.random.default_rng(3)
    packer = packing._Packer(0)
    lengths = np.concatenate((r.integers(1, 3000, 400), np.full(300, 700), np.ones(300, int)))
    for i, n in enumerate(r.permutation(lengths).tolist()):
        packer.add((i, n), np.zeros(n, "<u4"))
        if i % 50 == 0:
            packer.pack()
    packer.pack(last=True)
    size = Counter()
    for p in packer.out:
        size[p[5]] += p[2]
    assert sum(size.values()) == lengths.sum()
    assert sum(1 for s in size.values() if s & (s - 1)) <= 1
    groups = Counter()
    for sequence, group in {(p[5], p[8]) for p in packer.out}:
        groups[group] += size[sequence]
    assert max(groups.values()) == packing.STEP_WINDOWS * packing.CONTEXT


def test_exact(docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = sorted(
        (i, min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest()) for text, ids in groups.items() for i in ids
    )
    assert collected(exact.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_copies_in_many_ranges(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(900)]
    found = exact.exact_duplicates(table(spark, rows)).filter("group_size > 1").select("keep_id", "group_size", "kept").collect()
    assert len(found) == 600 and {(r.keep_id, r.group_size) for r in found} == {(1, 600)}
    assert sum(r.kept for r in found) == 1


def test_shards(spark):
    rows = [(i * 7, "ä" * (i % 5) if i % 11 else None) for i in range(2000)]
    placed = {n: {r.doc_id: r for r in shards.shard_rows(table(spark, rows), n).collect()} for n in (1, 6, 7)}
    assert all(r.shard == 0 for r in placed[1].values())
    for i, r in placed[6].items():
        assert r.grown_shard == placed[7][i].shard and r.grown_shard in (r.shard, 6)
        assert r.size == 8 + 2 * ((i // 7) % 5 if (i // 7) % 11 else 0)
    for shard in range(6):
        slots = sorted(r.slot for r in placed[6].values() if r.shard == shard)
        assert slots == list(range(len(slots))) and 230 < len(slots) < 450


def test_slots_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(shards, "ROWS_PER_TASK", 20)
    found = shards.shard_rows(table(spark, [(i, str(i)) for i in range(500)]), 3).collect()
    for shard in range(3):
        ids = [r.doc_id for r in sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)]
        assert ids == sorted(ids) and [r.slot for r in sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)] == list(range(len(ids)))


def test_rules_compile_to_what_they_say(spark):
    rules = quality.Rules(-0.5, ((((0, 1.0, True), (3, 0.5, False)), 2.0), (((5, 0.1, True),), -1.0)))
    values = [(1.5, 0.2, 0.0), (0.5, 0.2, 0.3), (1.5, 0.9, 0.3)]
    stats = spark.createDataFrame(
        [([v[0] if s == 0 else v[1] if s == 3 else v[2] if s == 5 else 0.0 for s in range(len(quality.STATISTICS))],) for v in values],
        "v array<double>",
    )
    from pyspark.sql import functions as F

    struct = F.struct(*[F.col("v")[i].alias(n) for i, n in enumerate(quality.STATISTICS)])
    found = [r[0] for r in stats.select(rules.score(struct)).collect()]
    assert np.allclose(found, [1 / (1 + np.exp(-x)) for x in (1.5, -1.5, -1.5)])


def test_fit_finds_a_conjunction():
    r = np.random.default_rng(5)
    x = r.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 7] < 0.7)).astype(float)
    rules = quality.fit_rules(x, y)
    margin = rules.intercept + sum(w * quality._holds(x, c) for c, w in rules.weighted)
    assert ((margin > 0) == y).mean() > 0.97
    assert len(rules.weighted) < 150
    assert quality.fit_rules(x[:0], y[:0]).weighted == ()
    assert quality.fit_rules(x, np.zeros(3000)).intercept < 0


OPERATORS = {
    "packing": lambda d: packing.pack_documents(d, PATH),
    "near": minhash.near_duplicates,
    "lines": lines.drop_repeated_lines,
    "scores": ngrams.backoff_scores,
    "bpe": lambda d: bpe.encode_decode(d, PATH),
    "exact": exact.exact_duplicates,
    "shards": lambda d: shards.shard_rows(d, 24),
    "repeats": suffixes.remove_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [(1, "x")]).filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_without_id_or_repeated(spark, name):
    same = prose(40, 60)
    rows = [(None, same), (None, None), (3, same), (3, same), (3, prose(41, 60)), (5, "")]
    found = OPERATORS[name](table(spark, rows)).collect()
    ids = Counter(r.doc_id for r in found)
    assert ids == {None: 2, 3: 3, 5: 1}
    if name == "exact":
        assert sum(r.kept for r in found) == 3
    if name == "near":
        assert {r.component_id for r in found if r.doc_id == 3} == {3}
    if name == "repeats":
        assert {r.n_removed for r in found if r.doc_id == 3} == {0}


def test_quality_on_awkward_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows] + [(None, 1, 0), (10, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, labels).collect()
    assert sorted(r.doc_id for r in found) == [i for i, _ in rows]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert {r.doc_id for r in found if r.held_out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    none = quality.quality_scores(docs, labels.filter("doc_id < 0")).collect()
    assert {r.predicted for r in none} == {1}
    assert quality.keep_quality(docs, labels.filter("doc_id < 0")).columns == docs.columns
    assert quality.quality_scores(docs.filter("doc_id < 0"), labels).count() == 0


def test_row_keeping_forms(spark):
    rows = [(1, "same text here"), (1, "same text here"), (2, "same  text here"), (None, "other"), (4, None)]
    kept = exact.without_copies(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == {(1, "same text here"): 1, (None, "other"): 1, (4, None): 1}
    near = minhash.without_near_copies(table(spark, [(1, prose(50, 60)), (2, prose(50, 60).upper()), (None, "x")]))
    assert {r.doc_id for r in near.collect()} == {1, None}


def test_repeated_id_with_different_texts(spark):
    first, own = prose(60, 60), prose(61, 60)
    rows = [(3, first), (5, own), (5, first.upper()), (7, own + " more"), (None, first)]
    docs = table(spark, rows)
    near = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect() if r.doc_id == 5}
    assert near == {(5, 5, True), (5, 3, False)}
    kept = Counter((r.doc_id, r.text) for r in minhash.without_near_copies(docs).collect())
    assert kept == {(3, first): 1, (5, own): 1, (None, first): 1}


def test_words_of_chunks_are_found_in_small_slices(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from namesift.llm import ngrams

    sizes = []
    monkeypatch.setattr(ngrams, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(ngrams, "words_of", lambda data, offsets, _f=ngrams.words_of: sizes.append(len(data)) or _f(data, offsets))
    texts = [f"word{i} other " * 30_000 for i in range(12)]
    made = list(ngrams._chunks([pa.record_batch([pa.array(range(12)), pa.array(texts)], ["doc_id", "text"])]))
    assert max(sizes) <= 512 << 10
    assert sum(b.column("n")[0].as_py() for b in made) == 12 * 60_000
    assert [i for b in made for i in b.column("ids")[0].as_py()] == list(range(12))
