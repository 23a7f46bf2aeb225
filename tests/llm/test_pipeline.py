"""The pipeline's stages against plain recomputation, and the llm queries against their oracles."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from compare import check
from pyspark.sql import functions as F
from test_operators import brute_components, brute_fingerprint

from threadloom.llm import near_copies, quality_classifier, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    check(queries.QUERIES[name], queries.ORACLES[name], spark, SF)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    return rows.unionByName(rows.limit(5)).cache()


def test_exact_stage(spark, docs):
    kept = corpus_pipeline.exact(spark, docs, SF)
    assert kept.columns == docs.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in docs.collect():
        best[norm(r["text"])] = min(best.get(norm(r["text"]), (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(b[1] for b in best.values())


def test_near_stage(spark, docs):
    rows = [(r["doc_id"], brute_fingerprint(r["text"] or "")) for r in docs.collect()]
    kept = [r["doc_id"] for r in corpus_pipeline.near(spark, docs, SF).collect()]
    assert sorted(kept) == sorted(set(brute_components(rows, 2)))


def five_word_sets(texts):
    words = [t.encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def test_near_stage_finds_near_copies(spark):
    """Against brute-force Jaccard at 0.8: edits too many for 2 bits, just under 0.8, a crowd, a chain."""
    rng = random.Random(3)
    texts = []
    for edits in (0, 1, 2, 3, 4, 5, 6, 8):
        for _ in range(4):
            base = [f"w{rng.randrange(900)}" for _ in range(150)]
            copy = list(base)
            for at in rng.sample(range(150), edits):
                copy[at] = f"v{rng.randrange(900)}"
            texts += [" ".join(base), " ".join(copy).upper()]
    crowd = [f"c{i}" for i in range(120)]
    for i in range(40):
        texts.append(" ".join(crowd[: i % 7] + [f"z{i}"] + crowd[i % 7 + 1 :]))
    texts += ["", " ", "a b", "A  b", "a b c", " ".join(f"k{i}" for i in range(100)), " ".join(f"k{i}" for i in range(12, 112))]
    texts.append(" ".join(f"k{i}" for i in range(6, 106)))  # links the two before it, which are not near
    rng.shuffle(texts)
    sets = five_word_sets(texts)
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near(spark, frame, SF).collect())
    assert kept == sorted({label.index(x) for x in label})
    simhash = set(brute_components([(i, brute_fingerprint(t)) for i, t in enumerate(texts)], 2))
    assert len(kept) < len(simhash)


def random_sets(rng, *sizes):
    """Two sets of random shingles: sizes of what is common, of the first's own, of the second's own."""
    both, a, b = (rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(n % 2) for n in sizes)
    return np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))


@pytest.mark.parametrize("n", [1, 4, 5, 47, 48, 49, 200, 1023, 1024, 3000])
def test_near_stage_fingerprint(n):
    """Each bit is 1 if set in over half the hashes, counted plainly."""
    shingles, _ = random_sets(np.random.default_rng(n), n, 0, 0)
    bits = np.unpackbits(near_copies._hashes(shingles).view(np.uint8), axis=1).astype(int)
    assert (np.unpackbits(near_copies.simhash(shingles)) == (2 * bits.sum(axis=0) > n)).all()


@pytest.mark.parametrize("sizes", [(8, 1, 1), (8, 0, 2), (16, 2, 2), (40, 0, 10), (400, 50, 50), (1600, 400, 0)])
def test_near_stage_proposes_by_simhash(sizes):
    """Pairs at exactly 0.8 share a SimHash key, and no check on fingerprints drops them; other pairs go."""
    rng = np.random.default_rng(sum(sizes))
    for b in (12, 18):
        at = near_copies.tables(b)
        for _ in range(20):
            sets = random_sets(rng, *sizes)
            prints = np.stack([near_copies.simhash(s) for s in sets])
            keys = near_copies.table_keys(prints, at, 0)
            assert near_copies.similar(*sets) and (keys[0] == keys[1]).any()
            assert near_copies.near_prints(*prints)
            assert np.bitwise_count(prints[0, :8] ^ prints[1, :8]).sum() <= near_copies.WORD_APART
            other = near_copies.simhash(random_sets(rng, 50, 0, 0)[0])
            assert not near_copies.near_prints(prints[0], other)


def test_near_stage_tiny_sets():
    """Sets of 4 and 5 at 0.8 always share a key."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = random_sets(rng, 4, 0, 1)
        assert set(near_copies.tiny_keys(a)) & set(near_copies.tiny_keys(b)) and max(near_copies.tiny_keys(b)) < 0
    assert near_copies.tiny_keys(random_sets(rng, 6, 0, 0)[0]) == []


@pytest.mark.parametrize("merged", [1, 7, 1 << 15])
def test_near_stage_keys_meet_across_batches(spark, monkeypatch, merged):
    """All pairs of a key with few members, and each member of a crowd once, wherever batches end."""
    monkeypatch.setattr(near_copies, "MERGED", merged)
    monkeypatch.setattr(near_copies, "CROWD", 4)
    sizes = [1, 2, 4, 5, 1, 9, 3, 12, 5, 2]
    rows = [(key, 100 * key + i, 10, 7) for key, size in enumerate(sizes) for i in range(size)]
    rows.append((1, 190, 13, 7))  # too large to be similar
    rows.append((1, 191, 10, -8))  # all bits of the word differ
    sizes[1] += 2
    frame = spark.createDataFrame(sorted(rows), "key long, fold long, n long, word long").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = near_copies._met(frame).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    crowds = {k for k, size in enumerate(sizes) if size > 4}
    assert sorted((r["key"], r["a"], r["n"]) for r in got if r["key"] is not None) == sorted(r[:3] for r in rows if r[0] in crowds)
    pairs = [(r["a"], r["b"]) for r in got if r["key"] is None]
    few = [(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[0] not in crowds and x[2:] == y[2:]]
    assert sorted(p for p in pairs if p[0] // 100 not in crowds) == sorted(few)
    led = Counter(p[0] // 100 for p in pairs if p[0] // 100 in crowds)
    assert led == {k: sizes[k] - 1 for k in crowds}


def test_crowds_are_not_tied_by_chance(spark):
    """A member of two crowds' keys by chance is in both, and they stay two; every key is in one crowd."""
    keys = {1: [5, 6, 7], 2: [5, 6, 8], 3: [6, 7, 8, 5, 30], 4: [20, 21, 22], 5: [20, 21, 22, 30], 6: [20, 22, 40], 7: [41, 42]}
    rows = [(key, fold, fold, 0) for key, folds in keys.items() for fold in folds]
    got = near_copies._crowds(spark.createDataFrame(rows, "key long, fold long, n long, label long"), core=3).collect()
    by_crowd = {}
    for r in got:
        by_crowd.setdefault((r["key"], r["c"]), []).append(r["fold"])
    assert sorted((c, sorted(f)) for (_, c), f in by_crowd.items()) == [(2, [41, 42]), (5, [5, 6, 7, 8, 30]), (5, [20, 21, 22, 30, 40])]


def crowd_sets(rng, size):
    """Near copies of two texts with up to 5 edits at few places, copies cut short, and some sets of their own."""
    found = []
    for i in range(size):
        words = [f"{'cd'[i % 5 == 0]}{j}" for j in range(rng.choice([100, 100, 100, 92, 84]))]
        for _ in range(rng.randrange(6)):
            words[rng.choice([3, 20, 21, 40, 60, 77, rng.randrange(80)])] = f"{rng.choice('xyz')}{rng.randrange(4)}"
        found.append(near_copies.shingle_set(" ".join(words).encode()))
    found += [near_copies.shingle_set(f"own {i} of the few words here".encode()) for i in range(5)]
    return list({s.tobytes(): s for s in found}.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crowd_pairs_lose_no_link(spark, seed):
    """Every pair of one key at 0.8 whose labels differ is linked for certain, a candidate, or joined through such links."""
    rng = random.Random(seed)
    sets = crowd_sets(rng, 150)
    n = len(sets)
    members = [(key, i, len(s), i, n) for key in (1, 2) for i, s in enumerate(sets) if key == 1 or i % 2]
    crowd = spark.createDataFrame(members, "key long, fold long, n long, label long, c long").repartition(3)
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "fold long, shingles binary")
    certain, pairs = near_copies._crowd_pairs(crowd, table)
    links = {(r["a"], r["b"]) for r in certain.collect()}
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    true = {(i, j) for j in range(n) for i in range(j) if near_copies.similar(sets[i], sets[j])}
    assert links <= true and true

    def classes(edges):
        label = list(range(n))
        for a, b in edges:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        return label

    assert classes(links | (found & true)) == classes(true)
    assert len(found) < n * (n - 1) / 4  # fewer than half of all pairs are judged


def test_crowd_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "key long, fold long, n long, label long, c long")
    certain, pairs = near_copies._crowd_pairs(empty, spark.createDataFrame([], "fold long, shingles binary"))
    assert certain.collect() == pairs.collect() == []


def test_near_stage_crowd(spark, monkeypatch):
    """A crowd whose members are mostly just under 0.8 of each other, with every key that is apart taken as a crowd."""
    monkeypatch.setattr(near_copies, "CROWD", 3)
    rng = random.Random(8)
    texts = []
    for _ in range(120):
        words = [f"c{j}" for j in range(100)]
        for at in rng.sample(range(100), rng.randrange(1, 5)):
            words[at] = f"x{rng.randrange(300)}"
        texts.append(" ".join(words))
    sets = [near_copies.shingle_set(t.encode()) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if near_copies.similar(a, b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.similar_components(frame).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 120


def test_crowds_hold_each_member_once(spark):
    """Keys that share a member are one crowd; members of one key are never parted."""
    keys = {1: [5, 6, 7], 2: [7, 8], 3: [6, 8, 9], 4: [20, 21], 5: [21, 22]}
    rows = [(key, fold, 10 * fold, fold % 3) for key, folds in keys.items() for fold in folds]
    got = near_copies._crowds(spark.createDataFrame(rows, "key long, fold long, n long, label long")).collect()
    by_crowd = {}
    for r in got:
        assert (r["n"], r["label"]) == (10 * r["fold"], r["fold"] % 3)
        by_crowd.setdefault((r["key"], r["c"]), []).append(r["fold"])
    assert sorted((c, sorted(folds)) for (_, c), folds in by_crowd.items()) == [(3, [20, 21, 22]), (5, [5, 6, 7, 8, 9])]
    assert near_copies._crowds(spark.createDataFrame([], "key long, fold long, n long, label long")).collect() == []


def test_near_stage_spells_out_a_crowd_once(spark, monkeypatch):
    """Near copies that meet in many keys have their differences taken once each, not once per key."""
    monkeypatch.setattr(near_copies, "CROWD", 3)
    counted, stage = {}, near_copies.staged

    def counting(df, name):
        found = stage(df, name)
        if name in ("differences", "items"):
            counted[name] = found.count()
        return found

    monkeypatch.setattr(near_copies, "staged", counting)
    rng = random.Random(9)
    texts = []
    for _ in range(100):
        words = [f"c{j}" for j in range(100)]
        for at in rng.sample(range(100), rng.randrange(2, 6)):
            words[at] = f"x{rng.randrange(300)}"
        texts.append(" ".join(words))
    near_copies.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert 0 < counted["differences"] <= 100
    assert 0 < counted["items"] <= 100 * 50  # of both kinds at most 25, from five edited words


def test_near_stage_leaves_a_crowds_pairs_to_its_search(spark, monkeypatch):
    """Members of a crowd that also meet in keys of few rows are not paired there: the pairs grow with the members."""
    monkeypatch.setattr(near_copies, "CROWD", 12)
    counted, stage = {}, near_copies.staged

    def counting(df, name):
        found = stage(df, name)
        if name in ("met-pairs", "rest-a"):
            counted[name] = found.count()
        return found

    monkeypatch.setattr(near_copies, "staged", counting)
    rng = random.Random(10)
    size = 400
    texts = []
    for _ in range(size):
        words = [f"c{j}" for j in range(100)]
        for at in rng.sample(range(100), rng.randrange(1, 5)):
            words[at] = f"x{rng.randrange(300)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"own{i}v{j}" for j in range(60)) for i in range(40)]
    sets = [near_copies.shingle_set(t.encode()) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if near_copies.similar(a, b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.similar_components(frame).collect()}
    assert got == dict(enumerate(label)) and 41 < len(set(label)) < size
    assert 0 < counted["met-pairs"] < size * (size - 1) / 10
    assert counted["rest-a"] < 12 * size


def test_known_crowds_meet_nowhere_else(spark, monkeypatch):
    """Rows of one known crowd make no pair, and of a crowded key only the row that leads and those of other crowds come out."""
    monkeypatch.setattr(near_copies, "CROWD", 4)
    crowd = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}
    keys = {0: [1, 2, 6], 1: [1, 2, 3, 4, 5, 7], 2: [6, 7], 3: [1, 2, 3, 4, 5]}
    rows = [(key, fold, 10, 7, crowd[fold]) for key, folds in keys.items() for fold in folds]
    frame = spark.createDataFrame(rows, "key long, fold long, n long, word long, crowd long").coalesce(1)
    got = near_copies._met(frame).collect()
    assert sorted((r["a"], r["b"]) for r in got if r["key"] is None) == [(1, 6), (1, 7), (2, 6), (6, 7)]
    assert sorted((r["key"], r["a"]) for r in got if r["key"] is not None) == [(1, 1), (1, 7), (3, 1)]
    only = near_copies._met(frame.drop("crowd"), spelled=False).collect()
    assert {r["key"] for r in only if r["key"] is not None} == {1, 3}
    assert sorted((r["a"], r["b"]) for r in only if r["key"] is None) == sorted([(1, f) for k in (1, 3) for f in keys[k][1:]])


def test_near_stage_pairs_few_texts_that_share_a_passage(spark, monkeypatch):
    """Texts that share a long passage meet in many keys but are far from 0.8: their keys' bits tell, so few pairs are made."""
    counted, stage = {}, near_copies.staged

    def counting(df, name):
        found = stage(df, name)
        if name == "met-pairs":
            counted[name] = found.count()
        return found

    monkeypatch.setattr(near_copies, "staged", counting)
    size, passage = 400, [f"p{j}" for j in range(60)]
    texts = [[*passage, *(f"own{i}v{j}" for j in range(60))] for i in range(size)]
    texts += [[*t[:100], *(f"new{i}v{j}" for j in range(20))] for i, t in enumerate(texts[:30])]  # no link
    texts += [[*t[:-6], *(f"end{i}v{j}" for j in range(6))] for i, t in enumerate(texts[:30])]
    texts = [" ".join(t) for t in texts]
    sets = [near_copies.shingle_set(t.encode()) for t in texts]
    links = [(j, i) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if near_copies.similar(a, b)]
    assert links == [(i, size + 30 + i) for i in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.similar_components(frame).collect()}
    assert got == {i: i - size - 30 if i >= size + 30 else i for i in range(size + 60)}
    assert 30 <= counted["met-pairs"] < 4 * size


@pytest.mark.parametrize("sizes", [(18, 1, 1), (90, 10, 10), (900, 100, 100), (4, 0, 1)])
def test_near_stage_words_keep_similar_sets(spark, monkeypatch, sizes):
    """Sets at 0.8 pair by the bits that go with their keys, also where these are more apart than others'; opposite bits do not."""
    rng = np.random.default_rng(7)
    both, a, b = sizes
    prints = []
    for _ in range(150):
        s = rng.integers(0, 1 << 63, both + a + b, np.uint64)
        prints += [near_copies.simhash(np.sort(s[: both + a])), near_copies.simhash(np.sort(np.r_[s[:both], s[both + a :]]))]
    prints = np.array(prints)[:, : 8 * len(near_copies.WORDS)]
    far = prints.copy()
    far[1::2, 8:] = ~far[::2, 8:]
    n = [both + a, both + b] * 150
    rows = [(i // 2, i, n[i], i, *w) for i, w in enumerate(prints.copy().view(np.int64).tolist())]
    rows += [(r[0] + 1000, r[1] + 1000, r[2], r[3] + 1000, *w) for r, w in zip(rows, far.copy().view(np.int64).tolist(), strict=True)]
    schema = ", ".join(f"{c} long" for c in ("key", "fold", "n", "crowd", *near_copies.WORDS))
    got = near_copies._met(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(2 * i, 2 * i + 1) for i in range(150)]


@pytest.mark.parametrize("stage", ["exact", "near", "mix"])
def test_keys_hold_when_files_are_split_anew(spark, tmp_path, monkeypatch, stage):
    """Files are packed into other partitions after the rows are chosen; no document may be lost for it."""
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(40)), "en", "a", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(12).write.parquet(
        str(tmp_path / "docs")
    )
    docs, staged = spark.read.parquet(str(tmp_path / "docs")), corpus_pipeline.staged
    want = Counter(r["doc_id"] for r in getattr(corpus_pipeline, stage)(spark, docs, SF).collect())
    name = "spark.sql.files.maxPartitionBytes"

    def split_anew(df, label):
        found = staged(df, label)
        if label in ("kept", "copies"):
            spark.conf.set(name, "2000")
        return found

    monkeypatch.setattr(corpus_pipeline, "staged", split_anew)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = Counter(r["doc_id"] for r in getattr(corpus_pipeline, stage)(spark, spark.read.parquet(str(tmp_path / "docs")), SF).collect())
    finally:
        spark.conf.unset(name)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and len(want) > 30


def test_mix_stage_repeats_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == docs.columns
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total = docs.agg(F.sum(words)).first()[0]
    assert abs(mixed.agg(F.sum(words)).first()[0] - 1.5 * total) <= 0.02 * total


def test_quality_stage_drops_by_score(spark, docs):
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    assert 0 < kept.count() <= docs.count()


def test_training_gets_no_rows_in_the_driver(spark, docs, monkeypatch):
    """What training gets comes as Arrow: rows took several times its size in the driver's JVM and Python."""

    def no_rows(self):
        raise AssertionError("rows in the driver")

    monkeypatch.setattr(type(docs), "collect", no_rows)
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    model = quality_classifier.train(texts, spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.vectors.shape == (quality_classifier.TERMS, quality_classifier.DIMENSIONS) and model.vectors.any()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    assert max(r["offset"] + r["length"] for r in rows) <= 2048
