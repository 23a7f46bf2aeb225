"""The ten operators against brute force on small fixtures, with their odd cases."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import packing, pii, quality_classifier, queries, shared, simhash, warc
from threadloom.llm.components import component_labels
from threadloom.llm.exact_dedup import block_naming_dedup
from threadloom.llm.mixing import fit, mix_sources, targets
from threadloom.llm.packing import best_fit_packing
from threadloom.llm.quality_classifier import held_out, quality_scores
from threadloom.llm.quality_rules import quality_rules
from threadloom.llm.substring_dedup import substring_dedup
from threadloom.llm.token_counts import PLAIN, PreTokens, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = r"[\x20\x09-\x0D]"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 0),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen FOURTEEN", "en", "a", None),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b\x0c\r ", "en", "b", 7),
    (6, "one  two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", None, 1),
    (6, "one  two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", None, 1),
    (7, "mail a@b.co, 10.0.0.1, 4111 1111 1111 1111, +49 (30) 123456-78 <|endoftext|> http://x.y/z", "de", "c", 2),
    (8, "été 你好 it's 12 " * 700, "fr", "c", 3),
    (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 0),
    (9, "w" * 9000, "en", "c", 0),
    (10, "\n".join(["same line here"] * 6), "en", "c", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    frame = spark.createDataFrame(ODD, SCHEMA)
    for name in ("rid", "norm", "name", "words", "k", "z", "key", "size", "score", "hashes", "length"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(frame):
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def last(i):
    return (i is None, i or 0)


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_exact_dedup(odd, block):
    groups = defaultdict(list)
    for i, t in texts_of(odd):
        groups[re.sub(WS, "", t)].append((i, len(t)))
    want = Counter()
    for norm, rows in groups.items():
        best = min(rows, key=lambda r: (-r[1], last(r[0])))
        rest = list(rows)
        rest.remove(best)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        want[(best[0], best[0], len(rows), True, sha)] += 1
        want.update((r[0], best[0], len(rows), False, sha) for r in rest)
    found = block_naming_dedup(odd, block=block).collect()
    assert Counter(tuple(r)[:-1] for r in found) == want
    # One identity for each document: as many as there are different texts.
    assert len({r["identity"] for r in found}) == len({(r["identity"], r["text_sha256"]) for r in found}) == len(groups)


def test_naming_is_by_content_not_place(spark):
    """Blocks shared at other places, prefixes and suffixes do not make documents equal."""
    texts = ["aabb", "bbaa", "aabbaa", "aa", "bb", "aabb", "aabbaabb", "aabbaabb", "aabbaabbaa"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = {r["doc_id"]: r["group_size"] for r in block_naming_dedup(frame, block=2).collect()}
    assert sizes == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2, 8: 1}


# ---------------------------------------------------------------- 2


def brute_fingerprint(text):
    words = re.findall(rf"[^{WS[1:-1]}]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]


def test_simhash(odd):
    rows = [(i, brute_fingerprint(t)) for i, t in texts_of(odd)]
    want = Counter((i, f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows, 2), strict=True))
    assert Counter(map(tuple, simhash.simhash_components(odd).collect())) == want


def test_simhash_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"Wörd{i} x" for i in range(900))
    monkeypatch.setattr(simhash, "CHUNK", 500)
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("crowd", [1, 256])
def test_close_pairs(spark, crowd):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12)
    values = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (25, 2))}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    reps = spark.createDataFrame([(v,) for v in values], "fp long")
    assert len(want) > 100
    assert set(map(tuple, simhash.close_pairs(reps, crowd=crowd).collect())) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 75), (7, 7), (None, 3), (100, 50), (200, 201)]
    got = dict(component_labels(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(31)} | {100: 50, 50: 50, 75: 50, 200: 200, 201: 200}


# ---------------------------------------------------------------- 3


def test_classifier(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    seen = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p["predicted"] == q for p, q in seen) / len(seen) > 0.95
    # Calibration: by tenths of the score, how far the mean score is from the share of good documents.
    tenths = defaultdict(list)
    for p, q in seen:
        tenths[min(9, int(10 * p["score"]))].append((p["score"], q))
    assert sum(abs(sum(s for s, _ in b) - sum(q for _, q in b)) for b in tenths.values()) / len(seen) < 0.05


def test_classifier_without_labels(spark, odd):
    for rows in ([], [(1, 1, 0), (4, 1, 0)], [(None, 1, 0), (1, None, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = quality_scores(odd, labels).collect()
        assert len(got) == len(ODD)
        assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out(spark):
    rows = spark.createDataFrame([(1,), (None,)], "doc_id long").select("doc_id", held_out(F.col("doc_id"))).collect()
    assert [r[1] for r in rows] == [zlib.crc32(b"1") % 3 == 1, zlib.crc32(b"") % 3 == 1]


def test_whole_text_and_whole_words_count():
    """What comes after 100,000 words or 1000 bytes of one word counts as much as what comes before."""
    short, long = [b"ab"] * 100_000, [b"w" * 30] * 100_000
    assert quality_classifier._measures(b"", short + long)[-1] == pytest.approx(np.log2(17))
    terms = quality_classifier._Terms()
    assert terms[b"w" * 2000] >> 16 != terms[b"w" * 1999 + b"v"] >> 16
    assert terms[b"quality"] >> 16 != terms[b"garbage"] >> 16


def test_context_sums_by_hand(spark, monkeypatch):
    """Neighbours added up one by one, in texts shorter and longer than a stretch."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "c", "Dd", "e1"], n)) for n in (0, 1, 2, 3, 5, 40, 7, 8, 9, 100, 16, 1)]
    index, want = quality_classifier.index_vectors().astype(int), defaultdict(int)
    assert (np.abs(index).sum(axis=1)[:-1] == quality_classifier.NONZERO).all()
    for text in texts:
        t = [zlib.crc32(w.encode()) % quality_classifier.GAP for w in text.split()]
        for i, term in enumerate(t):
            want[term] = want[term] + sum((index[t[j]] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(t)), np.zeros(64, int))
    found = quality_classifier.context_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert {i for i in np.flatnonzero(found.any(axis=1))} == {i for i, v in want.items() if np.any(v)}
    assert all((found[i] == v).all() for i, v in want.items())
    monkeypatch.setattr(quality_classifier, "STRETCH", 8)
    terms, sums = quality_classifier._Terms(), quality_classifier.ContextSums()
    for text in texts:
        sums.add(terms.of(text.encode().split()) >> 16)
    sums.settle()
    assert all((sums.sums[i] == v).all() for i, v in want.items())


def test_scores_by_hand():
    """Pooling, network and temperature, number by number."""
    Q = quality_classifier
    rng, index = np.random.default_rng(4), Q.index_vectors()
    texts = [b" ".join(rng.choice([b"good", b"fine", b"ok", b"junk###", b"bad!!"], 30, p=p)) for p in ([0.4, 0.3, 0.2, 0.05, 0.05], [0.1, 0.1, 0.2, 0.3, 0.3]) for _ in range(60)]
    terms, sums = Q._Terms(), Q.ContextSums()
    for t in texts:
        sums.add(terms.of(t.split()) >> 16)
    sums.settle()
    vectors = Q.word_vectors(sums.sums.astype(float))
    x = np.array([Q.pooled(t, terms, vectors, index) for t in texts], float)
    shapes = {b"good": b"x", b"fine": b"x", b"ok": b"x", b"junk###": b"x#", b"bad!!": b"x!"}
    for t, got in zip(texts, x, strict=True):
        mean = np.zeros(192)
        for w in t.split():
            i, j = zlib.crc32(w) % Q.GAP, zlib.crc32(shapes[w], 1) % Q.GAP
            mean += np.concatenate([sums.sums[i] / np.linalg.norm(sums.sums[i]), index[i], index[j]]) / 30
        assert np.allclose(got[:192], mean, atol=1e-5)
        assert np.allclose(got[192:], [1 - len(set(t.split())) / 30, 1 - len(set(zip(t.split(), t.split()[1:], strict=False))) / 29, 0, np.log2(31), np.log2(31), np.log2(1 + sum(map(len, t.split())) / 30)])
    y, aside = np.repeat([1, 0], 60), np.arange(120) % 5 == 0
    model = Q.fitted(vectors, x, y, aside)
    logits = [sum(np.tanh(sum((v - m) / s * w for v, m, s, w in zip(row, model.mean, model.scale, column, strict=True)) + b) * o for column, b, o in zip(model.w1.T, model.b1, model.w2, strict=True)) + model.b2 for row in x[:6]]
    assert np.allclose(model.scores(x[:6]), [1 / (1 + np.exp(-z / model.temperature)) for z in logits])
    plain, truth = model.logits(x[aside]), y[aside]
    loss = lambda t: -np.mean(np.where(truth, -np.logaddexp(0, -plain / t), -np.logaddexp(0, plain / t)))
    assert all(loss(model.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.25, 16, 97))


def test_repeated_doc_ids_train_alike(spark):
    """Several texts and labels of one doc_id: the same model in any order of rows."""
    rows = [(i % 20, f"word{i % 7} " * (5 + i % 3) + ("###" if i % 2 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 2, "doc_id long, quality int")
    got = [sorted(quality_scores(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels).collect()) for r, n in ((rows, 2), (rows[::-1], 3))]
    assert got[0] == got[1]


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_packing(request, name):
    frame = request.getfixturevalue(name)
    encode = Tokenizer.from_file(BYTE_BPE).encode
    want = Counter()
    for i, t in texts_of(frame):
        ids = np.array([*encode(t, add_special_tokens=False).ids, 0], "<u4")
        for n, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            want[(i, n, start, length, zlib.crc32(ids[start : start + length].tobytes()))] += 1
    rows = best_fit_packing(frame, BYTE_BPE).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= -(-sum(r["length"] for r in rows) // 2048) * 11 / 9 + 1


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_sweep_places_each_rank_once():
    rng = np.random.default_rng(5)
    counts = Counter(map(int, rng.integers(1, 65, 3000)))
    room, placed = Counter(), Counter()
    for length, first, end, sequence, offset in packing.sweep(counts, 64):
        for i in range(end - first):
            placed[(length, first + i)] += 1
            assert room[sequence + i] == offset
            room[sequence + i] += length
    assert max(room.values()) <= 64
    assert all(placed[(n, r)] == 1 for n, c in counts.items() for r in range(c)) and len(placed) == 3000
    assert len(room) <= -(-sum(n * c for n, c in counts.items()) // 64) * 1.02 + 1


# ---------------------------------------------------------------- 5


def test_quality_rules(odd):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules(odd).collect())
    want = Counter()
    for i, t in texts_of(odd):
        words = re.findall(rf"[^{WS[1:-1]}]+", t)
        windows = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        twice = Counter(windows)
        covered = {j + o for j, w in enumerate(windows) if twice[w] > 1 for o in range(5)}
        lines = [x for x in t.split("\n") if re.search(rf"[^{WS[1:-1]}]", x)]
        want[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))] += 1
    assert got == want


def test_rules_keep_clean_text(spark):
    rows = {r["doc_id"]: r["kept"] for r in quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [rows[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [rows[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_token_counts(request, name):
    frame = request.getfixturevalue(name)
    encode = Tokenizer.from_file(WORD_BPE).encode
    want = Counter()
    for i, t in texts_of(frame):
        n = len(encode(t, add_special_tokens=False).ids)
        want[(i, len(t.encode()), n, n > 2048)] += 1
    assert Counter(map(tuple, token_counts(frame, WORD_BPE).collect())) == want


def test_token_counts_odd_characters(spark):
    texts = ["it's DON'T we'll '' '''s", "\x1c\x85\xa0 a", "ΑΣ ΣΑΣ", "Å ﬁn q", "😀😀 !!!'s", "²½¼ İ", "<|startoftext|>"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encode = Tokenizer.from_file(WORD_BPE).encode
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame, WORD_BPE).collect()}
    assert got == {i: len(encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def _counted(split, text):
    pretokens, added = split.of(text)
    return added + sum(split.pieces([t.encode() for t in pretokens]))


def test_token_counts_fuzz():
    """All pairs of plain characters, and random texts with any others and added tokens."""
    split = PreTokens(WORD_BPE)
    encode = split.tokenizer.encode_batch
    for a in range(PLAIN):
        texts = [chr(a) + chr(b) for b in range(PLAIN)]
        assert [_counted(split, t) for t in texts] == [len(e.ids) for e in encode(texts, add_special_tokens=False)]
    rng = np.random.default_rng(3)
    some = [chr(c) for c in range(PLAIN)] + list(" \n'stredl") * 20 + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end"] * 4
    some += [chr(c) for low, high in ((0x250, 0x3000), (0x300, 0x370), (0x3000, 0xD800), (0x10000, 0x20000)) for c in rng.integers(low, high, 150)]
    texts = ["".join(some[i] for i in rng.integers(0, len(some), rng.integers(0, 60))) for _ in range(20_000)]
    assert [_counted(split, t) for t in texts] == [len(e.ids) for e in encode(texts, add_special_tokens=False)]


def test_token_counts_hot_words(spark):
    """A word that very many documents of a block have is met by block, with the same sums."""
    frame = spark.createDataFrame([(i, f"the hot word {i} the") for i in range(3000)], "doc_id long, text string").repartition(2)
    encode = Tokenizer.from_file(WORD_BPE).encode
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame, WORD_BPE).collect()}
    assert got == {i: len(encode(f"the hot word {i} the").ids) for i in range(3000)}


# ---------------------------------------------------------------- 7


def test_mixing(odd, docs):
    for frame in (odd, docs):
        rows = [(r["doc_id"], r["source"], len(re.findall(rf"[^{WS[1:-1]}]+", r["text"] or ""))) for r in frame.collect()]
        totals = Counter()
        for _, s, n in rows:
            totals[s] += n
        want = targets(totals, (5, 2, 1), 1.5, 2)
        got = mix_sources(frame).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, n) for i, _, n in rows)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
        source = {i: s for i, s, _ in rows}
        taken = Counter()
        for r in got:
            assert r["source_size"] == totals[source[r["doc_id"]]]
            assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
            taken[source[r["doc_id"]]] += r["taken"]
        if frame is docs:
            assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 1 for s in totals)
        assert sorted(map(str, got)) == sorted(map(str, mix_sources(frame).collect()))


def test_targets():
    assert sum(targets({"a": 10, "b": 100, "c": 1000}, (5, 2, 1), 1.5, 2).values()) == pytest.approx(1665)
    got = targets({"b": 100, None: 100, "a": 100}, (5, 2, 1), 1.5, 2)
    assert got["a"] == 200 and got["b"] == pytest.approx(250 * 2 / 3) and got[None] == pytest.approx(250 / 3)
    assert targets({"a": 0}, (5, 2, 1), 1.5, 2) == {"a": 0}
    assert targets({}, (5, 2, 1), 1.5, 2) == {}


@pytest.mark.parametrize("budget", [0, 1, 7, 50, 123, 5000])
def test_fit_is_exact_where_it_can_be(budget):
    sizes, counts = np.array([0, 3, 5, 11, 40]), np.array([4, 10, 3, 2, 5])
    take = fit(sizes, counts, budget)
    assert (take <= counts).all() and (take >= 0).all()
    reachable = {0}
    for s, c in zip(sizes, counts, strict=True):
        reachable = {r + s * k for r in reachable for k in range(c + 1)}
    assert int((sizes * take).sum()) == max(r for r in reachable if r <= budget)


# ---------------------------------------------------------------- 8


def test_warc_round_trip_and_audit(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>é{i}</p>\r\n\r\n" * (i % 4)) for i in range(40)] + [(3, None, None), (None, "a b\r\nc", "x"), (50, "u", "WARC/1.1\r\n\r\nWARC/")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash")).withColumn("archive", F.lit("clash"))
    one, two = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_warc(warc.archived(pages, 8), one)
    got = warc.read_warc(spark, one).withColumn("body", warc.payload(F.col("record").cast("string"))).collect()
    assert all(r["payload_ok"] for r in got)
    assert sorted(r["body"] for r in got) == sorted(r[2] or "" for r in rows)
    assert all(r["length"] == len(r["record"]) + 4 for r in got)
    warc.copy_warc(spark, one, two)
    assert warc.fixity(spark, one, two)[1].count() == 0
    hurt = F.when(F.col("record").contains("page:17>"), F.regexp_replace("record", "<p>", "<q>")).otherwise(F.col("record"))
    three = str(tmp_path / "c")
    warc.copy_warc(spark, one, three, hurt)
    records, bad = warc.fixity(spark, one, three)
    place = {(r["archive"], r["seq"]) for r in records.where("record_id = '<urn:page:17>'").collect()}
    assert {(r["archive"], r["seq"]) for r in bad.where("here").collect()} == place and len(place) == 1
    assert {(r["archive"], r["seq"]) for r in bad.where("not here").collect()} == place


def test_warc_missing_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * i) for i in range(30)], "page_id long, url string, html string")
    warc.write_warc(warc.archived(pages), str(tmp_path / "a"))
    warc.write_warc(warc.archived(pages.where("page_id < 29")), str(tmp_path / "b"))
    assert [r["seq"] for r in warc.fixity(spark, str(tmp_path / "a"), str(tmp_path / "b"))[1].collect()] == [29]


def test_warc_record_lost_in_the_middle(spark, tmp_path):
    """What follows a lost or an added record has moved, but is not damaged."""
    pages = spark.createDataFrame([(i, "u", "x" * (i % 7)) for i in range(60)], "page_id long, url string, html string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_warc(warc.archived(pages), a)
    warc.write_warc(warc.archived(pages.where("page_id NOT IN (4, 31)")), b)
    assert sorted((r["seq"], r["here"]) for r in warc.fixity(spark, a, b)[1].collect()) == [(4, True), (31, True)]
    assert sorted((r["seq"], r["here"]) for r in warc.fixity(spark, b, a)[1].collect()) == [(4, False), (31, False)]


def test_warc_pages_without_ids(spark):
    pages = spark.createDataFrame([(None, f"u{i}", "x") for i in range(100)] + [(1, "u", "x")], "page_id long, url string, html string")
    sizes = Counter(r["archive"] for r in warc.archived(pages, 10).collect())
    assert sizes.pop("part-000000000000") == 1
    assert len(sizes) > 5 and sum(sizes.values()) == 100


def test_shared_folder_is_never_local_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())


def test_warc_damaged_bytes():
    data = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + b"junk" + b"\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    parts = list(warc.parse(data))
    assert sum(p[1] for p in parts) == len(data)
    assert parts[0][3] == b"abc" and parts[-1][3] == b"z"


# ---------------------------------------------------------------- 9

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_spans_on_random_text():
    rng, finder = np.random.default_rng(7), pii.Finder()
    for _ in range(20_000):
        text = "".join(rng.choice(list("a1@.+- 2:/é0("), rng.integers(0, 40)))
        assert [s for s in finder.spans(text) if s[0] in PATTERNS] == brute_spans(text)


def test_personal_data(odd):
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.personal_data(odd).collect())
    want = Counter()
    for i, t in texts_of(odd):
        spans = brute_spans(t)
        n = Counter(s[0] for s in spans)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(told.encode()).hexdigest())] += 1
    assert got == want


def test_added_spans():
    finder = pii.Finder()
    assert ("iban", 5, 27) in finder.spans("IBAN DE89370400440532013000 ok")
    assert ("url", 3, 20) in finder.spans("go https://a.b/c?d=e.")
    assert pii.masked("x a@b.co y", finder.spans("x a@b.co y")) == "x [email] y"


@pytest.mark.parametrize("after", ["BIC COBADEFFXXX", "2024", "12 EUR", "A B C D E F", "BIC", "ok", "", "X" * 40, "1 2 3 4 5 6 7 8 9 0"])
def test_iban_before_capitals_and_digits(after):
    finder = pii.Finder()
    for iban in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32"):
        text = f"pay {iban} {after}"
        spans = [s for s in finder.spans(text) if s[0] == "iban"]
        assert spans == [("iban", 4, 4 + len(iban))]
        assert iban not in pii.masked(text, finder.spans(text))


def test_iban_of_unlisted_country():
    spans = pii.Finder().spans("pay ZZ22 3704 0044 0532 0130 00 BIC ok")
    assert [s for s in spans if s[0] == "iban"] == [("iban", 4, 31)]


def brute_cued(text):
    """Secrets, keys and accounts by trying every position; ``free`` is where the next of a kind may begin."""
    found = []
    secret = re.compile(r"""["']?[ \t]{0,3}[:=][ \t]{0,3}["']?([A-Za-z0-9+/_.~-]{8,}={0,2})""")
    account = re.compile(r"[ ]?(?:[Nn][Uu][Mm][Bb][Ee][Rr]|[Nn][OoRr]\.?|#)?[ ]?[:=#]?[ ]?([0-9](?:[ -]?[0-9]){5,23})(?![A-Za-z0-9])")
    for kind, cues, rule in (("secret", pii.CREDENTIALS, secret), ("account", pii.ACCOUNTS, account)):
        free = 0
        for i in range(len(text)):
            for cue in cues:
                if i < free or text[i : i + len(cue)].lower() != cue or (i and text[i - 1].isalnum()):
                    continue
                m = rule.match(text, i + len(cue))
                value = m[1].rstrip(".") if m else ""
                if len(value) >= (8 if kind == "secret" else 6) and re.search("[0-9]", value):
                    found.append((kind, m.start(1), m.start(1) + len(value)))
                    free = found[-1][2]
    free = 0
    for i in range(len(text)):
        for prefix, rest in pii.KEYS.items():
            m = text.startswith(prefix, i) and re.match(re.escape(prefix) + rest + "(?![A-Za-z0-9])", text[i:])
            if m and i >= free and not (i and text[i - 1].isalnum()):
                found.append(("key", i, i + m.end()))
                free = i + m.end()
    free = 0
    for m in re.finditer(r"[A-Za-z0-9.+-]+://[^\x00-\x20\"'<>()\[\]{}|\\^`]+", text):
        found.append(("url", m.start(), m.start() + len(m[0].rstrip(".,;:!?"))))
    return set(found)


def test_added_kinds_on_random_text():
    rng, finder = np.random.default_rng(8), pii.Finder()
    parts = [*pii.CREDENTIALS, *pii.ACCOUNTS, *pii.KEYS, "Token", "ACCOUNT", " ", " ", ": ", "=", "'", '"', "no.", "Number", "#", "12345678", "a1b2c3d4e5", "x" * 36,
             "AB12" * 4, "é", ".", "-", "://", "http", "a.b/c", "1", "0 1-2 3", "A" * 35]
    seen = Counter()
    for _ in range(30_000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 9)))
        got = {s for s in finder.spans(text) if s[0] in ("secret", "key", "account", "url")}
        assert got == brute_cued(text), text
        seen.update(s[0] for s in got)
    assert min(seen[k] for k in ("secret", "key", "account", "url")) > 50


def _iban(country, body):
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{body}"


def test_ibans_against_every_substring():
    rng, finder, seen = np.random.default_rng(9), pii.Finder(), 0
    for _ in range(6000):
        country, length = [("DE", 22), ("NO", 15), ("GB", 22), ("FR", 27), ("MT", 31)][rng.integers(5)]
        body = "".join(rng.choice(list("0123456789AB"), length - 4))
        iban = _iban(country, body)
        shown = " ".join(iban[i : i + 4] for i in range(0, length, 4)) if rng.random() < 0.5 else iban
        text = "".join(rng.choice(list("ab 1A "), rng.integers(0, 5))) + shown + "".join(rng.choice(list("aZ 1,"), rng.integers(0, 5)))
        want = []
        for i in range(len(text)):  # every start whose country's length fits, no blank twice
            m = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])*").match(text, i)
            if not m or (i and text[i - 1].isalnum()) or (want and i < want[-1][2]):
                continue
            n = {"DE": 22, "NO": 15, "GB": 22, "FR": 27, "MT": 31}.get(text[i : i + 2])
            for end in range(i + 15, m.end() + 1):
                bare = text[i:end].replace(" ", "")
                if len(bare) == n and text[end - 1] != " " and not text[end : end + 1].isalnum():
                    if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                        want.append(("iban", i, end))
                    break
        assert [s for s in finder.spans(text) if s[0] == "iban"] == want, text
        seen += len(want)
    assert seen > 1000


@pytest.mark.parametrize("text", ["7" * 1_000_000, "1." * 500_000, "1 " * 500_000, "a@" * 500_000, "+1(" * 300_000, "token=" * 170_000, "://a" * 250_000, "a" * 1_000_000 + "@", "account " * 120_000, "AB12 " * 200_000])
def test_personal_data_is_linear(text):
    """Runs of the worst characters are looked at once: four times the text takes far less than sixteen times as long."""
    took = []
    for part in (text[: len(text) // 4], text):
        start = time.process_time()
        pii.Finder().spans(part)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5


def test_personal_data_recall(docs):
    """Planted identifiers, found by separate patterns, lie within spans; documents without digits have none."""
    planted = re.compile(r'token = "([0-9a-f]{32})"|\b([a-z]+\.\d+@mail\d+\.example\.com)\b|(\+1 \(\d{3}\) 555-\d{4})|(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.])')
    rows = {r["doc_id"]: [(int(x.split(":")[1]), int(x.split(":")[2])) for x in r["spans"].split(",") if x] for r in pii.personal_data(docs, mask=False).collect()}
    hits = misses = 0
    for i, text in texts_of(docs):
        for m in planted.finditer(text):
            inside = any(a <= m.start(m.lastindex) and m.end(m.lastindex) <= b for a, b in rows[i])
            hits, misses = hits + inside, misses + (not inside)
        if not re.search("[0-9@]|://", text):
            assert not rows[i]
    assert hits > 10 and hits >= 0.9 * (hits + misses)


# ---------------------------------------------------------------- 10


def brute_removal(rows):
    least, out = {}, Counter()
    words = [(last(i), i, t.encode().split()) for i, t in rows]
    for order, _, w in words:
        for j in range(len(w) - 12):
            least[tuple(w[j : j + 13])] = min(least.get(tuple(w[j : j + 13]), order), order)
    for order, i, w in words:
        gone = {j + o for j in range(len(w) - 12) if least[tuple(w[j : j + 13])] < order for o in range(13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substring_dedup(odd):
    got = substring_dedup(odd).drop("kept_text")
    assert Counter(map(tuple, got.collect())) == brute_removal(texts_of(odd))


def test_substring_dedup_at_every_shift(spark):
    rng = np.random.default_rng(9)
    shared = [f"s{i}" for i in range(40)]
    rows = []
    for i in range(80):
        own = [f"d{i}w{j}" for j in rng.integers(0, 50, 30 + i)]
        cut = int(rng.integers(0, 28))
        rows.append((int(rng.integers(0, 1000)), " ".join(own[:i] + shared[cut : cut + 12 + int(rng.integers(0, 4))] + own[i:])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_dedup(frame).drop("kept_text").collect())) == brute_removal(rows)


# ---------------------------------------------------------------- all


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n[:3] not in ("op8",)])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op8_warc_fixity(spark, str(tmp_path)).count() == 0


def test_native_operators_have_no_python(docs):
    for frame in (quality_rules(docs), block_naming_dedup(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("MapIn|ArrowEval|BatchEvalPython|InPandas", plan)
