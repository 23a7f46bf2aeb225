"""Near copies by the similarity of their word runs: SimHash keys propose, exact sets decide.

A document's set holds its 5-word shingles (lower-cased words, as in ``simhash``). Documents
are linked where the Jaccard similarity of their sets is at least 0.8. The set's fingerprint
is a SimHash of 2048 bits (a bit is 1 if set in over half the hashes). At a similarity of 0.8
two sets are at an angle of at most acos(8/9), so each of their bits differs with a
probability of at most ``APART``; one pair of sizes goes beyond that and has keys of its own
(``tiny_keys``). Candidates share a key of ``b`` chosen bits in one of so many tables that a
pair at exactly 0.8 shares none with a probability of ``MISS``, a closer pair less often
(``tables``); ``b`` grows with the number of sets, so that keys stay thinly populated. Keys
are taken some tables at a time, so that few of them are on disk at once, and carry the
fingerprint's first 256 bits: rows that share a key but are too far apart by these (most of
them, where many texts share a passage) make no pair. Of the candidates those go whose
fingerprints differ in over a quarter of the bits; the others are judged by their whole sets,
as 64-bit hashes of the shingles.

Equal sets are folded first. Each set is judged against two of its candidates, and what that
links is one component; only pairs whose ends are still apart are judged in full. Where a key
has a crowd, such pairs are not spelled out but found by what sets them apart from a
reference set of the crowd (``_crowd_pairs``). Crowded keys that share members are one crowd
(``_crowds``), so a member counts once, not once per key. The first tables are gone through
for crowds alone before any pair is spelled out: two members of one crowd also meet in keys
of few rows, in so many of them that these would spell out nearly all pairs of the crowd.
As its search finds every link between its members, such pairs are left to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_labels
from .shared import documents, give_back, map_arrow, staged

SHINGLE = 5
BITS = 2048  # of a fingerprint
APART = 0.1515  # acos(8 / 9) / pi, rounded up
MISS = 1e-5
TABLES = 24  # whose keys are on disk at once
AHEAD = 48  # tables gone through first, for crowds alone
WORDS = [f"word{i}" for i in range(4)]  # columns: the first 64 bits of a fingerprint, the next and so on
WORD_APART = 26  # of the first 64 bits: at 0.8 more differ in 1 of 3 million pairs
WORDS_APART = 70  # of the bits of ``WORDS``, likewise
TINY_APART = 81  # of these for sets of 4 and 5, likewise (0.1875 of their bits differ)
CROWD = 64  # members of a key above which its pairs are found by differences from a reference set
HEAD = 8  # items that two lists of differences must share within their heads, where they must share as many at all
MERGED = 1 << 15  # rows whose keys are compared at a time
PART = 1024  # shingles whose bits are counted at a time
FEW = 24  # rows of bits below which adding them up at once is quicker than adders
_RNG = np.random.default_rng(5)
_WORD = _RNG.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _RNG.integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words than one has is one shingle."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] * bool(words), np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    return np.unique(_mixed(sum(h[j : j + n] * _WORD[j] for j in range(SHINGLE))))


def _ones(words: np.ndarray) -> np.ndarray:
    """How many rows of ``words`` set each bit: full adders over whole words, then sums of what is left."""
    total, weight = np.zeros(64 * words.shape[1], np.int64), 1
    while True:
        carries = []
        while len(words) > 2 * FEW:
            k = len(words) // 3
            a, b, c = words[:k], words[k : 2 * k], words[2 * k : 3 * k]
            odd = a ^ b
            carries.append((a & b) | (c & odd))
            words = np.concatenate([odd ^ c, words[3 * k :]])
        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
        total += weight * bits.sum(axis=0, dtype=np.uint8).astype(np.int64)  # at most 2 * FEW rows
        if not carries:
            return total
        words, weight = np.concatenate(carries), 2 * weight


def _hashes(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` bits of each shingle."""
    wide = shingles[:, None] * _TIMES
    return wide ^ (wide >> np.uint64(32))


def simhash(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of a set: its bytes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), PART):
        ones += _ones(_hashes(shingles[at : at + PART]))
    return np.packbits(2 * ones > len(shingles))


def tables(b: int) -> np.ndarray:
    """The bits of each table's keys: as many tables as ``MISS`` takes."""
    n = math.ceil(math.log(MISS) / math.log1p(-((1 - APART) ** b)))
    rng = np.random.default_rng(b)
    return np.array([64 + rng.choice(BITS - 64, b, replace=False) for _ in range(n)])


def table_keys(prints: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
    """The keys of each fingerprint (a row of bytes) in the tables ``at``, numbered from ``first``."""
    bits = np.unpackbits(prints, axis=1)[:, at.ravel()].reshape(len(prints), *at.shape)
    wide = np.zeros((*bits.shape[:2], 32), np.uint8)
    wide[:, :, : at.shape[1]] = bits
    keys = np.packbits(wide, axis=2).view(np.uint32)[:, :, 0].astype(np.int64)
    return keys | (np.arange(first, first + len(at), dtype=np.int64) << 32)


def tiny_keys(shingles: np.ndarray) -> list[int]:
    """Keys that sets of 4 and of 5 with 4 in common share: the 4. Sums of so few hashes tie so
    often that their bits differ more (0.1875) than their angle says."""
    if len(shingles) not in (4, 5):
        return []
    fours = [shingles] if len(shingles) == 4 else [np.delete(shingles, i) for i in range(5)]
    return [-1 - (xxhash.xxh64_intdigest(f.tobytes()) >> 1) for f in fours]  # below any table's


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is at least 0.8, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def near_prints(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether at most a quarter of the bits differ: at 0.8 that is 12 standard deviations off (7 for sets of 4 and 5)."""
    return 4 * int(np.bitwise_count(a ^ b).sum()) <= BITS


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, ``fold`` (a hash of the set), ``n`` (its size), its fingerprint ``fp`` and its ``tiny`` keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            folds = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            prints = pa.array([simhash(s).tobytes() for s in sets], pa.binary())
            tiny = pa.array([tiny_keys(s) for s in sets], pa.list_(pa.int64()))
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(folds), n, prints, tiny], names=["doc_id", "fold", "n", "fp", "tiny"])

    none, empty = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    schema = docs.select("doc_id", none.alias("fold"), none.alias("n"), F.lit(b"").alias("fp"), empty.alias("tiny")).schema
    return map_arrow(docs, run, schema)


def _keyed(reps: DataFrame, at: np.ndarray, first: int) -> DataFrame:
    """(key, fold, n, crowd, ``WORDS``) of each row of ``reps`` in the tables ``at``. With the first tables its tiny keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            prints = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(len(batch), -1)
            fold, n, crowd = (batch.column(c).to_numpy() for c in ("fold", "n", "crowd"))
            words = prints[:, : 8 * len(WORDS)].copy().view(np.int64)
            keys = [table_keys(prints, at, first).ravel()]
            rows = [np.repeat(np.arange(len(batch)), len(at))]
            if not first:
                tiny = batch.column("tiny").to_pylist()
                keys.append(np.array([k for ks in tiny for k in ks], np.int64))
                rows.append(np.repeat(np.arange(len(batch)), [len(ks) for ks in tiny]))
            row = np.concatenate(rows)
            columns = (np.concatenate(keys), fold[row], n[row], crowd[row], *(w[row] for w in words.T))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    names = ["key", "fold", "n", "crowd", *WORDS]
    return map_arrow(reps.select("fold", "n", "fp", "tiny", "crowd"), run, ", ".join(f"{c} bigint" for c in names))


def _larger(batches: Iterable[pa.RecordBatch], names: list[str], merged: int) -> Iterator[list[np.ndarray]]:
    """The columns of some batches at a time: these rows are narrow, and batches are made for texts."""
    got, n = [], 0
    for batch in batches:
        got.append([batch.column(c).to_numpy() for c in names])
        n += len(batch)
        if n >= merged:
            yield list(map(np.concatenate, zip(*got, strict=True)))
            got, n = [], 0
    if n:
        yield list(map(np.concatenate, zip(*got, strict=True)))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each two words differ."""
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64)


def _met(sorted_keys: DataFrame, spelled: bool = True) -> DataFrame:
    """Of rows (key, fold, n, words) sorted by key, those of a key in one partition: candidate pairs (a, b), ``key`` null;
    and of keys with a crowd the members (key, a, n), ``b`` null, and their pairs with one of them, which leads.

    The words are ``WORDS``, or the first of them alone as ``word``; pairs that are too far apart by them do not come out.

    Rows may also have the ``crowd`` that they are known to be in, or else their own fold: no pair of one crowd comes
    out, and of the members only the one that leads and those of other crowds than its own. Unless ``spelled``, keys
    without a crowd are passed over. At most a crowd's first rows are held back from one batch to the next.
    """
    crowd, merged = CROWD, MERGED
    words = ["word"] if "word" in sorted_keys.columns else WORDS
    names = ["key", "fold", "n", "crowd" if "crowd" in sorted_keys.columns else "fold", *words]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead = [np.zeros(0, np.int64)] * len(names), None  # rows of the last key; where it is a crowd, the row that leads

        def pairs(x: list[np.ndarray], i: np.ndarray, y: list[np.ndarray], j: np.ndarray) -> pa.RecordBatch:
            """The rows ``i`` of ``x``, each with its row of ``j`` of ``y``."""
            least, most = np.minimum(x[2][i], y[2][j]), np.maximum(x[2][i], y[2][j])
            kept = (x[3][i] != y[3][j]) & (5 * least >= 4 * most) & (_apart(x[4][i], y[4][j]) <= WORD_APART)
            i, j, most = i[kept], j[kept], most[kept]
            if len(words) > 1:
                bits = sum(_apart(p[i], q[j]) for p, q in zip(x[4:], y[4:], strict=True))
                kept = bits <= np.where(most == 5, TINY_APART, WORDS_APART)
                i, j = i[kept], j[kept]
            x, y = x[1][i], y[1][j]
            none = pa.nulls(len(x), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), none], names=["key", "a", "b", "n"])

        def members(x: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.nulls(len(x[0]), pa.int64()), pa.array(x[2])], names=["key", "a", "b", "n"])

        def few(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for d in range(1, crowd if spelled else 1):
                i = np.flatnonzero(rows[0][:-d] == rows[0][d:])
                if not len(i):
                    return
                yield pairs(rows, i, rows, i + d)

        for part in _larger(batches, names, merged):
            rows = [np.concatenate(x) for x in zip(held, part, strict=True)]
            starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            sizes = np.diff(np.r_[starts, len(rows[0])])
            some = np.zeros(len(rows[0]), bool)
            for at, size in zip(starts.tolist(), sizes.tolist(), strict=True) if lead is not None or sizes.max() > crowd else ():
                led = lead is not None and at == 0 and rows[0][0] == lead[0][0]
                if not led and size <= crowd:
                    continue
                some[at : at + size] = True
                own = [c[at : at + size] for c in rows]
                head = lead if led else [c[:1] for c in own]
                news = own[3] != head[3]
                news[0] |= not led
                yield members([c[news] for c in own])
                yield pairs(own, np.arange(size), head, np.zeros(size, np.int64))
                if at + size == len(rows[0]):
                    lead = head
            last = starts[-1]
            if some[last]:
                held = [c[:0] for c in rows]
            else:
                held, lead = [c[last:] for c in rows], None
                some[last:] = True
            yield from few([c[~some] for c in rows])
        yield from few(held)

    return map_arrow(sorted_keys, run, "key bigint, a bigint, b bigint, n bigint")


def _candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Pairs (a, b) that may be similar; members (key, fold, n) of keys with a crowd, a crowd found first being a key as well;
    the rows (fold) that tie such crowds to others; and in how many keys one of a crowd's own is."""
    at = tables(max(12, min(32, reps.count().bit_length())))

    def met(rows: DataFrame, first: int, spelled: bool) -> DataFrame:
        keyed = _keyed(rows, at[first : first + TABLES], first)
        # Of a key the rows known to be in crowds come first, so that one of them leads.
        order = keyed.repartition("key").sortWithinPartitions("key", F.col("crowd") == F.col("fold"))
        found = staged(_met(order, spelled), "met" if spelled else "met-first")
        give_back(reps.sparkSession)
        return found

    alone = reps.withColumn("crowd", F.col("fold"))
    ahead = reduce(DataFrame.unionByName, [met(alone, first, False) for first in range(0, min(AHEAD, len(at)), TABLES)])
    early = ahead.where("key IS NOT NULL").select("key", F.col("a").alias("fold"), "n", F.col("a").alias("label"))
    core = max(1, min(AHEAD, len(at)) // 16)
    crowds = _crowds(early, core).select(F.col("key").alias("crowd"), "fold", "n")
    often = early.groupBy("fold").agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") >= core).select("fold")
    known = staged(crowds.join(often.hint("merge"), "fold").groupBy("fold").agg(F.min("crowd").alias("crowd")), "known-crowds")
    rows = staged(reps.join(known.hint("merge"), "fold", "left").withColumn("crowd", F.coalesce("crowd", "fold")), "crowd-reps")

    found = reduce(DataFrame.unionByName, [ahead.where("key IS NULL"), *(met(rows, first, True) for first in range(0, len(at), TABLES))])
    pairs = staged(found.where("key IS NULL").select("a", "b").distinct(), "met-pairs")
    members = found.where("key IS NOT NULL").select("key", F.col("a").alias("fold"), "n")
    return pairs, members.unionByName(crowds.withColumnRenamed("crowd", "key")), known.select("fold"), max(1, len(at) // 16)


def _sets(texts: DataFrame) -> DataFrame:
    """(fold, shingles) of each row of ``texts`` (fold, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("fold"), pa.array(sets, pa.binary())], names=["fold", "shingles"])

    return map_arrow(texts.select("fold", "text"), run, "fold bigint, shingles binary")


def _judged(pairs: DataFrame, sets: DataFrame, test: Callable[[np.ndarray, np.ndarray], bool] = similar) -> DataFrame:
    """The pairs (a, b) whose sets (fold, shingles) are similar; or whatever else is to be tested of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("x"), batch.column("y"), strict=True)
            kept = pa.array([test(*(np.frombuffer(s.as_py(), np.uint64) for s in xy)) for xy in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(kept)

    # Staged between the joins, so that AQE can split the pairs of a fold that has very many.
    one = staged(pairs.join(sets.select(F.col("fold").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a"), "one-side")
    two = one.join(sets.select(F.col("fold").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    return staged(map_arrow(two.select("a", "b", "x", "y"), run, "a bigint, b bigint"), "similar")


def _sizes_allow(a: str, b: str) -> str:
    return f"5 * least({a}, {b}) >= 4 * greatest({a}, {b})"


def _references(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, ref): the shingles in over half of some 64 members of each key, chosen by hash.

    Any reference set gives right results; one near the middle of the crowd gives few pairs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, shingles in zip(batch.column("key"), batch.column("shingles"), strict=True):
                found = np.frombuffer(shingles.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key.as_py())), pa.array(found)], names=["key", "shingle"])

    some = staged(crowd.where(f"pmod(xxhash64(key, fold), ceil(c / {CROWD})) = 0").select("key", "fold"), "some")
    spread = map_arrow(some.join(sets.hint("merge"), "fold").select("key", "shingles"), run, "key bigint, shingle bigint")
    counted = staged(spread.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("f")), "some-shingles")
    sizes = staged(some.groupBy("key").agg(F.count(F.lit(1)).alias("of")), "some-sizes")
    return counted.join(sizes.hint("merge"), "key").where("2 * f > of").groupBy("key").agg(F.collect_list("shingle").alias("ref"))


def _differences(members: DataFrame) -> DataFrame:
    """The members with ``t`` (size of the reference), ``more`` (shingles outside it) and ``less`` (of it, not in the member)."""
    kept = ["key", "fold", "n", "label"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, more, less = [], [], []
            for ref, shingles in zip(batch.column("ref"), batch.column("shingles"), strict=True):
                own, common = np.frombuffer(shingles.as_py(), np.int64), ref.values.to_numpy()
                t.append(len(common))
                more.append(np.setdiff1d(own, common, assume_unique=True))
                less.append(np.setdiff1d(common, own, assume_unique=True))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (more, less)]
            columns = [*map(batch.column, kept), pa.array(t, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "t", "more", "less"])

    schema = "key bigint, fold bigint, n bigint, label bigint, t bigint, more array<bigint>, less array<bigint>"
    return map_arrow(members.select(*kept, "ref", "shingles"), run, schema)


def _crowds(members: DataFrame, core: int = 1, known: DataFrame | None = None) -> DataFrame:
    """The members (key, fold, n, label) of crowded keys once each, with the crowd as ``key`` and its size ``c``.

    Near copies meet in many keys, whose members are much the same. Keys that share a member
    are one crowd here, so each pair of one key is in one crowd, and a member's differences
    are spelled out once instead of once per key. Only members of at least ``core`` keys tie
    keys together, and those (fold) that are ``known`` to: one that meets a crowd by chance
    belongs to it, but brings no other crowd.
    """
    counts = members.groupBy("fold").agg(F.count(F.lit(1)).alias("keys"))
    if known is not None:
        counts = counts.unionByName(known.withColumn("keys", F.lit(core).cast("long"))).groupBy("fold").agg(F.max("keys").alias("keys"))
    often = staged(counts, "crowd-often")
    tied = F.when(F.col("keys") >= core, F.col("fold"))
    named = staged(members.join(often.hint("merge"), "fold").withColumn("tied", tied), "crowd-ties")
    least = staged(named.groupBy("key").agg(F.coalesce(F.min("tied"), F.min("fold")).alias("b")), "crowd-firsts")
    ends = named.join(least.hint("merge"), "key").select(F.col("tied").alias("a"), "b").where("a IS NOT NULL").distinct()
    crowds = staged(component_labels(staged(ends, "crowd-ends")), "crowd-labels").select(F.col("node").alias("b"), "label")
    of_keys = staged(least.join(crowds.hint("merge"), "b", "left").select("key", F.coalesce("label", "b").alias("crowd")), "crowd-keys")
    once = members.join(of_keys.hint("merge"), "key").select(F.col("crowd").alias("key"), "fold", "n", "label").distinct()
    once = staged(once, "crowd-members")
    sizes = staged(once.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "crowd-sizes")
    return staged(once.join(sizes.hint("merge"), "key").select("key", "fold", "n", "label", "c"), "crowds")


def _crowd_pairs(crowd: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that are certain and candidate pairs (both a, b) of members (key, fold, n, label, c) of crowds.

    Exact for any reference set T of a key. A member A of n shingles holds ``more`` outside T
    and lacks m = |less| of T; A and B share |T| - |less(A) or less(B)| + |more(A) and more(B)|,
    and are similar where 9 times that is at least 4 (n(A) + n(B)). With w = 9 m + 4 n:

    * A and B are similar where w(A) + w(B) <= 9 |T|. If any B does that for A, the member
      L of least w does: so these pairs are linked through L.
    * All other similar pairs share a shingle of ``more``, at least as many as 9 m + 4 n
      + 4 * 0.8 n - 9 |T| ninths for either (a similar set has at least 0.8 n shingles), or,
      sharing none, one of ``less``, at least (w(A) + w(B)) / 9 - |T|. Of sets that share s
      items, the first size - s + 1 of each meet, in any common order (rare first).
    """
    ref = staged(_references(crowd, sets), "references")
    led = staged(crowd.join(ref.hint("merge"), "key", "left").withColumn("ref", F.coalesce("ref", F.array().cast("array<bigint>"))), "referred")
    apart = staged(_differences(led.join(sets.hint("merge"), "fold")).withColumn("m", F.size("less").cast("long")), "differences")
    lead = staged(apart.groupBy("key").agg(F.min(F.struct((9 * F.col("m") + 4 * F.col("n")).alias("w"), "fold", "label")).alias("lead")), "crowd-leads")
    lead = lead.select("key", F.col("lead.w").alias("lw"), F.col("lead.fold").alias("lead"), F.col("lead.label").alias("joined"))
    apart = apart.join(lead.hint("merge"), "key").withColumn("by", F.expr("9 * m + 4 * n + lw - 9 * t"))
    apart = staged(apart.withColumn("near", F.expr("by <= 0 OR fold = lead")), "crowd-led")
    certain = apart.where("by <= 0 AND label <> joined").select(F.least("fold", "lead").alias("a"), F.greatest("fold", "lead").alias("b"))

    fixed = ["key", "fold", "n", "label", "t", "m", "near"]
    beyond = "45 * m + 36 * n - 45 * t"  # 45 times the least number of ``more`` shared
    # Of two that L does not join, one (at least) has w + w(L) > 9 |T|; so one near L shares over (w - w(L)) / 9 with it.
    lacked = "CASE WHEN near THEN floor((9 * m + 4 * n - lw) / 9) + 1 ELSE ceil(by / 9) END"
    more = apart.select(*fixed, F.lit(False).alias("lacks"), F.expr(f"greatest(1, ceil(({beyond}) / 45))").alias("s"), F.col("more").alias("all"))
    less = apart.where(f"{beyond} <= 0").select(*fixed, F.lit(True).alias("lacks"), F.expr(f"greatest(1, {lacked})").alias("s"), F.col("less").alias("all"))
    lists = staged(more.unionByName(less).where("s <= size(all)"), "lists")
    # Heads of the lists in the plain order first: of sets that share s items the first size - s + k of each share k. Members
    # that are far off (in the crowd by chance) must share so much of their lists that most of them go by this.
    lists = lists.withColumn("k", F.expr(f"least(s, {HEAD})"))
    head = F.expr("slice(array_sort(all), 1, cast(size(all) - s + k AS int))")
    heads = staged(lists.select("key", "fold", "lacks", "k", F.explode(head).alias("item")), "heads")
    shared = staged(heads.groupBy("key", "lacks", "item").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "shared-heads")
    met = heads.join(shared.hint("merge"), ["key", "lacks", "item"]).groupBy("key", "lacks", "fold", "k").agg(F.count(F.lit(1)).alias("f"))
    met = staged(met.where("f >= k").select("key", "lacks", "fold"), "met-heads")
    items = lists.join(met.hint("merge"), ["key", "lacks", "fold"]).select(*fixed, "lacks", "s", F.explode("all").alias("item"))
    items = staged(items, "items")
    often = staged(items.groupBy("key", "lacks", "item").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "often")
    known = staged(items.join(often.hint("merge"), ["key", "lacks", "item"]), "known-items")
    ranked = known.groupBy(*fixed, "lacks", "s").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("items"))
    first = F.expr("slice(items, 1, cast(greatest(0, size(items) - s + 1) AS int)).item")
    first = staged(ranked.select(*fixed, "lacks", F.explode(first).alias("item")), "first-items")

    others = first.select("key", "lacks", "item", *(F.col(c).alias(f"{c}2") for c in ("fold", "n", "label", "m", "near")))
    pairs = first.join(others.hint("merge"), ["key", "lacks", "item"]).where("fold < fold2 AND label <> label2 AND NOT (near AND near2)")
    pairs = pairs.where(_sizes_allow("n", "n2")).where("NOT lacks OR 9 * greatest(m, m2) + 4 * (n + n2) <= 9 * t")
    return certain, pairs.select(F.col("fold").alias("a"), F.col("fold2").alias("b"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, component_id (the least doc_id reachable over links).

    ``id_col`` is a key of the rows. Null, empty and blank texts have equal (empty) sets and
    are linked. An empty table gives no rows; other columns are ignored.
    """
    base = documents(docs, id_col, text_col)
    marked = staged(_marked(base), "marked")
    firsts = [F.first(c).alias(c) for c in ("n", "fp", "tiny")]
    reps = staged(marked.groupBy("fold").agg(F.min("doc_id").alias("first"), *firsts), "reps")
    pairs, members, known, core = _candidates(reps.where("n > 3"))  # smaller sets at 0.8 are equal
    close = _judged(pairs, reps.select("fold", F.col("fp").alias("shingles")), near_prints)

    both = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wanted = staged(both.select(F.col("a").alias("fold")).unionByName(members.select("fold")).distinct(), "wanted")
    wanted = staged(wanted.join(reps.select("fold", F.col("first").alias("doc_id")).hint("merge"), "fold"), "wanted-rows")
    sets = staged(_sets(base.join(wanted.hint("merge"), "doc_id")), "sets")

    ends = both.groupBy("a").agg(F.array_distinct(F.array(F.min("b"), F.max("b"))).alias("b")).select("a", F.explode("b").alias("b"))
    stars = staged(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    links = _judged(stars, sets)
    near = staged(component_labels(links), "star-labels").withColumnRenamed("node", "fold")

    label_a, label_b = (near.select(F.col("fold").alias(c), F.col("label").alias(f"label_{c}")).hint("merge") for c in "ab")
    rest = staged(close.join(stars, ["a", "b"], "left_anti").join(label_a, "a", "left"), "rest-a").join(label_b, "b", "left")
    rest = rest.where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b")

    placed = members.join(near.hint("merge"), "fold", "left")
    placed = staged(placed.select("key", "fold", "n", F.coalesce("label", "fold").alias("label")), "placed")
    crowds = _crowds(placed, core, known)
    apart = crowds.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"))
    apart = staged(apart.where("l < h").select("key"), "apart")
    certain, pairs = _crowd_pairs(staged(crowds.join(apart.hint("merge"), "key"), "left"), sets)
    rest = staged(rest.unionByName(pairs.join(stars, ["a", "b"], "left_anti")).distinct(), "rest")
    found = near.where("fold <> label").select(F.col("fold").alias("a"), F.col("label").alias("b"))
    links = found.unionByName(certain).unionByName(_judged(rest, sets))

    labels = staged(component_labels(links), "labels").withColumnRenamed("node", "fold")
    linked = reps.select("fold", "first").join(labels.hint("merge"), "fold", "left").withColumn("label", F.coalesce("label", "fold"))
    linked = staged(linked, "linked")
    least = staged(linked.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    classes = staged(linked.join(least.hint("merge"), "label").select("fold", "component_id"), "classes")
    return marked.select("doc_id", "fold").join(classes.hint("merge"), "fold").select("doc_id", "component_id")
