"""Substring dedup by difference-cover anchors.

Any two places where the same 13 words stand share an anchor: a 7-word piece that starts,
in both documents, at a word position whose remainder modulo 7 is in the cover {0, 1, 3}.
(Every difference modulo 7 is a difference of two cover elements, so some shift of at most
6 words brings both starts onto the cover, and 6 + 7 words fit into the match.)

1. Hash the 7-word pieces at cover positions only, 3 of 7, and find the hashes that occur in
   more than one document.
2. Documents with shared anchors extend them to the 13-word windows that hold one, and the
   least doc_id of each window is found.
3. Words covered by a window that a smaller doc_id also has are removed.

Hashes meet in buckets as packed arrays, with as many bytes as their number needs: anchors
only propose candidates, so a false meeting in 2**14 does no harm; windows decide, so their
hashes are long enough that none is expected in a corpus a thousand times as large. Each
block of documents first settles its own repeats and sends one entry per hash, so a passage
that a third of the corpus shares brings one entry per block, not one per document, to its
bucket. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, map_arrow, partitions, staged

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
BLOCK = 1 << 21  # entries that a task settles at a time
MOST_BUCKETS = 1 << 20  # at 100 TB of text a bucket then has some 20 million entries
NO_ID = int(np.iinfo(np.int64).max)  # stands for a null doc_id: larger than any other
_MULTIPLIERS = np.random.default_rng(1).integers(0, 1 << 63, (2, WINDOW), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

PACKED = "bucket int, k bigint, ids binary, width int, hashes binary"
HITS = "q int, k bigint, ids binary, width int, hashes binary"


# ---------------------------------------------------------------- hashes of a document


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _rolled(h: np.ndarray, k: int, family: int) -> np.ndarray:
    """Hash of each run of k words from the words' hashes (multilinear, mod 2**64)."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        out += h[j : j + n] * _MULTIPLIERS[family, j]
    return _mixed(out)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of a document and the hashes of the anchors there."""
    n = len(h) - ANCHOR + 1
    at = (np.arange(0, max(n, 0) + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
    at = at[at < n]
    return at, _rolled(h, ANCHOR, 0)[at] if n > 0 else np.zeros(0, np.uint64)


def _runs(h: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Runs (first, end) of starts of the windows that hold an anchor of a shared short hash."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros((0, 2), np.int32)
    at, hashes = _anchors(h)
    marked = np.zeros(len(h) + 1, np.int64)
    marked[at[np.isin(_short(hashes), shared)] + 1] = 1
    sums = np.cumsum(marked)
    starts = np.arange(n)
    held = np.concatenate([[False], sums[starts + PERIOD] > sums[starts], [False]])
    return np.flatnonzero(held[1:] != held[:-1]).reshape(-1, 2).astype(np.int32)


def _short(h: np.ndarray) -> np.ndarray:
    """Four bytes that name an anchor within its document."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


# ---------------------------------------------------------------- blocks and buckets


class _Packing:
    """How entries travel: buckets (a power of two, 256 or more) and bytes of a hash."""

    def __init__(self, buckets: int, width: int, parts: np.ndarray, later: bool) -> None:
        self.buckets, self.width, self.parts, self.later = buckets, width, parts, later

    @property
    def name_type(self) -> type:
        return np.uint64 if self.later else np.uint32

    def named(self, h: np.ndarray) -> np.ndarray:
        """What a document is told of a decided entry."""
        return h if self.later else _short(h)

    def settle(self, h: np.ndarray, low: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the first entry (of least id) of each hash, and of the entries decided.

        Decided are, with ``later``, those of a larger id than the first; else all entries
        of a hash with more than one id.
        """
        order = np.lexsort((ids, low, h)) if self.later else np.lexsort((ids, h))
        sh, si = h[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = sh[1:] != sh[:-1]
        if self.later:
            sl = low[order]
            new[1:] |= sl[1:] != sl[:-1]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least = si[starts]
        if self.later:
            return order[starts], order[si > least[group]]
        return order[starts], order[(np.maximum.reduceat(si, starts) > least)[group]]

    def packed(self, h: np.ndarray, low: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """Entries by bucket; ids as steps, hashes without the byte that the bucket tells."""
        bucket = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        order = np.lexsort((ids, bucket))
        h, low, ids, bucket = h[order], low[order], ids[order], bucket[order]
        octets = np.hstack([h.view(np.uint8).reshape(-1, 8), low.view(np.uint8).reshape(-1, 8)])[:, 1 : 1 + self.width]
        return _batch([(b, *_stepped(ids[i:j]), octets[i:j].tobytes()) for b, i, j in _slices(bucket)])

    def unpacked(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = _ids(row)
        octets = np.zeros((len(ids), 16), np.uint8)
        octets[:, 0] = row["bucket"] & 255
        octets[:, 1 : 1 + self.width] = np.frombuffer(row["hashes"], np.uint8).reshape(-1, self.width)
        both = octets.view(np.uint64)
        return both[:, 0].copy(), both[:, 1].copy(), ids

    def told(self, ids: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
        """Decided entries, each once, as rows (q, first id, steps, width, names) by the
        part q of the documents they belong to."""
        if not len(ids):
            return
        names, q = self.named(h), _part(ids, self.parts)
        order = np.lexsort((names, ids, q))
        ids, names, q = ids[order], names[order], q[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])
        ids, names, q = ids[fresh], names[fresh], q[fresh]
        for part, i, j in _slices(q):
            yield (part, *_stepped(ids[i:j]), names[i:j].tobytes())


def _part(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The key of the part of the documents that an id belongs to."""
    return parts[(_mixed(ids.view(np.uint64)) % np.uint64(len(parts))).astype(np.int64)]


def _keys(docs: DataFrame) -> np.ndarray:
    """One number for each shuffle partition, that Spark's hash deals to that partition: parts
    keyed by them are spread evenly."""
    n = partitions(docs)
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    rows = docs.sparkSession.range(32 * n + 64).groupBy(place.alias("p")).agg(F.min("id").alias("key")).collect()
    return np.array([r["key"] for r in sorted(rows)], np.int64)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, first, end) of each run of equal keys."""
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield int(keys[i]), i, j


def _stepped(ids: np.ndarray) -> tuple[int, bytes, int]:
    """Sorted ids as the first one and the steps between them, in as few bytes as they need."""
    steps = np.diff(ids, prepend=ids[0]).astype(np.uint64)
    most = int(steps.max())
    width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << (8 * w))
    return int(ids[0]), steps.astype(f"<u{width}").tobytes(), width


def _ids(row: dict) -> np.ndarray:
    return np.cumsum(np.frombuffer(row["ids"], f"<u{row['width']}").astype(np.int64)) + row["k"]


def _batch(rows: list[tuple], kinds: str = PACKED) -> pa.RecordBatch:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    columns = [c.split() for c in kinds.split(", ")]
    arrays = [pa.array([r[i] for r in rows], types[kind]) for i, (_, kind) in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in columns])


Entries = Callable[[dict], tuple[np.ndarray, np.ndarray]]


def _met(rows: DataFrame, packing: _Packing, entries: Entries) -> DataFrame:
    """What the documents of ``rows`` are told of their decided entries, by part (HITS)."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, low, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            first, decided = packing.settle(h, low, ids)
            # Rows of decided entries pass the buckets by: theirs are negative.
            yield _batch([(-1 - q, *rest) for q, *rest in packing.told(ids[decided], h[decided])])
            yield packing.packed(h[first], low[first], ids[first])

        size = 0
        for batch in batches:
            for row in _rows(batch):
                h, low = entries(row)
                if len(h):
                    parts.append((h, low, np.full(len(h), row["k"], np.int64)))
                    size += len(h)
                if size >= BLOCK:
                    yield from flush()
                    size = 0
        if parts:
            yield from flush()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        current, size = None, 0

        def close() -> int:
            if not gathered:
                return 0
            h, low, ids = (np.concatenate(x) for x in zip(*gathered, strict=True))
            gathered.clear()
            _, decided = packing.settle(h, low, ids)
            ready.append((ids[decided], h[decided]))
            return len(decided)

        def out() -> Iterator[pa.RecordBatch]:
            if ready:
                ids, h = (np.concatenate(x) for x in zip(*ready, strict=True))
                ready.clear()
                yield _batch(list(packing.told(ids, h)), HITS)

        for batch in batches:
            for row in _rows(batch):
                if row["bucket"] < 0:
                    names = np.frombuffer(row["hashes"], packing.name_type).astype(np.uint64)
                    ready.append((_ids(row), names))
                    size += len(names)
                else:
                    if row["bucket"] != current:
                        size += close()
                        current = row["bucket"]
                    gathered.append(packing.unpacked(row))
                if size > BLOCK:
                    yield from out()
                    size = 0
        close()
        yield from out()

    dealt = map_arrow(rows, pack, PACKED).repartition(partitions(rows), "bucket")
    return map_arrow(dealt.sortWithinPartitions("bucket"), meet, HITS)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield dict(zip(names, values, strict=True))


def _with_hits(
    texts: DataFrame, hits: DataFrame, packing: _Packing, columns: str, judge: Callable[[dict, np.ndarray], tuple]
) -> DataFrame:
    """``judge`` of each row of ``texts`` (q, k, z, ...) and what its k was told.

    Both sides are brought together by part of the documents, the hits first. A part's hits
    fit in memory: there are as many parts as shuffle partitions.
    """
    others = [c for c in texts.columns if c not in ("q", "k")]
    sides = texts.withColumn("text", F.lit(1)).unionByName(hits.withColumn("text", F.lit(0)), allowMissingColumns=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gathered, ids, names = None, [], np.zeros(0, np.int64), np.zeros(0, packing.name_type)
        for batch in batches:
            rows = []
            for row in _rows(batch):
                if row["q"] != current:
                    current, gathered, ids, names = row["q"], [], ids[:0], names[:0]
                if not row["text"]:
                    gathered.append((_ids(row), np.frombuffer(row["hashes"], packing.name_type)))
                    continue
                if gathered:
                    ids, names = (np.concatenate(x) for x in zip(*gathered, strict=True))
                    gathered, order = [], np.argsort(ids, kind="stable")
                    ids, names = ids[order], names[order]
                first, end = np.searchsorted(ids, [row["k"], row["k"] + 1]) if row["k"] < NO_ID else (np.searchsorted(ids, NO_ID), len(ids))
                rows.append(judge(row, names[first:end]))
            yield _batch(rows, columns)

    met = sides.repartition(partitions(texts), "q").sortWithinPartitions("q", "text")
    return map_arrow(met.select("q", "k", "text", "ids", "width", "hashes", *others), run, columns)


# ---------------------------------------------------------------- the operator


def _anchor_entries(row: dict) -> tuple[np.ndarray, np.ndarray]:
    words = row["text"].split()
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = _anchors(_word_hashes(words))[1]
    return h, np.zeros(len(h), np.uint64)


def _window_entries(row: dict) -> tuple[np.ndarray, np.ndarray]:
    h = _word_hashes(_unzipped(row["z"]).split())
    runs = np.frombuffer(row["runs"], np.int32).reshape(-1, 2)
    parts = [h[a : b + WINDOW - 1] for a, b in runs.tolist()]
    return (np.concatenate([_rolled(_mixed(p) if f else p, WINDOW, f) for p in parts]) for f in (0, 1))


def _result(words: list[bytes], gone: np.ndarray | None) -> tuple[int, int, bytes]:
    kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _unzipped(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _sizes(docs: DataFrame) -> tuple[int, int, int]:
    """Buckets of about a million entries, and bytes of anchors' and windows' hashes.

    From the bytes of all texts, counted: a word and the blank after it take two at least, so
    there are never more words than the hashes are made for, whatever the table's files say.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    words = max(total // 2, 1)
    buckets = min(MOST_BUCKETS, max(256, 1 << (words * len(COVER) // PERIOD >> 21).bit_length()))
    bits = words.bit_length()
    return buckets, min(7, -(-(bits + 14 - 8) // 8)), min(15, -(-(2 * bits + 20 + 10 - 8) // 8))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text (null: as it was).

    A word goes if it is covered by 13 consecutive words of its document that also stand
    together in a document of smaller doc_id; all windows are judged on the input.

    Defined cases: null and empty texts have no words. Texts under 13 words lose nothing.
    Rows that repeat a doc_id are never removed for each other's sake, whatever their texts.
    A null doc_id counts as larger than any other. An empty table gives no rows. Other
    columns are ignored.
    """
    parts = _keys(docs)
    base = documents(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.col("text").cast("binary").alias("text")
    )
    buckets, short, long = _sizes(base)
    by_anchor, by_window = _Packing(buckets, short, parts, later=False), _Packing(buckets, long, parts, later=True)
    shared = _met(base, by_anchor, _anchor_entries)

    def zipped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([zip_(t.as_py()) for t in batch.column("text")], pa.binary())
            k = batch.column("k")
            q = pa.array(_part(k.to_numpy(), parts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([q, k, z], names=["q", "k", "z"])

    def suspect(row: dict, found: np.ndarray) -> tuple:
        # Documents without a candidate window are done; the others keep their text.
        words = _unzipped(row["z"]).split()
        runs = _runs(_word_hashes(words), found) if len(found) else ()
        if len(runs):
            return row["q"], row["k"], None, None, row["z"], runs.tobytes()
        n, _, kept = _result(words, None)
        return row["q"], row["k"], n, hashlib.sha256(kept).hexdigest(), None, None

    state = staged(
        _with_hits(
            map_arrow(base, zipped, "q int, k bigint, z binary"),
            shared,
            by_anchor,
            "q int, k bigint, n_words bigint, kept_sha256 string, z binary, runs binary",
            suspect,
        ),
        "suspects",
    )
    suspects = state.where("z IS NOT NULL")
    later = _met(suspects.select("k", "z", "runs"), by_window, _window_entries)

    def finish(row: dict, found: np.ndarray) -> tuple:
        words, gone = _unzipped(row["z"]).split(), None
        if len(found):
            starts = np.flatnonzero(np.isin(_rolled(_word_hashes(words), WINDOW, 0), found))
            edge = np.zeros(len(words) + 1, np.int64)
            edge[starts] += 1
            edge[starts + WINDOW] -= 1
            gone = np.cumsum(edge)[:-1] > 0
        n, removed, kept = _result(words, gone)
        return row["k"], n, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if removed else None

    done = _with_hits(
        suspects.select("q", "k", "z"),
        later,
        by_window,
        "k bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string",
        finish,
    )
    clean = state.where("z IS NULL").select(
        "k", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text")
    )
    doc_id = F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id")
    return done.unionByName(clean).select(doc_id, "n_words", "n_removed", "kept_sha256", "kept_text")
