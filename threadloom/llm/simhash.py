"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Two fingerprints that differ in at most ``k`` bits agree in all but at most ``k`` of ``b``
blocks, so they share at least one key made of ``b - k`` whole blocks. Equal fingerprints
are first folded into one representative, so copies cost nothing here. Representatives are
grouped by key; a key that few of them share is joined with itself and the pairs are
verified. In a key that many share (one cluster of near copies) pairs would grow with the
square of its size, so there each representative probes for the at most
``C(64, 1) + C(64, 2)`` fingerprints around it instead: still every link, at a cost in
proportion to the number of representatives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import component_labels
from .shared import documents, map_arrow, staged

SEED = 42
CHUNK = 1 << 22  # bytes of text hashed at a time


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words, a bounded piece of the text at a time.

    ``bytes`` knows just the ASCII rules wanted here: lower() maps A-Z and split() cuts
    at ``[\\x20\\x09-\\x0D]``.
    """
    at = 0
    while len(text) - at > CHUNK:
        piece = text[at : at + CHUNK]
        cut = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= 0:  # a word longer than a piece: the rest is taken at once
            break
        yield piece[:cut].lower().split()
        at += cut
    yield text[at:].lower().split()


def bit_counts(text: bytes, k: int = 3, seed: int = SEED) -> tuple[np.ndarray, int]:
    """How many shingle hashes set each bit (in the order of packed bytes), and of how many."""
    counts, n, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    seen = 0
    for piece in _words(text):
        seen += len(piece)
        words = carry + piece
        if len(words) >= k:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
            hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(words) - k + 1)
            counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            n += len(hashes)
        carry = words[-(k - 1) :] if k > 1 else []
    if 0 < seen < k:
        hashes = np.array([digest(b" ".join(carry), seed)], np.uint64)
        counts, n = np.unpackbits(hashes.view(np.uint8)).astype(np.int64), 1
    return counts, n


def fingerprint(text: bytes, k: int = 3, seed: int = SEED) -> int:
    """Signed 64-bit SimHash; zero for a text without words."""
    counts, n = bit_counts(text, k, seed)
    return int(np.packbits(2 * counts > n).view(np.int64)[0]) if n else 0


def fingerprints(docs: DataFrame, k: int = 3, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, ...) without text, with ``fp``; everything else passes through."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = pa.array([fingerprint(t.as_py(), k, seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), fps], names=[*others, "fp"])

    schema = docs.drop("text").withColumn("fp", F.lit(0).cast("long")).schema
    return map_arrow(docs, run, schema)


def _key_masks(blocks: int, distance: int) -> list[int]:
    """Masks that keep all but ``distance`` of ``blocks`` blocks, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(kept) for kept in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _flips(distance: int) -> list[int]:
    """Every non-zero pattern of at most ``distance`` bits, as signed 64-bit numbers."""
    found = [sum(1 << i for i in bits) for d in range(1, distance + 1) for bits in combinations(range(64), d)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def close_pairs(reps: DataFrame, distance: int = 2, blocks: int | None = None, crowd: int = 256) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct ``fp`` in ``reps`` at ``distance`` bits or fewer.

    ``blocks`` defaults to the least number whose keys have some bits more than the count
    of fingerprints needs, so that keys stay thinly populated at any size. Beyond ``crowd``
    members of one key its members probe for their neighbours instead of being paired.
    """
    if blocks is None:
        need = max(1, reps.count()).bit_length() + 4
        blocks = next((b for b in range(distance + 2, 17) if 64 * (b - distance) // b >= need), 16)
    masks = _key_masks(blocks, distance)
    keyed = staged(
        reps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("which", "key")),
        "keyed",
    )
    sizes = keyed.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(sizes, "shared-keys")
    member = staged(keyed.join(shared, ["which", "key"]), "members")
    few = member.where(F.col("n") <= crowd).drop("n")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), ["which", "key"])
        .where(F.col("a") < F.col("b"))
        .where(near)
        .select("a", "b")
    )
    crowded = member.where(F.col("n") > crowd).select("fp").distinct()
    probes = crowded.select(
        F.col("fp").alias("a"),
        F.explode(F.transform(F.array(*map(F.lit, _flips(distance))), lambda m: F.col("fp").bitwiseXOR(m))).alias("b"),
    ).where("a < b")
    found = probes.join(reps.select(F.col("fp").alias("b")), "b").select("a", "b")
    return pairs.unionByName(found).distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, distance: int = 2
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked where their fingerprints differ in at most ``distance`` bits, and
    ``component_id`` is the least doc_id reachable over links, its own included.

    Defined cases: null, empty and blank texts have fingerprint zero and are linked like any
    other. A text of fewer than ``k`` words is one shingle. Repeated rows get a row each. A
    null doc_id counts for links but is never a component_id unless all of its component's
    are null (then that is null). An empty table gives no rows; other columns are ignored.
    """
    marked = staged(fingerprints(documents(docs, id_col, text_col), k), "fingerprints")
    reps = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "representatives")
    labels = staged(component_labels(close_pairs(reps, distance)), "labels")
    linked = staged(
        labels.withColumnRenamed("node", "fp").join(reps, "fp"), "linked"
    )
    least = staged(linked.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    of_linked = linked.join(least, "label").select("fp", "component_id")
    of_rest = reps.join(labels.select(F.col("node").alias("fp")), "fp", "left_anti").select(
        "fp", F.col("first").alias("component_id")
    )
    classes = staged(of_linked.unionByName(of_rest), "classes")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
