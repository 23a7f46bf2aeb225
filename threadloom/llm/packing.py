"""Best-fit packing in bulk-synchronous steps.

Documents become pieces of at most ``capacity`` tokens. Pieces are sorted into ranges of
length and numbered within their length across the cluster. One step per length, longest
first: the sweep finds the successor of the length among the open gaps (the least gap it
fits into), the pieces of that length take the gaps of that size in order of rank, so no
two want the same one, and the gaps shrink; pieces that find no gap open new sequences.

A length is one of at most ``capacity`` numbers, so the state of the sweep is a histogram:
runs of sequences with equal gaps against runs of ranks with equal lengths. It is worked
out on the driver at a size that the capacity bounds, whatever the number of documents;
the pieces themselves never leave the executors and find their run by length and rank.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import documents, map_arrow, partitions, staged

CAPACITY = 2048
END = 0  # id that ends each document
PLAN_ROWS = 1 << 18  # a plan up to this size is broadcast
PER_GROUP = 500  # pieces that are numbered in one group
# Fixed value: the public byte-level pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenIds:
    """Ids of a byte-level BPE tokenizers file.

    The same vocabulary is run by tiktoken, whose ids are equal and cost a third of the
    time; texts with characters that the two libraries' Unicode tables might class
    differently, or that tiktoken refuses, go to the tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.path, self.slow = path, None
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.other = re.compile("[^\\x00-\\u024f\\u2010-\\u205e\\u20a0-\\u20bf]|\\s{10000}")

    def of(self, text: str) -> np.ndarray:
        if self.other.search(text) is None:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, and before them the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the end id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TokenIds(tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(ids_of.of(text.as_py()), END).astype("<u4")
                for i, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return map_arrow(docs, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit plan: (length, first rank, end rank, first sequence, offset) of each run."""
    plan: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: [(first sequence, how many)]
    gaps: list[int] = []  # sizes that have runs, in order
    sequences = 0

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                take = min(n, end - rank)
                if take < n:
                    runs[gap].append((first + take, n - take))
                if not runs[gap]:
                    del runs[gap], gaps[at]
                plan.append((length, rank, rank + take, first, capacity - gap))
                open_gap(gap - length, first, take)
                rank += take
            else:
                each = min(capacity // length, end - rank)
                n = (end - rank) // each
                for i in range(each):
                    plan.append((length, rank + i * n, rank + (i + 1) * n, sequences, i * length))
                open_gap(capacity - each * length, sequences, n)
                sequences += n
                rank += each * n
    return plan


def _ranked(table: DataFrame) -> DataFrame:
    """``table`` with ``rank``: 0, 1, ... among the pieces of equal length.

    Lengths are dealt into groups by hash, so that one that very many pieces share is
    numbered in many places at once; each group starts where the groups before it end.
    """
    total = max(1, table.count())
    grouped = table.withColumn("g", F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 + total // PER_GROUP)))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        grouped.groupBy("length", "g")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "g").orderBy("doc_id", "start", "ids_crc32")
    ranged = grouped.repartitionByRange(partitions(table), "length", "g")
    numbered = ranged.withColumn("within", F.row_number().over(within))
    return numbered.join(staged(starts, "starts"), ["length", "g"]).withColumn(
        "rank", F.col("before") + F.col("within") - 1
    )


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most ``capacity`` tokens, without gaps from offset 0. Only documents
    longer than that are cut; their first piece may be shorter, the others are full.

    Defined cases: null and empty texts are the end id alone. Repeated rows and rows of null
    doc_id are packed each by itself. An empty table gives no rows. Other columns are
    ignored.
    """
    table = staged(pieces(documents(docs, id_col, text_col), tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = sweep(counts, capacity)
    names = ["length", "first_rank", "end_rank", "first_sequence", "offset"]
    schema = StructType([StructField(n, LongType()) for n in names])
    runs = docs.sparkSession.createDataFrame(plan, schema)
    if len(plan) <= PLAN_ROWS:
        runs = F.broadcast(runs)
    placed = _ranked(table).join(runs, "length").where("rank >= first_rank AND rank < end_rank")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )
