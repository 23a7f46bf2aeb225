"""Token counts: pieces are counted once per distinct pre-token, never as ids per document.

Documents are cut into blocks. Each block becomes an inverted list: a pre-token, and for
every document that has it its place in the block and how often. The lists meet by
pre-token; there each distinct pre-token is split into pieces once, its piece count is
joined to all lists of that pre-token, and only sums per document go on. A pre-token that
very many documents of a block have is met by pre-token and block instead, so that no task
gets a common word's lists of the whole corpus; there it is split once per task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, map_arrow, partitions

#: Characters below this bound are in normal form C already and split alike in every
#: Unicode version; texts with others go through the library's own normaliser and splitter.
PLAIN = 0x250
BLOCK_BYTES = 32 << 20
HOT = 1024  # a list of more documents than this goes its own way, by pre-token and block
LISTS = "pretoken binary, block bigint, salt bigint, docs binary, counts binary"


class PreTokens:
    """Pre-tokens of a tokenizers file whose pre-tokenizer is a normaliser and a Split pattern."""

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        odd = [t for t in spec["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd or steps != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or spec["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE with a normaliser of NFC, Replace, Lowercase, one Split pattern and plain added tokens is expected")
        # Byte-level models spell a byte as itself if it prints, else as a letter from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.byte_names = [chr(b) if b in printable else chr(next(others)) for b in range(256)]
        self.byte_of = {name: b for b, name in enumerate(self.byte_names)}
        self.special = re.compile("|".join(sorted((re.escape(t["content"]) for t in spec["added_tokens"]), key=len, reverse=True)) or r"(?!)")
        self.other = re.compile(f"[^\\x00-\\u{PLAIN - 1:04x}]")
        self.plain_text = re.compile(self._spelled(splits[0]["pattern"]["Regex"]))

    @staticmethod
    def _spelled(pattern: str) -> str:
        """The pattern with its Unicode classes spelled out for the plain characters."""
        kinds = {"\\p{L}": "L", "\\p{N}": "N"}
        for name, kind in kinds.items():
            members = "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind)
            pattern = pattern.replace(name, members)
        space = "".join(f"\\x{c:02x}" for c in range(PLAIN) if c in (*range(9, 14), 0x20, 0x85, 0xA0))
        return pattern.replace("\\s", space)

    def of(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many strings of added tokens stand between them.

        The library takes added tokens out of the raw text first and normalises each part
        between them by itself.
        """
        parts = self.special.split(text)
        if len(parts) == 1:
            return self._pretokens(text), 0
        return [t for part in parts for t in self._pretokens(part)], len(parts) - 1

    def _pretokens(self, text: str) -> list[str]:
        # A plain letter can have a lower case that is not plain, so both are looked at.
        low = text.lower()
        if low.isascii() or (self.other.search(text) is None and self.other.search(low) is None):
            return self.plain_text.findall(low)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, t)).decode() for t, _ in split]

    def pieces(self, pretokens: list[bytes]) -> list[int]:
        """How many pieces the model makes of each pre-token, given as its bytes."""
        split, spelled = self.tokenizer.model.tokenize, self.byte_names.__getitem__
        return [len(split("".join(map(spelled, p)))) for p in pretokens]


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The counts are those of the tokenizers library without begin, end or padding tokens; an
    added token's string inside a text counts as the library takes it, one token, and the
    parts around it are counted as texts of their own.

    Defined cases: null and empty texts have no bytes and no tokens. Repeated rows and rows
    of null doc_id are counted each by itself. An empty table gives no rows. Other columns
    are ignored.
    """
    base = documents(docs, id_col, text_col)

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = PreTokens(tokenizer_path)
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 33
        block = _Block(first)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found, added = split.of(text)
                block.add(doc_id, len(text.encode()), added, found)
                if block.size >= BLOCK_BYTES:
                    yield from block.flush()
                    block = _Block(block.first + block.docs)
        yield from block.flush()

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = PreTokens(tokenizer_path)
        counted: dict[bytes, int] = {}
        for batch in batches:
            keys = batch.column("pretoken").to_pylist()
            new = list({k for k in keys if k is not None} - counted.keys())
            if len(counted) > 1 << 16:  # rows come sorted: an older pre-token does not come back
                counted.clear()
                new = list({k for k in keys if k is not None})
            counted.update(zip(new, split.pieces(new), strict=True))
            yield from _summed(batch, keys, counted)

    inverted = map_arrow(base, lists, LISTS)
    met = inverted.repartition(partitions(docs), "pretoken", "salt")
    added = map_arrow(met.sortWithinPartitions("pretoken"), sums, "rid bigint, doc_id bigint, n_bytes bigint, n_tokens bigint")
    total = added.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")
    )
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


class _Block:
    """The inverted lists of some documents; row number = first + place in the block."""

    def __init__(self, first: int) -> None:
        self.first, self.docs, self.size = first, 0, 0
        self.heads: list[tuple[int | None, int, int]] = []
        self.known: dict[str, int] = {}
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, doc_id: int | None, n_bytes: int, n_tokens: int, pretokens: list[str]) -> None:
        self.heads.append((doc_id, n_bytes, n_tokens))
        counts = Counter(pretokens)
        known = self.known
        self.terms.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int64, len(counts)))
        self.times.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.docs += 1
        self.size += n_bytes + 64

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        # The documents themselves: one list without a pre-token.
        ids = pa.array([h[0] for h in self.heads], pa.int64())
        heads = pa.record_batch([ids, *(pa.array([h[i] for h in self.heads], pa.int64()) for i in (1, 2))], names=["d", "b", "t"])
        yield _lists([None], self.first, [self.first], [_framed(heads)], [b""])
        terms = np.concatenate(self.terms)
        times = np.concatenate(self.times)
        places = np.repeat(np.arange(self.docs), [len(t) for t in self.terms])
        order = np.argsort(terms, kind="stable")
        terms, times, places = terms[order], times[order], places[order]
        cuts = np.searchsorted(terms, np.arange(len(self.known) + 1))
        # Steps between places; 0 stands for the first, kept as its own place in four bytes.
        names = list(self.known)
        steps = np.diff(places, prepend=0)
        small, many = np.minimum(times, 255).astype(np.uint8), times.astype("<u4")
        large_run = np.maximum.reduceat(times, cuts[:-1]) > 255 if len(names) else []
        for a in range(0, len(names), 50_000):
            chunk = range(a, min(a + 50_000, len(names)))
            docs, counts, salts = [], [], []
            for i in chunk:
                s, e = cuts[i], cuts[i + 1]
                salts.append(1 + self.first if e - s > HOT else 0)
                step = steps[s:e].copy()
                step[0] = 0
                wide = step.max() > 255
                docs.append(int(places[s]).to_bytes(4, "little") + (b"\1" + step.astype("<u4").tobytes() if wide else b"\0" + step.astype(np.uint8).tobytes()))
                counts.append(b"\1" + many[s:e].tobytes() if large_run[i] else b"\0" + small[s:e].tobytes())
            yield _lists([names[i].encode() for i in chunk], self.first, salts, docs, counts)


def _framed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _lists(pretokens: list, block: int, salts: list[int], docs: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(pretokens, pa.binary()),
            pa.array([block] * len(pretokens), pa.int64()),
            pa.array(salts, pa.int64()),
            pa.array(docs, pa.binary()),
            pa.array(counts, pa.binary()),
        ],
        names=["pretoken", "block", "salt", "docs", "counts"],
    )


def _summed(batch: pa.RecordBatch, keys: list[bytes | None], counted: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Sums per document of the lists in a batch; documents' own lists as they are.

    Most lists are short, so all narrow ones are decoded in one go.
    """
    rids, tokens, narrow = [], [], []
    columns = (batch.column(c).to_pylist() for c in ("block", "docs", "counts"))
    for key, block, docs, counts in zip(keys, *columns, strict=True):
        if key is None:
            heads = pa.ipc.open_stream(docs).read_all().combine_chunks().to_batches()[0]
            yield _sums(pa.array(np.arange(heads.num_rows) + block), *heads.columns)
        elif docs[4] or counts[0]:
            step = np.frombuffer(docs, "<u4" if docs[4] else np.uint8, offset=5)
            times = np.frombuffer(counts, "<u4" if counts[0] else np.uint8, offset=1)
            rids.append(np.cumsum(step, dtype=np.int64) + (block + int.from_bytes(docs[:4], "little")))
            tokens.append(times.astype(np.int64) * counted[key])
        else:
            narrow.append((block, docs, counts, counted[key]))
    if narrow:
        blocks, docs, counts, pieces = zip(*narrow, strict=True)
        sizes = np.fromiter(map(len, counts), np.int64, len(counts)) - 1
        starts = np.cumsum(sizes) - sizes
        first = np.frombuffer(b"".join([d[:4] for d in docs]), "<u4").astype(np.int64) + np.array(blocks, np.int64)
        # A list's first step is 0, so its places are running sums less the sum at its start.
        sums = np.cumsum(np.frombuffer(b"".join([d[5:] for d in docs]), np.uint8), dtype=np.int64)
        rids.append(sums + np.repeat(first - sums[starts], sizes))
        times = np.frombuffer(b"".join([c[1:] for c in counts]), np.uint8).astype(np.int64)
        tokens.append(times * np.repeat(np.array(pieces, np.int64), sizes))
    if rids:
        rid, place = np.unique(np.concatenate(rids), return_inverse=True)
        n = np.bincount(place, np.concatenate(tokens)).astype(np.int64)
        empty = pa.nulls(len(rid), pa.int64())
        yield _sums(pa.array(rid), empty, empty, pa.array(n))


def _sums(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["rid", "doc_id", "n_bytes", "n_tokens"])
