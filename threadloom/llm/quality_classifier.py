"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word is a term of its own, hashed into :data:`TERMS` places (so that vectors have a
bounded size at any vocabulary; two words share a place by chance only). A term has a sparse
random index vector. Over the whole corpus the index vectors of each term's neighbours are
added up; that sum, scaled to unit length, next to the term's own index vector is the word
vector. A document's vector is the mean over its words, then the mean of the index vectors of
its words' shapes (case, digits and punctuation, runs collapsed; they say something of words
that were never seen), then a few measures of the document itself (how often it repeats
words, pairs and lines, and lengths). A two-layer network in numpy is fitted on a bounded
sample of labelled documents, and its logits are divided by a temperature found on rows it
was not fitted on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, give_back, map_arrow, partitions

TERMS = 1 << 16  # places for words; the last serves as the gap between texts and belongs to no word
DIMENSIONS = 64  # of an index vector
SLICE = 4096  # word places whose vectors are scaled at a time
NONZERO = 8
REACH = 2  # words to either side that count as neighbours
MEASURES = 6
WIDTH = 3 * DIMENSIONS + MEASURES  # of a document's vector
LABELLED = 20_000  # the most labelled documents that the network is fitted on
HIDDEN = 32
SEED = 11
KNOWN = 1 << 17  # distinct words remembered by a task
STRETCH = 1 << 15  # words whose neighbours are added up at a time
GAP = TERMS - 1

_SHAPE = bytes(
    ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b
    for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Terms(dict):
    """Words to (term, shape's term) in one number, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        self[word] = found = zlib.crc32(word) % GAP << 16 | zlib.crc32(shape, 1) % GAP
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _measures(text: bytes, words: list[bytes]) -> list[float]:
    """What is true of the document as a whole."""
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        1 - len(set(words)) / max(1, n),
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log2(1 + n)),
        float(np.log2(1 + n / max(1, len(lines)))),
        float(np.log2(1 + sum(map(len, words)) / max(1, n))),
    ]


def index_vectors() -> np.ndarray:
    """A fixed sparse vector of +1 and -1 for each term; none for the gap.

    Places are steps of an odd number modulo a power of two, so no two are the same.
    """
    rng = np.random.default_rng(SEED)
    first, step = rng.integers(0, DIMENSIONS, TERMS), 2 * rng.integers(0, DIMENSIONS // 2, TERMS) + 1
    found = np.zeros((TERMS, DIMENSIONS), np.int8)
    for k in range(NONZERO):
        found[np.arange(TERMS), (first + k * step) % DIMENSIONS] = rng.choice((-1, 1), TERMS)
    found[GAP] = 0
    return found


class ContextSums:
    """Sums of neighbours' index vectors per term, of one text after another."""

    def __init__(self) -> None:
        self.index, self.sums = index_vectors(), np.zeros((TERMS, DIMENSIONS), np.int64)
        self.waiting, self.n = [np.full(REACH, GAP)], REACH

    def add(self, terms: np.ndarray) -> None:
        gap = np.full(REACH, GAP)
        for a in range(0, max(1, len(terms)), STRETCH):  # a stretch brings its neighbours along
            part = terms[a : a + STRETCH]
            if len(terms) > STRETCH:
                self.settle()
                near = np.concatenate([gap, terms[max(0, a - REACH) : a], part, terms[a + STRETCH : a + STRETCH + REACH], gap])
                self._sum(near, REACH + min(a, REACH), len(part))
            else:
                self.waiting += [part, gap]
                self.n += len(part) + REACH
        if self.n >= STRETCH:
            self.settle()

    def settle(self) -> None:
        terms = np.concatenate(self.waiting)
        self.waiting, self.n = [np.full(REACH, GAP)], REACH
        self._sum(terms, REACH, len(terms) - 2 * REACH)

    def _sum(self, terms: np.ndarray, first: int, n: int) -> None:
        """Adds up the neighbours of n terms from the first on."""
        if n <= 0:
            return
        vectors = self.index[terms]
        context = np.zeros((n, DIMENSIONS), np.int8)
        for step in range(1, REACH + 1):
            context += vectors[first - step : first - step + n]
            context += vectors[first + step : first + step + n]
        own = terms[first : first + n].astype(np.uint16)
        order = np.argsort(own, kind="stable")
        sorted_terms = own[order]
        starts = np.flatnonzero(np.diff(sorted_terms, prepend=-1))
        self.sums[sorted_terms[starts]] += np.add.reduceat(context[order], starts, axis=0, dtype=np.int32)
        self.sums[GAP] = 0

    def rows(self) -> pa.RecordBatch:
        """The terms that have neighbours, each with its sums as bytes."""
        some = np.flatnonzero(self.sums.any(axis=1))
        return _vectors(some, self.sums[some])


def _vectors(terms: np.ndarray, sums: np.ndarray, kind: str = "<i8") -> pa.RecordBatch:
    return pa.record_batch([pa.array(terms, pa.int32()), pa.array([v.tobytes() for v in sums.astype(kind)], pa.binary())], names=["term", "sums"])


def context_sums(texts: DataFrame) -> np.ndarray:
    """Sums of neighbours' index vectors per term, over all of ``texts`` (column text).

    A task gives one row per term, so tasks are few: two per core. They are added up by term
    on the executors; what comes to the driver is one row per term, whatever the corpus.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, found = _Terms(), ContextSums()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                found.add(terms.of(text.as_py().split()) >> 16)
        found.settle()
        yield found.rows()

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, sums in zip(batch.column("term").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                found[term] = found.get(term, 0) + np.frombuffer(sums, "<i8")
        if found:
            sums = np.stack(list(found.values()))
            yield _vectors(np.array(list(found)), sums, "<i4" if np.abs(sums).max() < 1 << 31 else "<i8")

    few = texts.select("text").coalesce(2 * texts.sparkSession.sparkContext.defaultParallelism)
    parts = map_arrow(few, run, "term int, sums binary").repartition(partitions(texts), "term")
    found = np.zeros((TERMS, DIMENSIONS))
    for batch in map_arrow(parts, total, "term int, sums binary").toArrow().to_batches():  # rows of collect() would take several times this memory
        for term, sums in zip(batch.column("term").to_pylist(), batch.column("sums"), strict=True):
            found[term] = np.frombuffer(sums.as_buffer(), f"<i{len(sums.as_buffer()) // DIMENSIONS}")
    return found


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """The context half of the word vectors; the other half are the index vectors."""
    found = np.empty(sums.shape, np.float32)
    for at in range(0, len(sums), SLICE):
        some = sums[at : at + SLICE]
        norm = np.linalg.norm(some, axis=1, keepdims=True)
        found[at : at + SLICE] = some / np.where(norm == 0, 1, norm)
    return found


def pooled(text: bytes, terms: _Terms, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A document's vector."""
    words = text.split()
    found = np.zeros(WIDTH, np.float32)
    if words:
        both = terms.of(words)
        for part, shift, tables in ((0, 16, (vectors, index)), (2, 0, (index,))):
            some, counts = np.unique(both >> shift & 0xFFFF, return_counts=True)
            share = counts.astype(np.float32) / len(words)
            for i, table in enumerate(tables, part):
                found[i * DIMENSIONS : (i + 1) * DIMENSIONS] = share @ table[some]
    found[3 * DIMENSIONS :] = _measures(text, words)
    return found


@dataclass(frozen=True)
class Model:
    """Context halves of the word vectors, and the network over documents' vectors."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fitted(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, aside: np.ndarray, epochs: int = 60) -> Model:
    """Network by Adam on the rows not set ``aside``; temperature by least log loss on those."""
    rng = np.random.default_rng(SEED)
    fit = ~aside
    d = x.shape[1]
    if not fit.any() or len(set(y[fit])) < 2:  # nothing to tell apart: the share of ones
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        zero = np.zeros
        return Model(vectors, zero(d), np.ones(d), zero((d, HIDDEN)), zero(HIDDEN), zero(HIDDEN), float(np.log(share / (1 - share))))
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z, t = (x[fit] - mean) / scale, y[fit].astype(float)
    p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[rows]) / len(rows)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], e.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if not aside.any():
        return model
    logits, truth = model.logits(x[aside]), y[aside]

    def loss(temperature: float) -> float:
        s = logits / temperature
        return float(np.mean(np.logaddexp(0, s) - truth * s))

    return Model(*[getattr(model, k) for k in list(Model.__dataclass_fields__)[:-1]], min(np.geomspace(0.25, 16, 97), key=loss))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is set aside; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = LABELLED) -> Model:
    """Word vectors from all of ``docs`` and a network from at most ``most`` labelled ones.

    Labels of held-out documents, null labels and null doc_ids are left out; of several
    labels of one doc_id the larger counts, of several texts of one doc_id the one whose
    vector comes first in byte order.
    """
    base = documents(docs)
    vectors = word_vectors(context_sums(base))
    give_back(docs.sparkSession)
    known = labels.select(F.col("doc_id"), F.col(label_col).alias("label")).where(
        ~held_out(F.col("doc_id")) & F.col("label").isNotNull() & F.col("doc_id").isNotNull()
    )
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)  # so it can be broadcast

    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, vectors, index = _Terms(), sent.value, index_vectors()
        for batch in batches:
            x = [pooled(t.as_py(), terms, vectors, index).astype("<f4").tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    labelled = base.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    found = map_arrow(labelled, run, "doc_id bigint, label int, x binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x"))
    rows = found.toArrow().sort_by("doc_id")
    sent.destroy()  # its copy in the driver's JVM; all rows are here
    x = np.array([np.frombuffer(r.as_buffer(), "<f4") for r in rows["x"]], np.float64).reshape(len(rows), WIDTH)
    y = np.array([int(label > 0) for label in rows["label"].to_pylist()], int)
    aside = np.array([zlib.crc32(b"aside%d" % doc_id) % 5 == 0 for doc_id in rows["doc_id"].to_pylist()], bool)
    del rows
    give_back(docs.sparkSession)  # before training, which takes memory in turn
    model = fitted(vectors, x, y, aside)
    del x, y, aside
    give_back(docs.sparkSession)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= 0.5) after all its columns.

    Null and empty texts are scored by their marks alone; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # Of a fixed size; plain arrays, which workers can read without this module.
    sent = spark.sparkContext.broadcast(tuple(getattr(model, k) for k in Model.__dataclass_fields__))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model, index = _Terms(), Model(*sent.value), index_vectors()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            if not batch.num_rows:
                continue
            s = model.scores(np.array([pooled(t.as_py() or b"", terms, model.vectors, index) for t in texts], np.float64))
            columns = [*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score", "predicted"])

    given = docs.withColumn("__text__", F.col(text_col))
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return map_arrow(given, run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. See :func:`train` and
    :func:`scored`; without usable labels every score is 0.5, with one class its share."""
    model = train(docs, labels)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
