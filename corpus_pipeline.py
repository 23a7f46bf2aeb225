"""A training-data pipeline over ``documents``: each stage works on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns documents again, with their own columns;
only the last returns the packing instead. The result of each stage is written as Parquet
in the shared folder and reread, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.exact_dedup import block_naming_dedup
from threadloom.llm.mixing import mix_sources
from threadloom.llm.near_copies import similar_components
from threadloom.llm.packing import best_fit_packing
from threadloom.llm.quality_classifier import scored, train
from threadloom.llm.shared import load, staged

#: The key column that stages add for themselves.
ROW = "__row__"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key per row that sorts by doc_id (null last): rows may repeat a doc_id.

    Written and read back: a row's number depends on how Spark splits the files, which can
    change between two scans, so both sides of a join read the key that was written.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.monotonically_increasing_id().alias("at"))
    return staged(docs.withColumn(ROW, key), "keyed")


def _chosen(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with rows by key. The list of rows grows with the corpus, so it is never
    broadcast, however small it is today: the plan is the same at every size."""
    return docs.join(rows.hint("merge"), ROW, how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects (score below 0.5) go."""
    model = train(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return scored(docs, model).where("predicted = 1").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the longest, then that of the smallest doc_id, stays."""
    keyed = _keyed(docs)
    kept = block_naming_dedup(keyed, id_col=ROW).where("kept").select(F.col("doc_id").alias(ROW))
    return _chosen(keyed, staged(kept, "kept"), "left_semi").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup at a 5-word Jaccard similarity of 0.8: of each group of linked documents that
    of the smallest doc_id stays."""
    keyed = _keyed(docs)
    found = similar_components(keyed, id_col=ROW)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(ROW))
    return _chosen(keyed, staged(kept, "kept"), "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document comes as often as its source's budget takes it."""
    keyed = _keyed(docs)
    found = mix_sources(keyed, id_col=ROW, order_col="doc_id").where("copies > 0")
    copies = staged(found.select(F.col("doc_id").alias(ROW), F.col("copies").alias("__copies__")), "copies")
    taken = _chosen(keyed, copies, "inner").withColumn("__copy__", F.explode(F.sequence(F.lit(1), F.col("__copies__"))))
    return taken.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row per piece with its sequence and offset."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near-dedup", near),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: The classifier, the fingerprints and the token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
