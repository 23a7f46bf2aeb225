"""Exact dedup by deterministic block naming (DataFrame functions only).

The normalised text is cut into fixed-size blocks. Sorting the distinct blocks gives
each an integer name; then adjacent names of a document are paired, the distinct pairs
are sorted and named in turn, and so on until one name is left per document. Two
documents of the same number of blocks have the same last name exactly when their
texts are equal: names stand for contents, never for hashes, so there are no collisions.

Only blocks (and pairs) that occur more than once need a shared name: a document with a block
that occurs nowhere else equals no other document, so it leaves the recursion there with an
identity from its own row number, which is as collision-free. So the whole text is shuffled twice, once to find the repeated blocks and once to join their
names back; all later levels move integers, and only of documents that may be copies.
A block that a large part of the corpus shares is counted with map-side partial sums, and
its name is joined by a join of two plain tables, which AQE can split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, documents, partitions, staged

BLOCK = 4096  # code points per block


def _named(keys: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Integer names for distinct keys: their place after a sort.

    The sort goes by hash first: the ranges come out even, and their bounds, which Spark
    samples on the driver, are numbers instead of whole blocks.
    """
    keys = staged(keys.withColumn("h", F.xxhash64(*columns)), f"{label}-keys")
    ranged = keys.repartitionByRange(partitions(keys), "h").sortWithinPartitions("h", *columns)
    return staged(ranged.drop("h").withColumn("name", F.monotonically_increasing_id()), f"{label}-names")


def _repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*columns)


def block_naming_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, identity.

    Every document has one ``identity``: equal texts share it, different ones never do. Where
    all blocks are repeated it is the last name (of that number of blocks, so the number is
    part of it); a document with a block, or pair of names, of its own is named there and then
    by its row, since nothing can equal it.

    Texts are equal when identical after deleting all of ``[\\x20\\x09-\\x0D]``. The row of
    most code points in the original text stays, then that of the smallest doc_id.

    Defined cases: null text is empty, and all empty texts are equal. A null doc_id is an
    ordinary row and comes last in ties. Of rows that repeat the same doc_id and length
    exactly one is kept. An empty table gives no rows. Other columns are ignored.
    """
    rows = documents(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    rows = rows.select(
        "rid", "doc_id", F.length("text").alias("n_chars"), F.regexp_replace("text", f"[{SPACE}]+", "").alias("norm")
    )
    pieces = F.when(F.length("norm") == 0, F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    )

    level0 = _named(_repeated(rows.select(F.explode(pieces).alias("block")), ["block"]), ["block"], "blocks")
    occurrences = rows.select(
        "rid",
        "doc_id",
        "n_chars",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        pieces.alias("pieces"),
    ).select("rid", "doc_id", "n_chars", "sha", F.size("pieces").alias("width0"), F.posexplode("pieces").alias("pos", "block"))
    named = staged(occurrences.join(level0, "block", "left").drop("block"), "named")

    identity = _identities(named)
    members = staged(
        named.where("pos = 0").drop("pos", "name", "width0").join(identity, "rid", "left"), "members"
    )
    alone = members.where("name IS NULL").withColumns(
        {"keep": F.col("rid"), "keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}
    )
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    groups = staged(
        members.where("name IS NOT NULL")
        .groupBy("width0", "name")
        .agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("width0", "name", F.col("best.rid").alias("keep"), F.col("best.doc_id").alias("keep_id"), "group_size"),
        "groups",
    )
    grouped = members.where("name IS NOT NULL").join(groups, ["width0", "name"])
    columns: list[Column | str] = [
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.when(F.col("name").isNull(), F.concat(F.lit("r"), "rid")).otherwise(F.concat(F.lit("n"), "width0", F.lit("."), "name")).alias("identity"),
    ]
    return grouped.select(*columns).unionByName(alone.select(*columns))


def _identities(named: DataFrame) -> DataFrame:
    """(rid, width0, name) of the rows all of whose blocks, pairs, ... are repeated."""
    most = named.agg(F.max("width0")).first()[0] or 1
    current = named.where("width0 > 1 AND name IS NOT NULL").select(
        "rid", "width0", F.col("width0").alias("width"), "pos", "name"
    )
    done = named.where("width0 = 1 AND name IS NOT NULL").select("rid", "width0", "name")
    for level in range(1, math.ceil(math.log2(most)) + 1):
        pairs = staged(
            current.groupBy("rid", "width0", "width", F.expr("pos div 2").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
            # Both halves are there, or the right one lies beyond the document's end.
            .where("a IS NOT NULL AND (b >= 0 OR 2 * pos + 1 >= width)")
            .withColumn("width", F.expr("(width + 1) div 2")),
            f"pairs{level}",
        )
        names = _named(_repeated(pairs, ["a", "b"]), ["a", "b"], f"level{level}")
        current = staged(pairs.join(names, ["a", "b"]).drop("a", "b"), f"current{level}")
        done = done.unionByName(current.where("width = 1").select("rid", "width0", "name"))
        current = current.where("width > 1")
    return done
