"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _least(edges: DataFrame, label: str) -> DataFrame:
    """The least neighbour (or itself) of each node ``n`` with neighbours ``m``.

    Staged, so that its join with the links is one of two plain tables: AQE can then split
    the links of a node that has very many.
    """
    return staged(edges.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low")), label)


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b): the least node it can reach.

    No group, component or link table is gathered anywhere; each step is an aggregate with
    map-side minima and a join. Links to oneself, null ends and repeats are ignored. An
    empty table gives no rows.
    """
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while not _is_forest(edges):
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(
            edges.select(F.col("b").alias("n"), F.col("a").alias("m"))
        )
        large = staged(
            both.join(_least(both, "large-least"), "n")
            .where("m > n")
            .select(F.col("m").alias("a"), F.col("low").alias("b"))
            .distinct(),
            "large",
        )
        down = large.select(F.col("a").alias("n"), F.col("b").alias("m"))
        low = _least(down, "small-least")
        edges = staged(
            down.join(low, "n")
            .where("m <> low")
            .select(F.col("m").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select(F.col("n").alias("a"), F.col("low").alias("b")))
            .distinct(),
            "small",
        )
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("label"))
    )


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one parent and every parent is a root."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per_node = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()
