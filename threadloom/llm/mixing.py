"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times a source, and times a document
SEED = 17
EXACT = 1 << 16  # words of budget that the knapsack fills


def targets(totals: dict[str | None, int], weights: Sequence[float], share: float, most: float) -> dict[str | None, float]:
    """Words wanted of each source; the excess over ``most`` times its size is shared anew."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, got, open_ = share * sum(totals.values()), {}, order
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * totals[s]]
        if not full:
            return got | {s: unit * weight[s] for s in open_}
        got |= {s: float(most * totals[s]) for s in full}
        left -= sum(got[s] for s in full)
        open_ = [s for s in open_ if s not in got]
    return got


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """How many documents of each size to take so that their words come as near to ``budget``
    from below as the sizes allow.

    Each size gives the same share of its documents, rounded down; the sizes with the
    largest remainders give one more while the budget is beyond ``exact`` words; a
    bounded-knapsack dynamic programme over the documents left fills what remains.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    exactly = counts * min(1.0, budget / total)
    take = np.minimum(np.floor(exactly + 1e-9).astype(np.int64), counts)
    take[sizes == 0] = 0
    left = budget - int((sizes * take).sum())
    for i in np.argsort(take - exactly, kind="stable"):
        if left <= exact:
            break
        if take[i] < counts[i] and 0 < sizes[i] <= left:
            take[i] += 1
            left -= int(sizes[i])
    # Subset sums as the bits of a number: bit b is set if b words can be filled.
    mask, sums, steps = (1 << (left + 1)) - 1, 1, []
    for i in np.argsort(-sizes, kind="stable"):
        spare, many = int(min(counts[i] - take[i], left // sizes[i])) if sizes[i] else 0, 1
        while spare > 0 and not sums >> left & 1:
            n = min(many, spare)
            steps.append((int(i), n, sums))
            sums |= (sums << (n * int(sizes[i]))) & mask
            spare, many = spare - n, 2 * many
    at = sums.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(sizes[i])
    return take


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = SEED,
    order_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    Size is in words. A source whose target exceeds its size is taken whole as often as it
    fits; the remaining budget goes to documents chosen by a seeded hash of doc_id (or of
    ``order_col``), so many
    of each exact size as :func:`fit` says. Equal inputs give equal results.

    One row per source comes to the driver (the sources of a mix are few); the documents of
    a size are counted and chosen where they are, in parts by hash.

    Defined cases: null and empty texts have size 0 and are taken 0 words. A null source is
    one more source, the last. Rows that repeat a doc_id are chosen each by itself; which of
    them is then arbitrary, but not how many. An empty table gives no rows. Other columns
    are ignored.
    """
    sized = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(F.lit(seed), F.col(order_col or id_col)).alias("h"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    )
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    histogram = staged(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sums = histogram.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    totals = {r["key"][1:] if r["key"] else None: int(r["words"]) for r in sums}
    wanted = targets(totals, weights, share, most)

    def planned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")  # rows come in any order; equal runs must choose alike
        key = pdf["key"].iloc[0]
        source = key[1:] if key else None
        words, target = totals[source], wanted[source]
        whole = min(most, math.floor(target / words + 1e-12)) if words else 0
        take = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(target) - whole * words if whole < most else 0)
        return pdf[["key", "size", "n"]].assign(whole=whole, take=take, source_size=words, target=target)

    plan = staged(
        histogram.groupBy("key").applyInPandas(
            planned, "key string, size long, n long, whole long, take long, source_size long, target double"
        ),
        "plan",
    )
    rows = sized.join(plan, ["key", "size"])
    rows = rows.withColumn("part", F.shiftrightunsigned("h", 52))
    sure = rows.where("take = 0 OR take = n").withColumn("extra", F.when(F.col("take") > 0, 1).otherwise(0))

    parts = rows.where("take > 0 AND take < n").groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))), "parts")
    chosen = rows.where("take > 0 AND take < n").join(parts.hint("merge"), ["key", "size", "part"])  # as many as documents
    room = F.col("take") - F.col("before")
    clear = chosen.where((room <= 0) | (room >= F.col("m"))).withColumn("extra", F.when(room > 0, 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h", "doc_id"))
    edge = chosen.where((room > 0) & (room < F.col("m"))).withColumn("place", place)
    edge = edge.withColumn("extra", F.when(F.col("place") <= room, 1).otherwise(0))

    columns = ["doc_id", "size", "source_size", "target", "whole", "extra"]
    found = sure.select(columns).unionByName(clear.select(columns)).unionByName(edge.select(columns))
    copies = (F.col("whole") + F.col("extra")).cast("int")
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")
    )
