"""Context graph: node and edge upserts, postings, ranked recall.

Only edges of one hop are followed, so nodes, edges and postings are plain tables; the
postings are the inverted index, built once and joined with a query's terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.numbers import clamp, half_up
from threadloom.functions.text import graph_key, stable_id

# Fixed values.
CANDIDATES, SEEDS, MOST_RESULTS = 80, 12, 10
MOST_FACTS, SESSION_NODES = 2000, 256
RECENCY_DAYS = 90
KIND_BOOST = {
    "decision": 0.1, "constraint": 0.1, "error": 0.1, "loop": 0.1, "warning": 0.1, "procedure": 0.08, "critical": 0.08, "goal": 0.08,
}
OTHER_BOOST = 0.03
WEIGHTS = {"title": 3.0, "content": 1.0, "kind": 0.5}
K1, B = 1.2, 0.75
STRUCTURAL = ("project", "session")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """K8: new rows win by node_id; ``updated_at`` moves only where something changed."""
    changed = ~(
        F.col("o.title").eqNullSafe(F.col("n.title")) & F.col("o.content").eqNullSafe(F.col("n.content")) & F.col("o.status").eqNullSafe(F.col("n.status"))
    )
    met = old.alias("o").join(new.alias("n"), F.col("o.node_id") == F.col("n.node_id"), "full")
    fresh = F.col("n.node_id").isNotNull()

    def pick(name: str) -> Column:
        return F.when(fresh, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    stamp = F.when(~fresh, F.col("o.updated_at")).when(F.col("o.node_id").isNull() | changed, F.col("n.updated_at")).otherwise(F.col("o.updated_at"))
    columns = [c for c in old.columns if c != "updated_at"]
    return met.select(*[pick(c) for c in columns], stamp.alias("updated_at"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """K9: one edge per (from_id, to_id, relation); the new weight wins."""
    sides = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    return sides.groupBy("from_id", "to_id", "relation").agg(F.max_by("weight", "side").alias("weight"))


def postings(nodes: DataFrame) -> DataFrame:
    """(term, node_id, column, tf) of active nodes that are not structural."""
    shown = nodes.where((F.col("status") == "active") & ~F.col("kind").isin(*STRUCTURAL))
    columns = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in WEIGHTS])).alias("c")
    words = shown.select("node_id", columns).select(
        "node_id", F.col("c.column").alias("column"), F.explode(F.regexp_extract_all(F.lower("c.text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term")
    )
    return words.groupBy("term", "node_id", "column").agg(F.count(F.lit(1)).alias("tf"))


def matches(index: DataFrame, terms: list[str]) -> DataFrame:
    """J9, G-9: nodes that hold a word starting with a term, with their BM25 score.

    A term's frequency in a node weighs its columns; length and document frequency are over
    the whole index. The terms of a query are few (a list), so they are a filter, not a join.
    """
    weight = F.lit(0.0)
    for column, w in WEIGHTS.items():
        weight = F.when(F.col("column") == column, F.lit(w)).otherwise(weight)
    whole = index.groupBy("node_id").agg(F.sum("tf").alias("length"))
    stats = whole.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    starts = F.explode(F.array(*[F.when(F.col("term").startswith(t), F.lit(t)) for t in terms])).alias("query")
    hits = index.select("*", starts).where("query IS NOT NULL")
    per_node = hits.groupBy("query", "node_id").agg(F.sum(F.col("tf") * weight).alias("f"))
    df = per_node.groupBy("query").agg(F.count(F.lit(1)).alias("df"))  # one row per term of the query
    met = per_node.join(F.broadcast(df), "query").join(whole, "node_id").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return met.groupBy("node_id").agg(F.sum(score).alias("bm25"))


def lexical_candidates(index: DataFrame, nodes: DataFrame, terms: list[str], most: int = CANDIDATES) -> DataFrame:
    """The best ``most`` nodes with their rank turned into a score; a bounded result."""
    best = matches(index, terms).orderBy(F.desc("bm25"), "node_id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("bm25"), "node_id")) - 1  # over at most `most` rows
    ranked = best.withColumn("place", place)
    count = ranked.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("m"))
    return ranked.crossJoin(count).select("node_id", "place", (1 - F.col("place") / F.col("m")).alias("lexical")).join(nodes.select("node_id"), "node_id", "left_semi")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes one hop from the seeds, in either direction, with the largest weight.

    ``seeds`` is bounded (a dozen of a query's best nodes), so it is sent to the edges.
    """
    few = F.broadcast(seeds.select(F.col("node_id").alias("seed")))
    out = edges.join(few, F.col("from_id") == F.col("seed")).select(F.col("to_id").alias("node_id"), "weight")
    back = edges.join(few, F.col("to_id") == F.col("seed")).select(F.col("from_id").alias("node_id"), "weight")
    return out.unionByName(back).groupBy("node_id").agg(F.max("weight").alias("graph"))


def recall(nodes: DataFrame, edges: DataFrame, index: DataFrame, terms: list[str], now: Column, session: int | None = None, kinds: tuple[str, ...] = (), limit: int = 5) -> DataFrame:
    """Lexical seeds and their neighbours, scored by rank, graph, scope, kind and age.

    Of nodes with equal kind and fact key the best stays; at most ten results.
    """
    lexical = lexical_candidates(index, nodes, terms)
    near = neighbours(edges, lexical.where(F.col("place") < SEEDS))
    found = lexical.select("node_id", "lexical").join(near, "node_id", "full")
    rows = nodes.where((F.col("status") == "active") & ~F.col("kind").isin(*STRUCTURAL)).join(found, "node_id")
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    boost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KIND_BOOST.items() for x in pair]), F.col("kind")), F.lit(OTHER_BOOST))
    recency = F.greatest(F.lit(0.0), 1 - F.datediff(now, F.col("updated_at")) / RECENCY_DAYS)
    scope = F.when(F.col("session_id").eqNullSafe(F.lit(session)), 0.05).otherwise(0.0) if session is not None else F.lit(0.0)
    manual = F.when(F.col("source") == "manual", 0.04).otherwise(0.0)
    score = (
        F.lit(0.05) + F.coalesce("lexical", F.lit(0.0)) * 0.3 + F.coalesce("graph", F.lit(0.0)) * 0.15 + scope + boost
        + clamp(F.col("confidence"), 0.0, 1.0) * 0.08 + recency * 0.05 + manual
    )
    scored = rows.withColumn("score", F.least(F.lit(1.0), score))
    once = Window.partitionBy("kind", graph_key(F.col("title"))).orderBy(F.desc("score"), F.desc("updated_at"), "node_id")
    distinct = scored.withColumn("n", F.row_number().over(once)).where("n = 1")
    best = distinct.orderBy(F.desc("score"), F.desc("updated_at"), "node_id").limit(max(1, min(MOST_RESULTS, limit)))
    return best.select("node_id", "kind", "title", half_up(F.col("score"), 3).alias("score"))


def active_facts(new: DataFrame, latest: DataFrame) -> DataFrame:
    """G-2, G-6: facts to add: those unlike the latest active version of their key."""
    same = ["session_id", "kind", "key"]
    active = latest.where("status = 'active'").select(*same, F.col("content").alias("old"))
    met = new.join(active, same, "left")
    return met.where(~F.col("old").eqNullSafe(F.col("content"))).drop("old")


def saved_memories(memories: DataFrame, most_paths: int = 20, most: int = 500) -> DataFrame:
    """G-7: manual memories once per project, kind and key, their paths united; the newest stay."""
    united = memories.groupBy("project_id", "kind", graph_key(F.col("text")).alias("key")).agg(
        F.max_by("text", "updated_at").alias("text"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))), 1, most_paths).alias("paths"),
        F.max("updated_at").alias("updated_at"),
    )
    back = Window.partitionBy("project_id").orderBy(F.desc("updated_at"), "kind", "key")
    return united.withColumn("n", F.row_number().over(back)).where(F.col("n") <= most).drop("n")


def evicted(nodes: DataFrame, most: int = MOST_FACTS, sessions: int = SESSION_NODES) -> DataFrame:
    """Nodes beyond the bound of their project, inactive and old ones first; never manual."""
    fact = ~F.col("kind").isin(*STRUCTURAL)
    back = Window.partitionBy("project_id", fact).orderBy(F.desc(F.col("status") == "active"), F.desc("updated_at"), F.desc("node_id"))
    own = nodes.where((F.col("source") != "manual") & (fact | (F.col("kind") == "session")))
    over = own.withColumn("n", F.row_number().over(back)).where(F.col("n") > F.when(fact, most).otherwise(sessions))
    return over.select("project_id", "node_id")


def graph_stats(nodes: DataFrame) -> DataFrame:
    """A20."""
    return nodes.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count(F.when(F.col("status") == "active", 1)).alias("active"),
        F.count_distinct(F.when(F.col("kind") == "session", F.col("session_id"))).alias("sessions"),
        F.max("updated_at").alias("updated_at"),
    )


# ---------------------------------------------------------------- a state as nodes and edges

# Confidence by kind of fact, and weights of reference edges.
CONFIDENCE = {"goal": 0.98, "error": 0.95, "loop": 0.95, "critical": 0.95, "topic": 0.75, "file": 1.0}
EXPLICIT, IMPLICIT, OTHER_CONFIDENCE = 0.98, 0.82, 0.85
REFERENCE = {"loop": 0.9, "manual": 0.95}
FACT_REFERENCE = 0.85
TITLE_CHARS, CONTENT_CHARS, NODE_PATHS = 200, 2000, 20


def fact_nodes(facts: DataFrame) -> DataFrame:
    """G-1, G-5: facts (project_id, session_id, branch_id, kind, text, status, explicit, paths,
    updated_at) as nodes: cut, keyed, with the confidence of their kind."""
    confidence = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), F.col("kind")), F.lit(OTHER_CONFIDENCE))
    decided = F.when(F.col("kind") == "decision", F.when(F.col("explicit"), F.lit(EXPLICIT)).otherwise(F.lit(IMPLICIT))).otherwise(confidence)
    key = graph_key(F.col("text"))
    parts = [F.col(c).cast("string") for c in ("project_id", "session_id", "kind")]
    return facts.select(
        stable_id(*parts, key, F.coalesce(F.col("branch_id").cast("string"), F.lit(""))).alias("node_id"),
        "project_id", "session_id", "branch_id", "kind", key.alias("fact_key"),
        F.substring("text", 1, TITLE_CHARS).alias("title"), F.substring("text", 1, CONTENT_CHARS).alias("content"),
        "status", F.lit("compaction").alias("source"), decided.alias("confidence"),
        F.slice(F.array_distinct("paths"), 1, NODE_PATHS).alias("paths"), "updated_at",
    )


def file_nodes(nodes: DataFrame) -> DataFrame:
    """G-4: one node per project and path that facts refer to."""
    paths = nodes.select("project_id", F.explode("paths").alias("path"), "updated_at").groupBy("project_id", "path").agg(F.max("updated_at").alias("updated_at"))
    return paths.select(
        stable_id(F.col("project_id").cast("string"), F.lit("file"), F.lower("path")).alias("node_id"), "project_id", F.lit("file").alias("kind"),
        F.lower("path").alias("fact_key"), F.col("path").alias("title"), F.lit(CONFIDENCE["file"]).alias("confidence"), "updated_at",
    )


def reference_edges(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """G-1, G-2: edges from facts to the files they refer to."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in REFERENCE.items() for x in pair]), F.col("kind")), F.lit(FACT_REFERENCE))
    told = nodes.select("project_id", F.col("node_id").alias("from_id"), F.explode("paths").alias("path"), weight.alias("weight"))
    to = files.select("project_id", F.col("fact_key").alias("low"), F.col("node_id").alias("to_id"))
    met = told.withColumn("low", F.lower("path")).join(to, ["project_id", "low"])
    return met.groupBy("from_id", "to_id").agg(F.max("weight").alias("weight")).withColumn("relation", F.lit("references"))


def tombstones(facts: DataFrame, latest: DataFrame, status: str) -> DataFrame:
    """G-3: branch-local rows that retire facts whose latest version is not yet so; ancestors
    stay as they are."""
    now = latest.where(F.col("status") != status).select("session_id", "kind", "key")
    return facts.join(now, ["session_id", "kind", "key"], "left_semi").select("session_id", "branch_id", "kind", "key", F.lit(status).alias("status"))


def closed_memories(nodes: DataFrame, kind: str, key: str, status: str = "resolved") -> DataFrame:
    """G-8: manual memories of a kind and key with their new status; the count is its rows."""
    return nodes.where((F.col("source") == "manual") & (F.col("kind") == kind) & (graph_key(F.col("title")) == key)).withColumn("status", F.lit(status))
