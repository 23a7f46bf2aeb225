"""Queries of continuity state, lineage, project fingerprint and the context graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import graph as G
from threadloom.operators import state as S
from threadloom.plans.registry import query

_KEY = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


def _side(items: DataFrame, side: str) -> DataFrame:
    return items.where(F.col("side") == side).drop("side", "priority")


@query(
    "merged_state",
    "state_items",
    sql=rf"""
    WITH k AS (SELECT *, {_KEY} AS key, CASE side WHEN 'current' THEN 0 ELSE 1 END AS s FROM {{state_items}}),
    a AS (SELECT * FROM k WHERE NOT (kind = 'unresolved' AND s = 1 AND EXISTS (SELECT 1 FROM k r WHERE r.s = 0 AND r.kind = 'resolved' AND r.session_id = k.session_id AND r.key = k.key))),
    d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY session_id, kind, key ORDER BY s, ord) = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY s, ord, key) AS place FROM d)
    SELECT session_id, kind, CAST(place AS INT) AS place, concat(CASE kind WHEN 'unresolved' THEN 'error-' WHEN 'resolved' THEN 'resolved-' ELSE concat(kind, '-') END, place) AS id, text, CAST(s AS INT) AS side
    FROM p WHERE place <= CASE kind WHEN 'unresolved' THEN 15 WHEN 'resolved' THEN 20 ELSE 30 END""",
)
def merged_state(items: DataFrame) -> DataFrame:
    return S.merged(_side(items, "current"), _side(items, "previous"))


_LOOPS = """SELECT session_id, side, ord, text, CASE WHEN kind = 'resolved' THEN 'resolved' ELSE 'open' END AS status, priority FROM {state_items}"""


@query(
    "merged_loops",
    "state_items",
    sql=rf"""
    WITH l AS (SELECT *, {_KEY} AS key, CASE side WHEN 'current' THEN 0 ELSE 1 END AS s FROM ({_LOOPS})),
    d AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY session_id, key ORDER BY s, ord) = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE status WHEN 'resolved' THEN 1 ELSE 0 END, CASE priority WHEN 'high' THEN 1 ELSE 2 END, s, ord, key) AS place FROM d)
    SELECT session_id, CAST(place AS INT) AS place, concat('loop-', place) AS id, text, status, priority FROM p WHERE place <= 25""",
)
def merged_loops(items: DataFrame) -> DataFrame:
    loops = items.withColumn("status", F.when(F.col("kind") == "resolved", "resolved").otherwise("open")).drop("kind")
    return S.merged_loops(loops.where("side = 'current'").drop("side"), loops.where("side = 'previous'").drop("side"))


_DELTA = rf"""
    k AS (SELECT *, {_KEY} AS key FROM {{state_items}}),
    b AS (SELECT session_id, kind, key, arg_min(text, ord) AS before FROM k WHERE side = 'previous' AND kind <> 'resolved' GROUP BY 1, 2, 3),
    n AS (SELECT session_id, kind, key, arg_min(text, ord) AS now FROM k WHERE side = 'current' AND kind <> 'resolved' GROUP BY 1, 2, 3),
    m AS (SELECT coalesce(b.session_id, n.session_id) AS session_id, coalesce(b.kind, n.kind) AS kind, coalesce(b.key, n.key) AS key, before, now
        FROM b FULL JOIN n ON b.session_id = n.session_id AND b.kind = n.kind AND b.key = n.key),
    delta AS (SELECT session_id, kind, coalesce(now, before) AS text, CASE WHEN before IS NULL THEN 'new'
        WHEN kind = 'unresolved' AND EXISTS (SELECT 1 FROM k r WHERE r.side = 'current' AND r.kind = 'resolved' AND r.session_id = m.session_id AND r.key = m.key) THEN 'resolved'
        WHEN now IS NOT NULL THEN 'persistent' ELSE 'gone' END AS change FROM m)"""


@query("state_delta", "state_items", sql=f"WITH {_DELTA} SELECT * FROM delta")
def state_delta(items: DataFrame) -> DataFrame:
    return S.delta(_side(items, "previous"), _side(items, "current"))


@query(
    "state_delta_summary",
    "state_items",
    sql=f"""WITH {_DELTA}, c AS (SELECT session_id, count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'resolved') AS resolved,
    count(*) FILTER (WHERE change = 'persistent') AS persistent, count(*) FILTER (WHERE change = 'gone') AS gone FROM delta GROUP BY 1)
    SELECT *, new > 0 OR resolved > 0 AS changed FROM c""",
)
def state_delta_summary(items: DataFrame) -> DataFrame:
    return S.delta_summary(S.delta(_side(items, "previous"), _side(items, "current")))


@query(
    "recent_unique_items",
    "state_items",
    sql="""WITH l AS (SELECT session_id, text, max(ord) AS ord FROM {state_items} GROUP BY 1, 2)
    SELECT session_id, text, ord FROM l QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord DESC, text) <= 4""",
)
def recent_unique_items(items: DataFrame) -> DataFrame:
    return S.recent_unique(items, 4, "session_id")[0]


@query(
    "file_set_merge",
    "steps",
    sql="""
    WITH i AS (SELECT session_id, CASE k % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'read' ELSE 'deleted' END AS kind, ord, path AS text, CASE WHEN ord % 2 = 0 THEN 0 ELSE 1 END AS s FROM {steps}),
    a AS (SELECT * FROM i WHERE NOT (s = 1 AND EXISTS (SELECT 1 FROM i c WHERE c.s = 0 AND c.session_id = i.session_id AND c.text = i.text
        AND ((i.kind = 'deleted' AND c.kind IN ('modified', 'read')) OR (i.kind IN ('modified', 'read') AND c.kind = 'deleted'))))),
    d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY session_id, kind, text ORDER BY s, ord) = 1)
    SELECT session_id, kind, text, CAST(place AS INT) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY s, ord, text) AS place FROM d)""",
)
def file_set_merge(steps: DataFrame) -> DataFrame:
    kind = F.when(F.col("k") % 3 == 0, "modified").when(F.col("k") % 3 == 1, "read").otherwise("deleted")
    items = steps.select("session_id", kind.alias("kind"), "ord", F.col("path").alias("text"))
    return S.file_sets(items.where("ord % 2 = 0"), items.where("ord % 2 = 1"))


_OVERRIDES = """SELECT session_id, kind, lineage_rank AS ord, concat('item ', CAST(branch_id % 9 AS STRING)) AS key, CASE branch_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'superseded' ELSE 'active' END AS status,
    CASE WHEN branch_id % 6 = 1 THEN concat('better ', CAST(branch_id % 9 AS STRING)) END AS replacement, branch_id % 2 = 0 AS pinned
    FROM (SELECT *, CASE WHEN branch_id % 4 < 2 THEN 'decision' WHEN branch_id % 4 = 2 THEN 'constraint' ELSE 'loop' END AS kind FROM {lineage}) l WHERE lineage_rank % 3 = 0"""


@query(
    "overridden_items",
    "state_items",
    "lineage",
    sql=rf"""
    WITH o AS ({_OVERRIDES}), last AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY session_id, kind, key ORDER BY ord DESC) = 1)
    SELECT session_id, kind, ord, text FROM {{state_items}} i WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.session_id = i.session_id AND l.kind = i.kind AND l.key = {_KEY} AND l.status <> 'active')
    UNION ALL SELECT session_id, 'context', CAST(-1 AS BIGINT), concat('Superseded ', kind, ': ', replacement) FROM last WHERE status = 'superseded' AND replacement IS NOT NULL""",
)
def overridden_items(items: DataFrame, lineage: DataFrame) -> DataFrame:
    overrides = lineage.sparkSession.sql(_OVERRIDES, lineage=lineage)
    return S.without_overridden(items.select("session_id", "kind", "ord", "text"), overrides)


@query(
    "loop_overrides",
    "state_items",
    "lineage",
    sql=rf"""
    WITH o AS ({_OVERRIDES}), last AS (SELECT * FROM o WHERE kind = 'loop' QUALIFY row_number() OVER (PARTITION BY session_id, key ORDER BY ord DESC) = 1),
    l AS (SELECT i.session_id, i.ord, i.text, coalesce(l.status, 'open') AS status, coalesce(l.pinned, false) AS pinned FROM {{state_items}} i LEFT JOIN last l ON l.session_id = i.session_id AND l.key = {_KEY})
    SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pinned DESC, ord) AS INT) AS place, text, status, pinned FROM l""",
)
def loop_overrides(items: DataFrame, lineage: DataFrame) -> DataFrame:
    overrides = lineage.sparkSession.sql(_OVERRIDES, lineage=lineage)
    return S.with_loop_overrides(items.select("session_id", "ord", "text", F.lit("open").alias("status")), overrides)


@query(
    "as_of_snapshots",
    "lineage",
    sql="""SELECT a.session_id, a.branch_id, arg_max(b.branch_id, b.lineage_rank) AS snapshot_id FROM {lineage} a LEFT JOIN {lineage} b
    ON a.session_id = b.session_id AND b.lineage_rank <= a.lineage_rank AND b.has_snapshot GROUP BY 1, 2""",
)
def as_of_snapshots(lineage: DataFrame) -> DataFrame:
    return S.as_of_snapshot(lineage)


@query(
    "latest_facts",
    "facts",
    sql=rf"""SELECT session_id, kind, {_KEY} AS key, arg_max(status, lineage_rank) AS status, arg_max(branch_id, lineage_rank) AS branch_id, count(*) AS versions FROM {{facts}} GROUP BY 1, 2, 3""",
)
def latest_facts(facts: DataFrame) -> DataFrame:
    return S.latest_facts(facts)


@query(
    "bounded_lineage",
    "lineage",
    sql="""WITH s AS (SELECT * FROM {lineage} WHERE has_snapshot QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY lineage_rank DESC) <= 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY lineage_rank DESC) AS n FROM {lineage} l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.session_id = l.session_id AND s.branch_id = l.branch_id)),
    c AS (SELECT session_id, count(*) AS c FROM s GROUP BY 1)
    SELECT session_id, branch_id, lineage_rank FROM s UNION ALL SELECT t.session_id, branch_id, lineage_rank FROM t LEFT JOIN c ON c.session_id = t.session_id WHERE n <= 8 - coalesce(c, 0)""",
)
def bounded_lineage(lineage: DataFrame) -> DataFrame:
    return S.bounded_lineage(lineage, 8)


@query(
    "fresh_snapshots",
    "runs",
    sql="SELECT run_id, session_id FROM {runs} WHERE ts >= TIMESTAMP '1998-08-02' - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY run_key DESC) <= 2",
)
def fresh_snapshots(runs: DataFrame) -> DataFrame:
    recent = S.fresh(runs, "ts", F.lit("1998-08-02").cast("timestamp_ntz"), 30)
    return S.retained(recent, 2, "session_id", order=F.col("run_key")).select("run_id", "session_id")


@query(
    "log_retention",
    "llm_calls",
    sql="""SELECT provider, event_id FROM (SELECT provider, event_id, sum(input_tokens) OVER (PARTITION BY provider ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS b FROM {llm_calls}) WHERE b <= 100000""",
)
def log_retention(calls: DataFrame) -> DataFrame:
    return S.within_bytes(calls, 100_000, "provider", order="event_id", size="input_tokens").select("provider", "event_id")


_PATHS = "SELECT session_id, ord, concat('/home/u', CAST(session_id % 5 AS STRING), '/proj', CAST(session_id % 3 AS STRING), '/', path, CASE WHEN k % 4 = 0 THEN '.py' ELSE '' END) AS path FROM {steps}"


@query(
    "project_fingerprints",
    "steps",
    sql=f"""
    WITH p AS ({_PATHS}), l AS (SELECT session_id, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'typescript' END AS language, count(*) AS files, min(ord) AS seen FROM p GROUP BY 1, 2),
    a AS (SELECT session_id, arg_max(language, {{{{'f': files, 's': -seen}}}}) AS language, max(files) AS files FROM l GROUP BY 1),
    w AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts, count(*) OVER (PARTITION BY session_id) AS n FROM p),
    x AS (SELECT session_id, n, parts, unnest(range(3, len(parts))) AS depth FROM w WHERE len(parts) > 3),
    y AS (SELECT session_id, depth, concat('/', array_to_string(parts[1:depth], '/')) AS root, count(*) AS held, max(n) AS n FROM x GROUP BY 1, 2, 3),
    r AS (SELECT session_id, arg_max(root, {{{{'d': depth, 'h': held, 'r': root}}}}) AS root FROM y WHERE held >= n * 0.5 GROUP BY 1)
    SELECT a.session_id, language, files, root FROM a LEFT JOIN r ON a.session_id = r.session_id""",
)
def project_fingerprints(steps: DataFrame) -> DataFrame:
    paths = steps.sparkSession.sql(_PATHS, steps=steps)
    return S.main_language(paths, "session_id").join(S.project_root(paths, "session_id"), "session_id", "left")


@query(
    "key_directories",
    "steps",
    sql="""WITH d AS (SELECT session_id, regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir, count(*) AS files FROM {steps} GROUP BY 1, 2)
    SELECT session_id, dir, files, CAST(row_number() OVER (PARTITION BY session_id ORDER BY files DESC, dir) AS INT) AS place FROM d QUALIFY place <= 2""",
)
def key_directories(steps: DataFrame) -> DataFrame:
    return S.key_directories(steps, "session_id", most=2)


# ---------------------------------------------------------------- graph

_NODES = """SELECT node_id, kind, title, content, confidence, CASE WHEN length(title) % 7 = 0 THEN 'resolved' ELSE 'active' END AS status, CASE WHEN length(content) % 9 = 0 THEN 'manual' ELSE 'compaction' END AS source,
    CAST(length(title) % 3 AS BIGINT) AS project_id, CAST(length(content) % 10 AS BIGINT) AS session_id, CAST(TIMESTAMP '2024-01-01' AS TIMESTAMP) AS updated_at FROM {nodes}"""


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.sparkSession.sql(_NODES, nodes=nodes)


@query(
    "node_upsert",
    "nodes",
    sql=f"""
    WITH n AS ({_NODES}), o AS (SELECT node_id, title, content, status, 1 AS updated_at FROM n WHERE kind = 'file' OR title LIKE '1-%'),
    w AS (SELECT node_id, title, concat(content, CASE WHEN length(title) % 4 = 0 THEN '!' ELSE '' END) AS content, status, 2 AS updated_at FROM n WHERE kind = 'decision' OR title LIKE '%a%')
    SELECT coalesce(w.node_id, o.node_id) AS node_id, CASE WHEN w.node_id IS NOT NULL THEN w.title ELSE o.title END AS title, CASE WHEN w.node_id IS NOT NULL THEN w.content ELSE o.content END AS content,
        CASE WHEN w.node_id IS NOT NULL THEN w.status ELSE o.status END AS status,
        CASE WHEN w.node_id IS NULL THEN 1 WHEN o.node_id IS NULL OR o.content <> w.content THEN 2 ELSE 1 END AS updated_at
    FROM o FULL JOIN w ON o.node_id = w.node_id""",
)
def node_upsert(nodes: DataFrame) -> DataFrame:
    base, columns = _nodes(nodes), ["node_id", "title", "content", "status"]
    old = base.where("kind = 'file' OR title LIKE '1-%'").select(columns).withColumn("updated_at", F.lit(1))
    mark = F.when(F.length("title") % 4 == 0, "!").otherwise("")
    new = base.where("kind = 'decision' OR title LIKE '%a%'").select(columns).withColumn("content", F.concat("content", mark)).withColumn("updated_at", F.lit(2))
    return G.upsert_nodes(old, new)


@query(
    "edge_upsert",
    "edges",
    sql="""SELECT from_id, to_id, 'references' AS relation, CASE WHEN length(to_id) % 2 = 0 THEN weight + 1 ELSE weight END AS weight FROM {edges}""",
)
def edge_upsert(edges: DataFrame) -> DataFrame:
    old = edges.withColumn("relation", F.lit("references"))
    new = old.where("length(to_id) % 2 = 0").withColumn("weight", F.col("weight") + 1)
    return G.upsert_edges(old, new)


@query(
    "posting_list",
    "nodes",
    sql=f"""
    WITH n AS (SELECT * FROM ({_NODES}) WHERE status = 'active'),
    c AS (SELECT node_id, 'title' AS "column", title AS t FROM n UNION ALL SELECT node_id, 'content', content FROM n UNION ALL SELECT node_id, 'kind', kind FROM n),
    w AS (SELECT node_id, "column", unnest(regexp_extract_all(lower(t), '[\\pL\\pN]+')) AS term FROM c)
    SELECT term, node_id, "column", count(*) AS tf FROM w GROUP BY ALL""",
)
def posting_list(nodes: DataFrame) -> DataFrame:
    return G.postings(_nodes(nodes))


_TERMS = ("steel", "high")
_MATCHES = f"""
    n AS (SELECT * FROM ({_NODES}) WHERE status = 'active'),
    c AS (SELECT node_id, 3.0::DOUBLE AS weight, title AS t FROM n UNION ALL SELECT node_id, 1.0, content FROM n UNION ALL SELECT node_id, 0.5, kind FROM n),
    w AS (SELECT node_id, weight, unnest(regexp_extract_all(lower(t), '[\\pL\\pN]+')) AS term FROM c),
    len AS (SELECT node_id, count(*) AS length FROM w GROUP BY 1), st AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
    q AS (SELECT unnest(['steel', 'high']) AS query), f AS (SELECT query, node_id, sum(weight) AS f FROM w JOIN q ON starts_with(term, query) GROUP BY 1, 2),
    df AS (SELECT query, count(*) AS df FROM f GROUP BY 1),
    bm AS (SELECT f.node_id, sum(greatest(1e-6, ln((st.n - df + 0.5) / (df + 0.5))) * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * length / mean))) AS bm25
        FROM f JOIN df ON f.query = df.query JOIN len ON len.node_id = f.node_id, st GROUP BY 1)"""


@query("bm25_matches", "nodes", sql=f"WITH {_MATCHES} SELECT node_id, round(bm25, 6) AS bm25 FROM bm")
def bm25_matches(nodes: DataFrame) -> DataFrame:
    return G.matches(G.postings(_nodes(nodes)), list(_TERMS)).withColumn("bm25", F.round("bm25", 6))


@query(
    "graph_neighbours",
    "nodes",
    "edges",
    sql=f"""WITH {_MATCHES}, s AS (SELECT node_id AS seed FROM bm ORDER BY round(bm25, 6) DESC, node_id LIMIT 12),
    b AS (SELECT to_id AS node_id, weight FROM {{edges}} JOIN s ON from_id = seed UNION ALL SELECT from_id, weight FROM {{edges}} JOIN s ON to_id = seed)
    SELECT node_id, max(weight) AS graph FROM b GROUP BY 1""",
)
def graph_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = G.matches(G.postings(_nodes(nodes)), list(_TERMS)).withColumn("bm25", F.round("bm25", 6))
    return G.neighbours(edges, found.orderBy(F.desc("bm25"), "node_id").limit(G.SEEDS).select("node_id"))


@query(
    "context_recall",
    "nodes",
    "edges",
    sql=f"""WITH {_MATCHES},
    top AS (SELECT node_id, row_number() OVER (ORDER BY round(bm25, 6) DESC, node_id) - 1 AS place FROM bm ORDER BY round(bm25, 6) DESC, node_id LIMIT 80),
    lex AS (SELECT node_id, place, 1 - place / (SELECT greatest(1, count(*)) FROM top) AS lexical FROM top),
    near AS (SELECT node_id, max(weight) AS graph FROM (SELECT to_id AS node_id, weight FROM {{edges}} JOIN lex ON from_id = lex.node_id AND place < 12
        UNION ALL SELECT from_id, weight FROM {{edges}} JOIN lex ON to_id = lex.node_id AND place < 12) GROUP BY 1),
    found AS (SELECT coalesce(l.node_id, g.node_id) AS node_id, coalesce(lexical, 0) AS lexical, coalesce(graph, 0) AS graph FROM lex l FULL JOIN near g ON l.node_id = g.node_id),
    s AS (SELECT n.*, least(1.0, 0.05 + lexical * 0.3 + graph * 0.15 + CASE kind WHEN 'decision' THEN 0.1 ELSE 0.03 END + confidence * 0.08 + (1 - 10 / 90.0::DOUBLE) * 0.05
        + CASE source WHEN 'manual' THEN 0.04 ELSE 0 END) AS score FROM n JOIN found ON n.node_id = found.node_id),
    d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY kind, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) ORDER BY round(score, 6) DESC, node_id) = 1)
    SELECT node_id, kind, title, floor(score * 1000 + 0.5) / 1000 AS score FROM d ORDER BY round(score, 6) DESC, node_id LIMIT 5""",
)
def context_recall(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    frame = _nodes(nodes)
    return G.recall(frame, edges, G.postings(frame), list(_TERMS), F.lit("2024-01-11").cast("date"))


@query(
    "graph_stats",
    "nodes",
    sql=f"""SELECT project_id, count(*) AS nodes, count(*) FILTER (WHERE status = 'active') AS active, count(DISTINCT session_id) FILTER (WHERE kind = 'session') AS sessions, max(updated_at) AS updated_at
    FROM ({_NODES}) GROUP BY 1""",
)
def graph_stats(nodes: DataFrame) -> DataFrame:
    return G.graph_stats(_nodes(nodes))


@query(
    "graph_retention",
    "nodes",
    sql=f"""SELECT project_id, node_id FROM ({_NODES}) WHERE source <> 'manual'
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY status = 'active' DESC, updated_at DESC, node_id DESC) > 2000""",
)
def graph_retention(nodes: DataFrame) -> DataFrame:
    return G.evicted(_nodes(nodes))


@query(
    "saved_memories",
    "nodes",
    sql=rf"""
    WITH m AS (SELECT CAST(length(title) % 3 AS BIGINT) AS project_id, kind, title AS text, [content] AS paths, length(content) AS updated_at, node_id FROM {{nodes}}),
    u AS (SELECT project_id, kind, {_KEY} AS key, list_sort(list_distinct(flatten(list(paths))))[1:20] AS paths, max(updated_at) AS updated_at FROM m GROUP BY 1, 2, 3)
    SELECT project_id, kind, key, array_to_string(paths, ',') AS paths, updated_at FROM u QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, kind, key) <= 500""",
)
def saved_memories(nodes: DataFrame) -> DataFrame:
    memories = nodes.select(
        (F.length("title") % 3).cast("long").alias("project_id"), "kind", F.col("title").alias("text"), F.array("content").alias("paths"), F.length("content").alias("updated_at")
    )
    return G.saved_memories(memories).select("project_id", "kind", "key", F.array_join("paths", ",").alias("paths"), F.col("updated_at").cast("long").alias("updated_at"))


@query(
    "query_terms",
    "nodes",
    sql=r"""SELECT kind, count(*) AS n, max(len(regexp_extract_all(lower(title), '[\pL\pN_-]{{2,}}'))) AS most FROM {nodes} GROUP BY 1""",
)
def query_terms(nodes: DataFrame) -> DataFrame:
    found = F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}_-]{2,}"), F.lit(0))
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(found)).cast("long").alias("most"))
