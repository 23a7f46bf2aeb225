"""Queries of chunks, path evidence, semantics, JSON values, and the state graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import jsons as J
from threadloom.functions import semantics as V
from threadloom.operators import graph as G
from threadloom.operators import reduction as R
from threadloom.operators import state as S
from threadloom.operators import summary as Y
from threadloom.operators import telemetry as T
from threadloom.plans.message_queries import _SUMMARY, _summaries
from threadloom.plans.reduction_queries import plan_sql, with_files
from threadloom.plans.registry import query


@query("session_chunks", "turns")
def session_chunks(turns: DataFrame) -> DataFrame:
    ends = turns.where("role = 'user'").select("session_id", F.col("idx").alias("after_idx"), F.lit("user turn").alias("topic"), F.lit("normal").alias("priority"))
    return R.chunks(turns, ends, 2000, 8000)


@query(
    "normal_boundaries",
    "turns",
    sql="""WITH n AS (SELECT session_id, count(*) AS n FROM {turns} GROUP BY 1)
    SELECT t.session_id, greatest(0, least(idx * 2, greatest(0, n - 2))) AS after_idx, arg_min(text, idx) AS topic, 'high' AS priority FROM {turns} t JOIN n ON n.session_id = t.session_id GROUP BY 1, 2""",
)
def normal_boundaries(turns: DataFrame) -> DataFrame:
    raw = turns.select("session_id", (F.col("idx") * 2).alias("after_idx"), F.col("idx").alias("ord"), F.col("text").alias("topic"), F.lit("high").alias("priority"))
    return R.normal_boundaries(raw, turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")))


@query(
    "bounded_texts",
    "documents",
    sql=r"""SELECT doc_id, sha256(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 231) || chr(10) || '[… bounded …]' || chr(10) || right(text, 154) END) AS text_sha256 FROM documents""",
)
def bounded_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(R.fitted_text(F.col("text"), F.lit(400)), 256).alias("text_sha256"))


@query(
    "recommended_modes",
    "window_turns",
    sql=f"""WITH {plan_sql(150_000)}, best AS (SELECT session_id, max(saved_tokens) FILTER (WHERE reason = 'viable') AS saved FROM plans GROUP BY 1)
    SELECT b.session_id, min(mode) FILTER (WHERE reason = 'viable' AND saved_tokens = saved) AS mode, coalesce(any_value(saved), 0.0e0) AS saved_tokens
    FROM best b JOIN plans p ON p.session_id = b.session_id GROUP BY 1""",
)
def recommended_modes(turns: DataFrame) -> DataFrame:
    return R.recommended(R.plan_windows(with_files(turns), 150_000))


@query(
    "path_evidence",
    "steps",
    sql="""
    WITH p AS (SELECT DISTINCT session_id AS doc_id, path FROM {steps}), s AS (SELECT *, sum(length(path) + 5) OVER (PARTITION BY doc_id) AS whole, greatest(24, floor(500 / count(*) OVER (PARTITION BY doc_id))) AS share FROM p)
    SELECT doc_id, path, '- ' || CASE WHEN whole <= 500 OR length(path) + 2 <= share THEN '"' || path || '"' ELSE '"…' || right(path, CAST(greatest(1, share - 13) AS INT)) || '#' || substr(sha256(path), 1, 8) || '"' END AS line FROM s""",
)
def path_evidence(steps: DataFrame) -> DataFrame:
    return Y.path_evidence(steps.select(F.col("session_id").alias("doc_id"), "path").distinct(), 500)


@query(
    "critical_context",
    "state_items",
    sql=f"""WITH {_SUMMARY}, l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM parts WHERE kind = 'critical-context')
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS place, trim(substr(line, 3)) AS text FROM l QUALIFY place <= 20""",
)
def critical_context(items: DataFrame) -> DataFrame:
    return Y.critical_context(Y.sections(_summaries(items)))


@query("semantic_gaps", "state_items")
def semantic_gaps(items: DataFrame) -> DataFrame:
    made = _summaries(items)
    facts = made.select("doc_id", F.lit("goal").alias("kind"), F.lit("goal").alias("section"), F.concat(F.lit("never finish job "), F.col("doc_id").cast("string")).alias("text"))
    return Y.semantic_gaps(Y.sections(made), facts)


@query("semantic_stems", "nodes")
def semantic_stems(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", F.array_join(V.stems(F.col("title")), " ").alias("stems"))


@query(
    "canonical_arguments",
    "calls",
    sql="""SELECT session_id, call_id, CASE WHEN name = 'grep-search' THEN concat('{{"path":"","pattern":"', json_extract_string(args, '$.pattern'), '"}}')
        WHEN name = 'write_file' THEN concat('{{"content":"","path":"', json_extract_string(args, '$.path'), '"}}') ELSE args END AS canonical FROM {calls}""",
)
def canonical_arguments(calls: DataFrame) -> DataFrame:
    return calls.select("session_id", "call_id", J.canonical(F.col("args")).alias("canonical"))


@query(
    "scrubbed_arguments",
    "steps",
    sql="""SELECT event_id, CASE WHEN k % 2 = 0 THEN concat('{{"a":[{{"apiKey":"[REDACTED:credential]"}},"', path, '"],"n":', CAST(k AS VARCHAR), '}}')
        ELSE concat('{{"a":[{{"apiKey":"short"}},"', path, '"],"n":', CAST(k AS VARCHAR), '}}') END AS args FROM {steps}""",
)
def scrubbed_arguments(steps: DataFrame) -> DataFrame:
    secret = F.when(F.col("k") % 2 == 0, F.concat(F.lit("secret-"), F.col("event_id").cast("string"), F.lit("-long"))).otherwise("short")
    args = F.concat(F.lit('{"a":[{"apiKey":"'), secret, F.lit('"},"'), "path", F.lit('"],"n":'), F.col("k").cast("string"), F.lit("}"))
    return steps.select("event_id", J.scrubbed(args).alias("args"))


@query("repaired_reports", "steps")
def repaired_reports(steps: DataFrame) -> DataFrame:
    body = F.concat(F.lit('```json\n{"sessionType":"review","boundaries":[{"afterIndex":'), F.col("k").cast("string"), F.lit(',"priority":"high","topic":"t"},]}\n```'))
    return steps.select("event_id", J.report(body, F.lit(40)).alias("report"))


_FACT_ROWS = """SELECT session_id % 7 AS project_id, session_id, branch_id, kind, text, status, branch_id % 2 = 0 AS explicit, array('src/A' || CAST(branch_id % 5 AS STRING) || '.ts', 'src/a' || CAST(branch_id % 5 AS STRING) || '.ts') AS paths, updated_at FROM {facts}"""


def _fact_rows(facts: DataFrame) -> DataFrame:
    return facts.sparkSession.sql(_FACT_ROWS, facts=facts)


@query(
    "state_nodes",
    "facts",
    sql=r"""
    SELECT concat('cg-', substr(sha256(concat(CAST(session_id % 7 AS VARCHAR), chr(0), CAST(session_id AS VARCHAR), chr(0), kind, chr(0), trim(regexp_replace(lower(text), '\s+', ' ', 'g')), chr(0), CAST(branch_id AS VARCHAR))), 1, 24)) AS node_id,
        kind, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS fact_key, status, CASE WHEN kind = 'decision' THEN CASE WHEN branch_id % 2 = 0 THEN 0.98::DOUBLE ELSE 0.82 END ELSE 0.85 END AS confidence FROM {facts}""",
)
def state_nodes(facts: DataFrame) -> DataFrame:
    return G.fact_nodes(_fact_rows(facts)).select("node_id", "kind", "fact_key", "status", "confidence")


@query(
    "state_edges",
    "facts",
    sql=r"""
    WITH n AS (SELECT session_id % 7 AS project_id, concat('cg-', substr(sha256(concat(CAST(session_id % 7 AS VARCHAR), chr(0), CAST(session_id AS VARCHAR), chr(0), kind, chr(0), trim(regexp_replace(lower(text), '\s+', ' ', 'g')), chr(0), CAST(branch_id AS VARCHAR))), 1, 24)) AS from_id,
        concat('src/a', CAST(branch_id % 5 AS VARCHAR), '.ts') AS low FROM {facts})
    SELECT project_id, count(DISTINCT from_id) AS sources, count(DISTINCT low) AS files, round(sum(0.85), 2)::DOUBLE AS weight FROM (SELECT DISTINCT project_id, from_id, low FROM n) GROUP BY 1""",
)
def state_edges(facts: DataFrame) -> DataFrame:
    nodes = G.fact_nodes(_fact_rows(facts))
    files = G.file_nodes(nodes).dropDuplicates(["project_id", "fact_key"])
    edges = G.reference_edges(nodes, files)
    # One edge per fact and file, although the file is named in two ways.
    owned = edges.join(nodes.select(F.col("node_id").alias("from_id"), "project_id"), "from_id")
    return owned.groupBy("project_id").agg(
        F.count_distinct("from_id").alias("sources"), F.count_distinct("to_id").alias("files"), F.round(F.sum("weight"), 2).alias("weight")
    )


@query(
    "phase_shares",
    "llm_calls",
    sql="""SELECT provider, phase, CAST(sum(latency_ms) AS BIGINT) AS ms, round(sum(latency_ms) / greatest(1, sum(sum(latency_ms)) OVER (PARTITION BY provider)), 6) AS share FROM {llm_calls} GROUP BY 1, 2""",
)
def phase_shares(calls: DataFrame) -> DataFrame:
    """Each phase's part of a provider's time; a total of zero counts as one."""
    sums = calls.groupBy("provider", "phase").agg(F.sum("latency_ms").alias("ms"))
    total = F.greatest(F.lit(1), F.sum("ms").over(Window.partitionBy("provider")))
    return sums.withColumn("share", F.round(F.col("ms") / total, 6))


@query(
    "route_quality_attribution",
    "llm_calls",
    sql=f"""
    WITH r AS (SELECT event_id // 4 AS run, CASE WHEN phase = 'patch' THEN 'verify' WHEN phase = 'probe' OR phase LIKE 'explore%' THEN 'explore' ELSE 'synthesize' END AS stage, provider, model, bool_or(success) AS ok FROM {{llm_calls}} GROUP BY 1, 2, 3, 4),
    c AS (SELECT *, count(*) FILTER (WHERE stage = 'synthesize' AND ok) OVER (PARTITION BY run) AS n FROM r)
    SELECT run, stage, provider, model, CASE WHEN n = 1 AND stage = 'synthesize' AND ok THEN 90.0::DOUBLE END AS quality FROM c""",
)
def route_quality_attribution(calls: DataFrame) -> DataFrame:
    """A run's quality belongs to its route only if exactly one synthesis route succeeded."""
    stage = T.provider_stage(F.col("phase"))
    routes = calls.groupBy(F.expr("event_id div 4").alias("run"), stage.alias("stage"), "provider", "model").agg(F.max("success").alias("ok"))
    good = (F.col("stage") == "synthesize") & F.col("ok")
    n = F.count(F.when(good, 1)).over(Window.partitionBy("run"))
    return routes.withColumn("n", n).select("run", "stage", "provider", "model", F.when((F.col("n") == 1) & good, 90.0).alias("quality"))


_STATES = "SELECT session_id, path, count(*) FILTER (WHERE k % 3 = 0) AS modified_count, max(ord) FILTER (WHERE k % 3 = 0) AS last_modified, max(ord) FILTER (WHERE k % 3 = 1) AS last_read, CASE WHEN max(ord) = max(ord) FILTER (WHERE k % 3 = 2) THEN max(ord) END AS deleted_at FROM {steps}"


def _states(steps: DataFrame) -> DataFrame:
    kind, at = F.col("k") % 3, F.col("ord")
    gone = F.max(F.when(kind == 2, at))
    return steps.groupBy("session_id", "path").agg(
        F.count(F.when(kind == 0, 1)).alias("modified_count"),
        F.max(F.when(kind == 0, at)).alias("last_modified"),
        F.max(F.when(kind == 1, at)).alias("last_read"),
        F.when(F.max(at) == gone, gone).alias("deleted_at"),
    )


@query(
    "merged_file_states",
    "steps",
    sql=f"""
    WITH b AS ({_STATES} WHERE ord < 30 GROUP BY 1, 2), d AS ({_STATES} WHERE ord >= 30 GROUP BY 1, 2)
    SELECT coalesce(b.session_id, d.session_id) AS session_id, coalesce(b.path, d.path) AS path,
        CASE WHEN d.deleted_at IS NOT NULL THEN 0 ELSE coalesce(b.modified_count, 0) + coalesce(d.modified_count, 0) END AS modified_count,
        CASE WHEN d.deleted_at IS NULL THEN coalesce(d.last_modified + 100, b.last_modified) END AS last_modified,
        CASE WHEN d.deleted_at IS NULL THEN coalesce(d.last_read + 100, b.last_read) END AS last_read,
        CASE WHEN d.deleted_at IS NOT NULL THEN d.deleted_at + 100 WHEN d.path IS NOT NULL THEN NULL ELSE b.deleted_at END AS deleted_at
    FROM b FULL JOIN d ON b.session_id = d.session_id AND b.path = d.path""",
)
def merged_file_states(steps: DataFrame) -> DataFrame:
    return S.merged_file_states(_states(steps.where("ord < 30")), _states(steps.where("ord >= 30")), F.lit(100))


@query(
    "merged_fact_rows",
    "steps",
    sql="""
    WITH a AS (SELECT session_id, ord AS idx, path FROM {steps} WHERE ord < 30 UNION ALL SELECT session_id, ord + 100, path FROM {steps} WHERE ord >= 30),
    o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY session_id, path ORDER BY idx) = 1)
    SELECT session_id, idx, path FROM o QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY idx DESC, path) <= 8""",
)
def merged_fact_rows(steps: DataFrame) -> DataFrame:
    rows = steps.select("session_id", F.col("ord").alias("idx"), "path")
    return S.merged_rows(rows.where("idx < 30"), rows.where("idx >= 30"), F.lit(100), 8, "path")
