"""Queries of project context, continuity and small predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import state as S
from threadloom.operators import telemetry as T
from threadloom.plans.registry import query


@query(
    "project_frameworks",
    "steps",
    sql="""WITH p AS (SELECT session_id, CASE WHEN session_id % 5 = 0 AND k = 1 THEN 'web/next.config.js' WHEN session_id % 3 = 0 AND k = 2 THEN 'package.json' ELSE path END AS path FROM {steps})
    SELECT session_id, CASE WHEN bool_or(contains(path, 'next.config')) THEN 'nextjs' WHEN bool_or(path = 'package.json') THEN 'node' END AS framework FROM p GROUP BY 1""",
)
def project_frameworks(steps: DataFrame) -> DataFrame:
    sid, k = F.col("session_id"), F.col("k")
    path = F.when((sid % 5 == 0) & (k == 1), "web/next.config.js").when((sid % 3 == 0) & (k == 2), "package.json").otherwise(F.col("path"))
    return S.framework(steps.select("session_id", path.alias("path")), "session_id")


@query(
    "relative_projects",
    "steps",
    sql="""
    WITH d AS (SELECT session_id, string_split(path, '/')[1] AS top, array_to_string(string_split(path, '/')[1:2], '/') AS dir FROM {steps}),
    t AS (SELECT session_id, string_agg(DISTINCT top, ',' ORDER BY top) AS tops FROM d GROUP BY 1), n AS (SELECT session_id, dir, count(*) AS n FROM d GROUP BY 1, 2),
    b AS (SELECT session_id, string_agg(dir, ',' ORDER BY dir) AS dirs FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, dir) <= 2) GROUP BY 1)
    SELECT t.session_id, concat('proj-', substr(sha256(concat(tops, '|', coalesce(dirs, ''))), 1, 12)) AS project_id FROM t LEFT JOIN b ON t.session_id = b.session_id""",
)
def relative_projects(steps: DataFrame) -> DataFrame:
    return S.relative_project(steps.select("session_id", "path"), "session_id", most=2)


@query(
    "project_records",
    "steps",
    sql="""SELECT session_id % 4 AS project_id, count(DISTINCT session_id) AS sessions, least(20, count(DISTINCT path)) AS files, least(2, count(DISTINCT regexp_extract(path, '^(.*)/[^/]+$', 1))) AS dirs FROM {steps} GROUP BY 1""",
)
def project_records(steps: DataFrame) -> DataFrame:
    rows = steps.select((F.col("session_id") % 4).alias("project_id"), "session_id", "ord", "path")
    return S.fingerprint(rows, "project_id", files=20, dirs=2)


@query(
    "project_contexts",
    "steps",
    sql="""SELECT project_id, concat('## Project Context (learned from ', n, ' session(s))', chr(10), 'Language: typescript') || CASE WHEN project_id % 2 = 0 THEN chr(10) || 'Framework: node' ELSE '' END AS text
    FROM (SELECT session_id % 4 AS project_id, count(DISTINCT session_id) AS n FROM {steps} GROUP BY 1)""",
)
def project_contexts(steps: DataFrame) -> DataFrame:
    rows = steps.groupBy((F.col("session_id") % 4).alias("project_id")).agg(F.count_distinct("session_id").alias("sessions"))
    told = rows.withColumns({"language": F.lit("typescript"), "framework": F.when(F.col("project_id") % 2 == 0, "node"), "dirs": F.lit("")})
    return S.project_context(told)


@query(
    "previous_contexts",
    "lineage",
    sql="""WITH c AS (SELECT session_id, arg_max(branch_id, lineage_rank) AS b FROM {lineage} WHERE has_snapshot GROUP BY 1)
    SELECT session_id, concat('[IMPORTANT: Previous compaction exists (staged). Already summarized topics: t', b % 5, ', x. Build upon this, don''t drop still-relevant facts.]', chr(10), chr(10), 'Previous verified summary:', chr(10), 'Summary ', b) AS text FROM c""",
)
def previous_contexts(lineage: DataFrame) -> DataFrame:
    branch = lineage.select(
        "session_id",
        F.col("lineage_rank").alias("ord"),
        F.when(F.col("has_snapshot"), "compaction").otherwise("message").alias("type"),
        F.when(F.col("branch_id") % 2 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00").alias("stamp"),
        F.lit("staged").alias("method"),
        F.array(F.concat(F.lit("t"), (F.col("branch_id") % 5).cast("string")), F.lit("x")).alias("topics"),
        F.concat(F.lit("Summary "), F.col("branch_id").cast("string")).alias("summary"),
    )
    return S.previous_context(branch)


@query(
    "continuity_capsules",
    "state_items",
    sql="""
    WITH RECURSIVE i AS (SELECT session_id, concat('- ', kind, ': ', regexp_replace(text, '\\s+', ' ', 'g')) AS line, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n FROM {state_items} WHERE kind <> 'resolved'),
    f AS (SELECT session_id, CAST(0 AS BIGINT) AS n, '## Continuity Ledger' AS text FROM i GROUP BY 1
        UNION ALL SELECT f.session_id, i.n, CASE WHEN length(f.text) + length(i.line) + 1 <= 120 THEN f.text || chr(10) || i.line ELSE f.text END FROM f JOIN i ON i.session_id = f.session_id AND i.n = f.n + 1)
    SELECT session_id, arg_max(text, n) AS text FROM f GROUP BY 1""",
)
def continuity_capsules(items: DataFrame) -> DataFrame:
    shown = items.where("kind <> 'resolved'").select("session_id", "ord", F.col("kind").alias("label"), "text")
    none = items.select("session_id", F.lit("").alias("text")).limit(0)
    return S.continuity_capsule(shown, none, 120)


@query(
    "deduped_texts",
    "state_items",
    sql=r"""WITH o AS (SELECT session_id, kind, arg_min(text, ord) AS text, min(ord) AS ord, count(*) AS n FROM {state_items} GROUP BY session_id, kind, trim(regexp_replace(lower(text), '\s+', ' ', 'g')))
    SELECT session_id, kind, string_agg(text || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END, '; ' ORDER BY ord) AS text FROM o GROUP BY 1, 2""",
)
def deduped_texts(items: DataFrame) -> DataFrame:
    return S.deduped_text(items, "session_id", "kind")


@query(
    "preprocessed_summaries",
    "lineage",
    sql="""
    WITH d AS (SELECT session_id, concat('d', branch_id % 4) AS x, min(lineage_rank) AS o FROM {lineage} GROUP BY 1, 2), f AS (SELECT DISTINCT session_id, concat('f', branch_id % 3, '.ts') AS y FROM {lineage})
    SELECT a.session_id, a.decisions, b.files FROM (SELECT session_id, string_agg(x, ',' ORDER BY o) AS decisions FROM d GROUP BY 1) a JOIN (SELECT session_id, string_agg(y, ',' ORDER BY y) AS files FROM f GROUP BY 1) b ON a.session_id = b.session_id""",
)
def preprocessed_summaries(lineage: DataFrame) -> DataFrame:
    rows = lineage.select(
        "session_id", F.col("lineage_rank").alias("ord"), F.array(F.concat(F.lit("d"), (F.col("branch_id") % 4).cast("string"))).alias("decisions"),
        F.array(F.concat(F.lit("f"), (F.col("branch_id") % 3).cast("string"), F.lit(".ts"))).alias("files"),
    )
    return S.preprocessed(rows).select("session_id", F.array_join("decisions", ",").alias("decisions"), F.array_join("files", ",").alias("files"))


@query(
    "tool_rejections",
    "runs",
    sql="""SELECT run_id, (run_key % 3 = 0 AND run_key % 2 = 0) AS rejects, greatest(1, least(total_output, CASE WHEN total_calls > 2 THEN 100 ELSE total_output END)) AS tokens, run_key % 4 = 0 AS unresolved FROM {runs}""",
)
def tool_rejections(runs: DataFrame) -> DataFrame:
    status = F.when(F.col("run_key") % 3 == 0, 400).otherwise(500)
    message = F.when(F.col("run_key") % 2 == 0, "Function calling is not supported here").otherwise("quota")
    most = F.when(F.col("total_calls") > 2, 100).otherwise(0)
    named = T.session_identity(F.when(F.col("run_key") % 4 == 0, "").otherwise(F.col("run_id")))
    return runs.select(
        "run_id", T.rejects_tools(status, message).alias("rejects"), T.clamped_tokens(F.col("total_output"), most).cast("long").alias("tokens"), T.unresolved(named).alias("unresolved")
    )
