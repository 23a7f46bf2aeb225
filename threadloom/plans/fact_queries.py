"""Queries of tool operations and session facts, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import tools as K
from threadloom.operators import facts as O
from threadloom.plans.registry import query

# The relation's calls, classified by their names alone: enough to check the rules on them.
_OP = """CASE name WHEN 'functions.readFile' THEN 'read' WHEN 'grep-search' THEN 'search' WHEN 'listDir' THEN 'list' WHEN 'write_file' THEN 'mutate'
    WHEN 'deleteFile' THEN 'delete' WHEN 'ask_user' THEN CASE WHEN json_extract_string(args, '$.cmd') IS NOT NULL THEN 'execute' ELSE 'unknown' END ELSE 'execute' END"""
_PATH = "coalesce(nullif(json_extract_string(args, '$.path'), ''), json_extract_string(args, '$.file_path'), json_extract_string(args, '$.filePath'))"
_NAME = r"""regexp_replace(lower(regexp_replace(regexp_replace(name, '^functions[.]', ''), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g')"""
_COMMAND = r"regexp_replace(trim(regexp_replace(coalesce(json_extract_string(args, '$.command'), json_extract_string(args, '$.cmd')), '\s+', ' ', 'g')), ' --retry=3$', '')"
_STEPS = rf"""
    known AS (SELECT session_id, call_id, idx AS call_idx, name, args, {_OP} AS operation, {_PATH} AS path FROM {{calls}}),
    signed AS (SELECT *, concat(operation, chr(0), {_NAME}, chr(0), CASE WHEN operation = 'execute' THEN {_COMMAND} WHEN path IS NOT NULL THEN path
        WHEN operation = 'search' THEN json_extract_string(args, '$.pattern') ELSE concat('question=', json_extract_string(args, '$.question')) END) AS signature FROM known),
    steps2 AS (SELECT r.session_id, r.idx, r.call_id, r.is_error, r.text, c.call_idx, c.name, c.args, c.operation, c.path, c.signature
        FROM {{results}} r JOIN signed c ON r.session_id = c.session_id AND r.call_id = c.call_id)"""
_SHELL = r"""
        UNION ALL SELECT session_id, concat(regexp_extract(json_extract_string(args, '$.command'), 'rm -f (\S+)', 1), '.bak'), idx, 'mutate' FROM steps2
            WHERE NOT is_error AND starts_with(json_extract_string(args, '$.command'), 'touch') AND NOT contains(text, 'exited')
        UNION ALL SELECT session_id, regexp_extract(json_extract_string(args, '$.command'), 'rm -f (\S+)', 1), idx, 'delete' FROM steps2
            WHERE NOT is_error AND starts_with(json_extract_string(args, '$.command'), 'touch') AND NOT contains(text, 'exited')"""
_FAILED = r"""(regexp_matches(text, 'Command exited with code [1-9]\d*\s*$') OR regexp_matches(lower(text), '^(?:[^\n]*module not found|fatal:)'))"""
_ERRORS = rf"""
    errors AS (SELECT session_id, idx, call_id, name AS tool, text AS message, signature FROM steps2
        WHERE NOT starts_with(text, 'Found 2 occurrences')
        AND NOT (operation = 'execute' AND starts_with({_COMMAND}, 'rg ') AND (regexp_extract(text, 'code (\d+)\s*$', 1) IN ('', '1')))
        AND (is_error OR (operation = 'execute' AND {_FAILED})))"""
_RETRIED = """
    tried AS (SELECT e.session_id, e.idx, e.tool, e.message, e.signature, min({{'j': a.call_idx, 'k': a.idx, 'f': a.is_error}}) AS r
        FROM errors e LEFT JOIN steps2 a ON a.session_id = e.session_id AND a.signature = e.signature AND a.call_idx > e.idx AND a.call_idx < e.idx + 6
        GROUP BY ALL),
    retried AS (SELECT session_id, idx, tool, message, signature, r.j IS NOT NULL AS retried, coalesce(r.k > r.j AND r.k < r.j + 10 AND NOT r.f, false) AS resolved FROM tried)"""


@query(
    "tool_operations",
    "calls",
    sql=rf"""SELECT session_id, call_id, {_OP} AS operation, {_PATH} AS path, {_NAME} AS tool,
    CASE WHEN {_OP} = 'mutate' THEN 'mutates' WHEN json_extract_string(args, '$.command') IS NOT NULL OR json_extract_string(args, '$.cmd') IS NOT NULL THEN 'executes'
        WHEN {_PATH} IS NOT NULL THEN 'accesses' ELSE 'other' END AS class FROM {{calls}}""",
)
def tool_operations(calls: DataFrame) -> DataFrame:
    args, name = F.col("a"), F.col("name")
    return calls.withColumn("a", K.parsed(F.col("args"))).select(
        "session_id", "call_id", K.operation(args, name).alias("operation"), K.tool_path(args).alias("path"), K.tool_name(name).alias("tool"), K.broad_class(args).alias("class")
    )


@query("call_signatures", "calls", "results", sql=f"WITH {_STEPS} SELECT session_id, call_id, replace(signature, chr(0), '|') AS signature FROM steps2")
def call_signatures(calls: DataFrame, results: DataFrame) -> DataFrame:
    return O.tool_steps(calls, results).select("session_id", "call_id", F.replace("signature", F.lit("\u0000"), F.lit("|")).alias("signature"))


@query(
    "file_states",
    "calls",
    "results",
    sql=f"""WITH {_STEPS},
    acts AS (SELECT session_id, path, idx, CASE WHEN operation = 'mutate' AND text <> 'No changes applied' THEN 'mutate' WHEN operation = 'delete' THEN 'delete'
        WHEN operation IN ('read', 'search', 'list') THEN 'access' END AS op FROM steps2 WHERE NOT is_error AND path IS NOT NULL {_SHELL}),
    live AS (SELECT *, coalesce(max(idx) FILTER (WHERE op = 'delete') OVER (PARTITION BY session_id, path), -1) AS gone FROM acts WHERE op IS NOT NULL)
    SELECT session_id, path, count(*) FILTER (WHERE idx > gone AND op = 'mutate') AS modified_count, max(idx) FILTER (WHERE idx > gone AND op = 'mutate') AS last_modified,
        max(idx) FILTER (WHERE idx > gone AND op = 'access') AS last_read, CASE WHEN max(gone) = max(idx) THEN max(gone) END AS deleted_at FROM live GROUP BY 1, 2""",
)
def file_states(calls: DataFrame, results: DataFrame) -> DataFrame:
    return O.file_states(O.tool_steps(calls, results))


@query("error_catalog", "calls", "results", sql=f"WITH {_STEPS}, {_ERRORS} SELECT session_id, idx, tool, message FROM errors")
def error_catalog(calls: DataFrame, results: DataFrame) -> DataFrame:
    return O.error_catalog(O.tool_steps(calls, results)).select("session_id", "idx", "tool", "message")


@query("retried_errors", "calls", "results", sql=f"WITH {_STEPS}, {_ERRORS}, {_RETRIED} SELECT session_id, idx, tool, retried, resolved FROM retried")
def retried_errors(calls: DataFrame, results: DataFrame) -> DataFrame:
    steps = O.tool_steps(calls, results)
    return O.retried_errors(O.error_catalog(steps), steps).select("session_id", "idx", "tool", "retried", "resolved")


@query(
    "cached_error_reconciliation",
    "calls",
    "results",
    sql=f"""WITH {_STEPS}, {_ERRORS}
    SELECT e.session_id, e.idx, bool_or(a.call_idx IS NOT NULL) AS retried, coalesce(bool_or(NOT a.is_error), false) AS resolved
    FROM errors e LEFT JOIN steps2 a ON a.session_id = e.session_id AND a.signature = e.signature AND a.call_idx >= 60 AND a.call_idx > e.idx AND a.call_idx <= e.idx + 6
    WHERE e.idx < 60 GROUP BY 1, 2""",
)
def cached_error_reconciliation(calls: DataFrame, results: DataFrame) -> DataFrame:
    steps = O.tool_steps(calls, results)
    return O.cached_error_reconciliation(O.error_catalog(steps), steps, F.lit(60)).select("session_id", "idx", "retried", "resolved")


@query(
    "session_decisions",
    "calls",
    "results",
    "messages",
    sql="""
    SELECT c.session_id, c.idx, 'explicit' AS type, json_extract_string(args, '$.question') AS summary, r.text AS response
    FROM {calls} c JOIN {results} r ON c.session_id = r.session_id AND c.call_id = r.call_id AND r.idx BETWEEN c.idx + 1 AND c.idx + 3
    WHERE name = 'ask_user' AND json_extract_string(args, '$.question') <> ''
    UNION ALL SELECT session_id, idx, 'implicit', substr(text, 1, 200), NULL FROM {messages} WHERE role = 'user' AND regexp_matches(lower(text), 'go\\s+with\\s+|avoid\\s+|prefer\\s+')""",
)
def session_decisions(calls: DataFrame, results: DataFrame, messages: DataFrame) -> DataFrame:
    return O.decisions(calls, results, messages)


@query(
    "session_constraints",
    "messages",
    sql=r"""
    WITH l AS (SELECT session_id, idx, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {messages}
        WHERE role = 'user' AND length(text) >= 10 AND NOT starts_with(text, '/')),
    b AS (SELECT session_id, idx, line, trim(regexp_replace(raw, '^\s*[-*]\s+', '')) AS text FROM l),
    c AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)\b(?:must|need|require|has to|important)\b.*\b(?:be|use|have|include|support)\b') THEN 'requirement'
        WHEN regexp_matches(text, '(?i)\b(?:don''t|never|avoid|shouldn''t|must not|do not|no\s+(?:need|want))\b') THEN 'prohibition'
        WHEN regexp_matches(text, '(?i)\b(?:prefer|like|want|would rather|should)\b.*\b(?:use|be|have|with)\b') THEN 'preference' END AS category FROM b
        WHERE length(text) >= 10 AND NOT regexp_matches(text, '^npm error'))
    SELECT session_id, idx, substr(text, 1, 300) AS text, category, CASE category WHEN 'requirement' THEN 0.85 WHEN 'prohibition' THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence
    FROM c WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY idx, line) = 1""",
)
def session_constraints(messages: DataFrame) -> DataFrame:
    return O.constraints(messages).withColumn("confidence", F.col("confidence").cast("double"))


@query(
    "session_timeline",
    "calls",
    "results",
    "messages",
    sql=f"""WITH {_STEPS}, {_ERRORS},
    b AS (SELECT session_id, idx, 'user_request' AS event, substr(text, 1, 150) AS summary FROM {{messages}} WHERE role = 'user' AND NOT starts_with(text, '/')
        UNION ALL SELECT session_id, idx, 'error', substr(message, 1, 100) FROM errors),
    n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id, event ORDER BY idx DESC) AS back FROM b)
    SELECT session_id, idx, event, summary FROM n WHERE n <= 30 OR event = 'error' OR back <= 10""",
)
def session_timeline(calls: DataFrame, results: DataFrame, messages: DataFrame) -> DataFrame:
    return O.timeline(messages, O.error_catalog(O.tool_steps(calls, results)))


@query(
    "main_goals",
    "messages",
    sql=r"""
    SELECT session_id, arg_max(trim(substr(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^(?:(?:#{{1,6}}|[-*+]|>)\s+)+', ''), 1, 300)), idx) AS goal
    FROM {messages} WHERE role = 'user' AND trim(text) <> '' AND NOT starts_with(text, '/') AND NOT regexp_full_match(lower(trim(text)), '(?:ok|yes)[\s.!]*') GROUP BY 1""",
)
def main_goals(messages: DataFrame) -> DataFrame:
    return O.main_goal(messages)


@query(
    "open_loops",
    "messages",
    sql=r"""
    WITH l AS (SELECT session_id, idx, substr(text, 1, 120) AS summary, CASE WHEN contains(lower(text), 'todo') OR regexp_matches(lower(text), 'follow\s*up') THEN 'follow-up'
        WHEN regexp_matches(lower(text), '\bblocked\b|waiting for') THEN 'blocked' END AS type FROM {messages} WHERE role = 'user' AND length(text) >= 10 AND NOT starts_with(text, '/')),
    w AS (SELECT *, list_filter(regexp_extract_all(lower(summary), '[\pL\pN_-]{{4,}}'), lambda x: x NOT IN ('next', 'step', 'thing', 'todo', 'action', 'item', 'follow', 'still', 'need', 'have', 'gotta')) AS words
        FROM l WHERE type IS NOT NULL),
    e AS (SELECT w.session_id, w.idx, w.summary, w.type, w.words, min(m.idx) AS ends FROM w LEFT JOIN {messages} m ON m.session_id = w.session_id AND m.idx > w.idx AND m.role = 'user' AND length(m.text) >= 10
        GROUP BY ALL),
    d AS (SELECT session_id, idx, lower(text) AS said FROM {messages} WHERE role = 'assistant' AND regexp_matches(lower(text), '\b(?:done|completed?|finished|implemented|fixed|resolved|updated|added|removed|shipped)\b')
        AND NOT regexp_matches(lower(text), '\b(?:not|isn.?t|wasn.?t)\b.{{0,20}}\b(?:done|complete|finished|fixed|resolved)\b'))
    SELECT e.session_id, e.idx, e.type, e.summary, CASE WHEN max(d.idx) IS NULL THEN 'open' ELSE 'resolved' END AS status, CASE WHEN e.type = 'blocked' THEN 'high' ELSE 'normal' END AS priority
    FROM e LEFT JOIN d ON d.session_id = e.session_id AND e.type = 'follow-up' AND d.idx > e.idx AND d.idx < e.idx + 50 AND (e.ends IS NULL OR d.idx < e.ends)
        AND len(list_filter(e.words, lambda x: contains(d.said, x))) > 0 GROUP BY ALL""",
)
def open_loops(messages: DataFrame) -> DataFrame:
    return O.cue_loops(messages)


@query(
    "error_loops",
    "calls",
    "results",
    sql=f"""WITH {_STEPS}, {_ERRORS}, {_RETRIED},
    acts AS (SELECT session_id, path, idx, CASE WHEN operation = 'mutate' AND text <> 'No changes applied' THEN 'mutate' WHEN operation = 'delete' THEN 'delete' END AS op
        FROM steps2 WHERE NOT is_error AND path IS NOT NULL {_SHELL}),
    live AS (SELECT session_id, path FROM acts GROUP BY 1, 2 HAVING coalesce(max(idx) FILTER (WHERE op = 'mutate'), -1) > coalesce(max(idx) FILTER (WHERE op = 'delete'), -1)),
    parts AS (SELECT session_id, path, unnest(CASE WHEN path LIKE '%/index.ts' THEN [path, string_split(path, '/')[2] || '/index.ts']
        ELSE [path, string_split(path, '/')[2] || '/' || string_split(path, '/')[3], string_split(path, '/')[3]] END) AS needle FROM live),
    f AS (SELECT e.session_id, e.idx, string_agg(DISTINCT p.path, ',' ORDER BY p.path) AS files FROM retried e JOIN parts p ON p.session_id = e.session_id AND contains(lower(e.message), p.needle)
        WHERE NOT e.resolved GROUP BY 1, 2)
    SELECT r.session_id, r.idx, 'bugfix' AS type, substr(message, 1, 120) AS summary, 'open' AS status, CASE WHEN retried THEN 'high' ELSE 'normal' END AS priority,
        coalesce(files, '') AS files FROM retried r LEFT JOIN f ON r.session_id = f.session_id AND r.idx = f.idx WHERE NOT resolved""",
)
def error_loops(calls: DataFrame, results: DataFrame) -> DataFrame:
    steps = O.tool_steps(calls, results)
    return O.error_loops(O.retried_errors(O.error_catalog(steps), steps), O.file_states(steps))


@query(
    "tool_share",
    "messages",
    "results",
    sql="""SELECT session_id, CAST(coalesce(floor(100.0 * sum(n * tool) / nullif(sum(n), 0) + 0.5), 0) AS BIGINT) AS tool_percent FROM (
        SELECT session_id, length(text) AS n, 0 AS tool FROM {messages} UNION ALL SELECT session_id, length(text), 1 FROM {results}) GROUP BY 1""",
)
def tool_share(messages: DataFrame, results: DataFrame) -> DataFrame:
    return O.tool_share(messages, results)
