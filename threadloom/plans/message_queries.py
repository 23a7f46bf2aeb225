"""Queries of message flattening, exploration, damage, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import facts as O
from threadloom.operators import messages as M
from threadloom.operators import summary as Y
from threadloom.plans.fact_queries import _STEPS
from threadloom.plans.registry import query

_TEXT = "CASE role WHEN 'assistant' THEN CASE WHEN idx % 18 = 4 THEN '' ELSE 'on it' END WHEN 'toolResult' THEN json_extract_string(concat('[', content, ']'), '$[0]') ELSE '' END"


@query("flat_texts", "raw_messages", sql=f"SELECT session_id, idx, role, {_TEXT} AS text FROM {{raw_messages}}")
def flat_texts(messages: DataFrame) -> DataFrame:
    return messages.select("session_id", "idx", "role", M.flat_text(F.col("content")).alias("text"))


_CALLS = """
    SELECT session_id, idx, CASE WHEN idx % 18 = 4 THEN concat(call_id, '_0') ELSE call_id END AS call_id, CASE WHEN idx % 18 = 4 THEN replace(name, 'functions.', '') ELSE name END AS name FROM {calls}
    UNION ALL SELECT session_id, idx, concat(call_id, '-x'), 'extra' FROM {calls} WHERE idx % 18 = 4"""


@query("flat_tool_calls", "raw_messages", sql=_CALLS.replace("replace(name, 'functions.', '')", "regexp_replace(concat('functions.', name), '^functions[.]', '')"))
def flat_tool_calls(messages: DataFrame) -> DataFrame:
    return M.tool_calls(messages).select("session_id", "idx", "call_id", "name")


@query(
    "media_attachments",
    "raw_messages",
    sql="""SELECT session_id, 100000 + ord AS idx, CASE k % 4 WHEN 0 THEN 'image' ELSE 'file' END AS kind, CASE WHEN k % 4 = 1 THEN 'application/pdf' END AS mime, CAST(NULL AS VARCHAR) AS name,
    CASE WHEN k % 4 = 1 THEN CAST(k AS BIGINT) END AS bytes, CASE k % 4 WHEN 0 THEN 'url' ELSE 'path' END AS source FROM {steps} WHERE ord % 7 = 0 AND k % 4 < 2""",
)
def media_attachments(messages: DataFrame) -> DataFrame:
    return M.media(messages)


@query(
    "rendered_messages",
    "messages",
    "calls",
    sql="""
    WITH c AS (SELECT session_id, idx, string_agg(concat(name, ' ', args), '; ' ORDER BY call_id) AS calls FROM {calls} GROUP BY 1, 2)
    SELECT m.session_id, m.idx, concat('[', role, '] ', substr(text, 1, 60)) || CASE WHEN calls IS NULL THEN '' ELSE chr(10) || '[tool_calls] ' || substr(calls, 1, 60) END AS line
    FROM {messages} m LEFT JOIN c ON c.session_id = m.session_id AND c.idx = m.idx""",
)
def rendered_messages(messages: DataFrame, calls: DataFrame) -> DataFrame:
    return M.rendered(messages, calls, 60)


@query(
    "recovered_messages",
    "messages",
    sql="""
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY session_id, idx ORDER BY line) AS n FROM (SELECT *, idx AS line FROM {messages}))
    SELECT session_id, idx, concat('e', idx) AS entry_id, role, CASE WHEN idx % 3 = 1 AND idx % 2 = 1 THEN text WHEN idx % 3 = 1 THEN concat(substr(text, 1, 20), '…✂', length(text)) ELSE text END AS text,
        idx % 3 = 1 AND idx % 2 = 1 AS recovered FROM l""",
)
def recovered_messages(messages: DataFrame) -> DataFrame:
    entry = F.concat(F.lit("e"), F.col("idx").cast("string"))
    short = F.concat(F.substring("text", 1, 20), F.lit("…✂"), F.length("text").cast("string"))
    log = messages.where("idx % 2 = 1").select("session_id", entry.alias("entry_id"), "text")
    branch = messages.select("session_id", "idx", entry.alias("entry_id"), "role", F.when(F.col("idx") % 3 == 1, short).otherwise(F.col("text")).alias("text"))
    return M.recovered(branch, log)


@query(
    "wanted_log_entries",
    "messages",
    sql="""
    SELECT session_id, concat('e', CAST(idx // 2 AS BIGINT)) AS entry_id, role, CASE WHEN idx % 4 = 0 THEN TIMESTAMP '2024-05-01 10:00:00' END AS ts FROM {messages}
    WHERE idx // 2 < 3 AND role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY session_id, idx // 2 ORDER BY idx) = 1""",
)
def wanted_log_entries(messages: DataFrame) -> DataFrame:
    entry = F.concat(F.lit("e"), F.expr("idx div 2").cast("string"))
    stamp = F.when(F.col("idx") % 4 == 0, "2024-05-01T10:00:00").otherwise("not a date")
    log = messages.select("session_id", F.col("idx").alias("line"), entry.alias("entry_id"), "role", stamp.alias("ts"))
    ids = log.select("session_id", "entry_id").distinct().where("entry_id IN ('e0', 'e1', 'e2')")
    return M.wanted(log, ids).select("session_id", "entry_id", "role", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("explored_range", "messages", sql="SELECT session_id, idx, role, substr(text, 1, 150) AS preview FROM {messages} WHERE idx >= 2 AND idx < 5")
def explored_range(messages: DataFrame) -> DataFrame:
    return M.message_range(messages, 2, 5)


@query(
    "explored_search",
    "messages",
    sql="SELECT session_id, idx, role FROM {messages} WHERE contains(lower(text), 'the') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY idx) <= 2",
)
def explored_search(messages: DataFrame) -> DataFrame:
    return M.search(messages, "The", 2)


@query(
    "explored_recent_users",
    "messages",
    sql="SELECT session_id, idx, text FROM {messages} WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) <= 2",
)
def explored_recent_users(messages: DataFrame) -> DataFrame:
    return M.recent_user_messages(messages, 2)


@query(
    "explored_error_chains",
    "turns",
    sql="""SELECT a.session_id, e.idx AS centre, a.idx, a.role, substr(a.text, 1, 300) AS text FROM {turns} a JOIN {turns} e ON a.session_id = e.session_id AND e.is_error AND a.idx BETWEEN e.idx - 8 AND e.idx + 8""",
)
def explored_error_chains(turns: DataFrame) -> DataFrame:
    return M.around(turns, turns.where("is_error").select("session_id", F.col("idx").alias("centre")))


@query(
    "explored_file_changes",
    "calls",
    "results",
    sql=f"WITH {_STEPS} SELECT session_id, idx, path FROM steps2 WHERE operation = 'mutate' AND contains(path, 'm1/') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY idx) <= 15",
)
def explored_file_changes(calls: DataFrame, results: DataFrame) -> DataFrame:
    return M.file_changes(O.tool_steps(calls, results), "M1/")


_AFTER = """SELECT user_id AS session_id, event_id AS idx, 'user' AS role, CASE event_id % 29 WHEN 0 THEN concat('You forgot item ', CAST(event_id % 7 AS STRING)) WHEN 1 THEN 'what about Worker3 now' ELSE 'fine' END AS text FROM {events}"""


@query(
    "damage_signals",
    "events",
    "calls",
    "results",
    sql=f"""WITH {_STEPS}, a AS ({_AFTER}),
    r AS (SELECT session_id, path, count(*) AS n FROM steps2 WHERE operation IN ('read', 'search', 'list') AND path IS NOT NULL AND path LIKE '%worker%' AND idx > 60 GROUP BY 1, 2)
    SELECT session_id, 're-read' AS type, 'medium' AS severity, path AS detail FROM r WHERE n >= 2
    UNION SELECT session_id, 'user-complaint', 'high', lower(text) FROM a WHERE text LIKE 'You forgot%'
    UNION SELECT session_id, 're-question', 'low', 'Worker3 pool' FROM a WHERE text LIKE '%Worker3%'""",
)
def damage_signals(events: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    return _damage(events, calls, results)


def _damage(events: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    after = events.sparkSession.sql(_AFTER, events=events)
    steps = O.tool_steps(calls, results)
    compacted = steps.where("path LIKE '%worker%'").select("session_id", "path").distinct()
    topics = after.select("session_id").distinct().withColumns({"topic": F.lit("Worker3 pool"), "words": F.array(F.lit("Worker3"))})
    return M.damage_signals(after, steps.where("idx > 60"), compacted, topics)


@query(
    "damage_scores",
    "events",
    "calls",
    "results",
    sql=f"""WITH {_STEPS}, a AS ({_AFTER}),
    r AS (SELECT session_id, path, count(*) AS n FROM steps2 WHERE operation IN ('read', 'search', 'list') AND path IS NOT NULL AND path LIKE '%worker%' AND idx > 60 GROUP BY 1, 2),
    s AS (SELECT session_id, 're-read' AS type, 10 AS points, path AS detail FROM r WHERE n >= 2 UNION SELECT session_id, 'user-complaint', 25, lower(text) FROM a WHERE text LIKE 'You forgot%'
        UNION SELECT session_id, 're-question', 0, 'Worker3 pool' FROM a WHERE text LIKE '%Worker3%')
    SELECT session_id, CAST(least(100, sum(points)) AS BIGINT) AS score, count(*) FILTER (WHERE type = 're-read') AS re_reads, count(*) FILTER (WHERE type = 'user-complaint') AS complaints FROM s GROUP BY 1""",
)
def damage_scores(events: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    return M.damage_scores(_damage(events, calls, results))


# ---------------------------------------------------------------- summaries

_FACTS = """
    SELECT session_id AS doc_id, CASE kind WHEN 'decision' THEN 'decisions' WHEN 'constraint' THEN 'constraints' WHEN 'unresolved' THEN 'critical-context' ELSE 'progress' END AS kind, ord, text
    FROM {state_items} UNION ALL SELECT DISTINCT session_id, 'goal', CAST(0 AS BIGINT), concat('Finish job ', CAST(session_id AS STRING)) FROM {state_items} WHERE session_id % 4 > 0
    UNION ALL SELECT DISTINCT session_id, 'files-modified', CAST(1 AS BIGINT), concat('src/Job', CAST(session_id % 9 AS STRING), '.ts') FROM {state_items} WHERE session_id % 3 > 0
    UNION ALL SELECT DISTINCT session_id, 'progress', CAST(999 AS BIGINT), 'all tests passed' FROM {state_items} WHERE session_id % 5 = 0"""
_PLACE = "CASE kind WHEN 'goal' THEN 1 WHEN 'constraints' THEN 2 WHEN 'progress' THEN 3 WHEN 'decisions' THEN 4 WHEN 'files-modified' THEN 5 ELSE 9 END"
_HEAD = "CASE kind WHEN 'goal' THEN '## Goal' WHEN 'constraints' THEN '## Constraints & Preferences' WHEN 'progress' THEN '## Progress' WHEN 'decisions' THEN '## Key Decisions' WHEN 'files-modified' THEN '## Files Modified' ELSE '## Critical Context' END"
_SUMMARY = f"""
    facts0 AS ({_FACTS}),
    parts AS (SELECT doc_id, kind, {_PLACE} AS place, {_HEAD} AS heading, trim(string_agg(CASE kind WHEN 'goal' THEN text ELSE '- ' || text END, chr(10) ORDER BY ord, text), chr(10) || ' ') AS body FROM facts0 GROUP BY 1, 2, 3, 4),
    summaries AS (SELECT doc_id, string_agg(heading || chr(10) || body, chr(10) || chr(10) ORDER BY place) || chr(10) AS summary FROM parts GROUP BY 1)"""


def _summaries(items: DataFrame) -> DataFrame:
    return Y.assembled(items.sparkSession.sql(_FACTS, state_items=items))


@query("assembled_summaries", "state_items", sql=f"WITH {_SUMMARY} SELECT * FROM summaries")
def assembled_summaries(items: DataFrame) -> DataFrame:
    return _summaries(items)


@query("summary_sections", "state_items", sql=f"WITH {_SUMMARY} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) AS ord, kind, heading, body FROM parts")
def summary_sections(items: DataFrame) -> DataFrame:
    return Y.sections(_summaries(items)).withColumn("ord", F.col("ord").cast("long"))


_GAPS = f"""{_SUMMARY},
    required AS (SELECT DISTINCT doc_id, 'src/job' || CAST(doc_id % 9 AS VARCHAR) || '.ts' AS path FROM parts),
    gaps AS (SELECT s.doc_id, 'missing-section' AS kind, r.k AS detail, r.p AS penalty FROM summaries s, (VALUES ('goal', 5), ('progress', 5), ('critical-context', 3)) r(k, p)
            WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = s.doc_id AND p.kind = r.k)
        UNION ALL SELECT doc_id, 'missing-file', path, 5 FROM required r WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, 'missing-error', 'cannot open the socket', 5 FROM summaries WHERE doc_id % 7 = 0
        UNION ALL SELECT doc_id, 'fabricated-file', 'src/Job' || CAST(doc_id % 9 AS VARCHAR) || '.ts', 4 FROM summaries WHERE doc_id % 3 > 0 AND doc_id % 9 = 8
        UNION ALL SELECT doc_id, 'missing-open-loops', '1', 5 FROM summaries WHERE doc_id % 11 = 0
        UNION ALL SELECT doc_id, 'unsupported-claim', 'all tests passed', 20 FROM summaries WHERE doc_id % 5 = 0 AND doc_id % 10 = 0)"""


def _gaps(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = _summaries(items)
    parts = Y.sections(made)
    ids = made.select("doc_id")
    name = F.concat(F.lit("src/job"), (F.col("doc_id") % 9).cast("string"), F.lit(".ts"))
    required = ids.select("doc_id", F.lit("files-modified").alias("kind"), name.alias("path"))
    errors = ids.where("doc_id % 7 = 0").select("doc_id", F.lit("cannot open the socket").alias("message"), F.lit(False).alias("resolved"))
    known = required.where("doc_id % 9 <> 8").select("doc_id", F.concat(F.lit("/w/"), "path").alias("path"))
    known = known.unionByName(ids.select("doc_id", F.lit("/w/other.ts").alias("path")))
    evidence = ids.where("doc_id % 10 <> 0").select("doc_id", F.lit("bash npm test").alias("tool"), F.lit("execute").alias("operation"), F.lit("12 tests passed").alias("result"))
    rows = [
        Y.missing_sections(made, parts),
        Y.missing_paths(parts, required),
        Y.missing_errors(made, errors),
        Y.fabricated_files(made, known),
        Y.missing_open_loops(made, parts, ids.where("doc_id % 11 = 0")),
        Y.unsupported_claims(Y.outcome_claims(made), evidence),
    ]
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    return made, parts, found


@query("verification_gaps", "state_items", sql=f"WITH {_GAPS} SELECT doc_id, kind, detail, CAST(penalty AS INT) AS penalty FROM gaps")
def verification_gaps(items: DataFrame) -> DataFrame:
    return _gaps(items)[2]


@query(
    "verification_scores",
    "state_items",
    sql=f"""WITH {_GAPS}, t AS (SELECT doc_id, count(*) AS n, sum(penalty) AS p FROM gaps GROUP BY 1)
    SELECT s.doc_id, coalesce(n, 0) AS gaps, CAST(greatest(0, 100 - coalesce(p, 0)) AS BIGINT) AS score, coalesce(n, 0) = 0 AND 100 - coalesce(p, 0) >= 85 AS ok FROM summaries s LEFT JOIN t ON s.doc_id = t.doc_id""",
)
def verification_scores(items: DataFrame) -> DataFrame:
    made, _, gaps = _gaps(items)
    return Y.scores(made, gaps)


@query(
    "verification_messages",
    "state_items",
    sql=f"""WITH {_GAPS}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY penalty DESC, kind, detail) AS n FROM gaps)
    SELECT doc_id, string_agg(concat(replace(kind, '-', ' '), ': ', detail), '; ' ORDER BY n) AS message FROM t WHERE n <= 3 GROUP BY 1""",
)
def verification_messages(items: DataFrame) -> DataFrame:
    return Y.failure_message(_gaps(items)[2])


@query("repaired_summaries", "state_items")
def repaired_summaries(items: DataFrame) -> DataFrame:
    """One round of repair and the score it then has."""
    made, parts, gaps = _gaps(items)
    fixed = Y.repaired(made, parts, gaps)
    again = Y.missing_sections(fixed, Y.sections(fixed))
    return Y.scores(fixed, again).withColumn("verified", F.col("ok")).drop("ok")


@query(
    "outcome_claims",
    "state_items",
    sql=f"WITH {_SUMMARY} SELECT doc_id, 'all tests passed' AS claim, 'test' AS category FROM summaries WHERE doc_id % 5 = 0",
)
def outcome_claims(items: DataFrame) -> DataFrame:
    return Y.outcome_claims(_summaries(items))
