"""Named relations over the driver's tables.

Each relation is one SQL text that Spark and DuckDB read alike; ``{name}`` stands for a
table or another relation. :func:`relation` builds the Spark DataFrame, :func:`inline` the
text with everything spelled out, for an oracle.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_KEY = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

#: Shapes only: values are synthetic and carry no meaning.
RELATIONS: dict[str, str] = {
    # Dialogue turns; every 13th or so holds a cue that the text rules look for.
    "messages": """
        SELECT conv_id AS session_id, turn AS idx, role, CASE WHEN role = 'user' THEN concat(text, CASE (conv_id * 5 + turn * 3) % 13
            WHEN 0 THEN concat(chr(10), '- You must always use the shared cache.')
            WHEN 1 THEN concat(chr(10), '* never touch the lockfile here')
            WHEN 2 THEN concat(chr(10), 'I would rather have it work with tabs')
            WHEN 3 THEN concat(chr(10), 'TODO: follow up on the migration')
            WHEN 4 THEN concat(chr(10), 'This is blocked, waiting for review')
            WHEN 5 THEN concat(chr(10), 'go with the second option')
            WHEN 6 THEN concat(chr(10), 'npm error must not be listed')
            ELSE '' END)
            WHEN (conv_id + turn) % 4 = 1 THEN concat(text, ' The migration is done.') ELSE text END AS text
        FROM {conversations} WHERE role IN ('user', 'assistant')""",
    "tool_events": f"""
        SELECT session_id, idx, event_id, ts, operation, tool_name, path, value, is_error FROM (
            SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
                event_id, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'list'
                WHEN 'purchase' THEN 'mutate' ELSE 'execute' END AS operation, concat('t_', event_type) AS tool_name,
                concat('src/m', CAST({_KEY} % 3 AS STRING), '/f', CAST({_KEY} % 10 AS STRING), '.ts') AS path, value,
                (event_type = 'error' AND value > 50) AS is_error FROM {{events}}) e""",
    "steps": f"""
        SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS ord,
            event_id, event_type, value, {_KEY} AS k,
            concat('src/m', CAST({_KEY} % 3 AS STRING), CASE WHEN {_KEY} % 10 = 0 THEN '/index.ts'
                ELSE concat('/worker', CAST({_KEY} % 10 AS STRING), '.ts') END) AS path FROM {{events}}""",
    "calls": """
        SELECT session_id, 2 * ord AS idx, concat('call-', CAST(event_id AS STRING)) AS call_id,
            CASE event_type WHEN 'view' THEN 'functions.readFile' WHEN 'click' THEN 'grep-search' WHEN 'signup' THEN 'listDir'
                WHEN 'purchase' THEN CASE WHEN k % 4 = 3 THEN 'deleteFile' ELSE 'write_file' END
                ELSE CASE WHEN k % 5 = 0 THEN 'ask_user' ELSE 'bash' END END AS name,
            CASE event_type WHEN 'view' THEN concat('{{"path":"', path, '"}}')
                WHEN 'click' THEN concat('{{"path":"","pattern":"k', CAST(k % 7 AS STRING), '"}}')
                WHEN 'signup' THEN concat('{{"file_path":"', path, '"}}')
                WHEN 'purchase' THEN CASE WHEN k % 4 = 3 THEN concat('{{"filePath":"', path, '"}}')
                    ELSE concat('{{"path":"', path, '","content":""}}') END
                ELSE CASE WHEN k % 5 = 0 THEN concat('{{"question":"Keep ', path, '?"}}')
                    WHEN k % 5 = 1 THEN concat('{{"cmd":"rg k', CAST(k % 7 AS STRING), ' src"}}')
                    WHEN k % 5 = 3 THEN concat('{{"command":"touch ', path, '.bak && rm -f ', path, '"}}')
                    ELSE concat('{{"command":"  npm  test ', path, CASE WHEN k % 2 = 0 THEN ' --retry=3' ELSE '' END, '"}}') END
            END AS args
        FROM {steps}""",
    "results": """
        SELECT session_id, 2 * ord + 1 AS idx, concat('call-', CAST(event_id AS STRING)) AS call_id,
            (event_type = 'error' AND value > 80) AS is_error,
            CASE WHEN event_type = 'error' AND value > 80 THEN concat('fatal: task ', CAST(k AS STRING), ' failed in ', path)
                WHEN event_type = 'error' AND value > 40 THEN concat('module not found: ', path, chr(10), 'Command exited with code 1')
                WHEN event_type = 'error' AND value < 3 THEN 'Found 2 occurrences of edits[0]'
                WHEN event_type = 'purchase' AND value < 8 THEN 'No changes applied'
                ELSE concat('ok ', CAST(k AS STRING)) END AS text
        FROM {steps}""",
    # Whole sessions in order: user turns, calls, and results that sometimes come one call late.
    "turns": """
        SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY place, part) - 1 AS BIGINT) AS idx, role, text, call_id,
            CAST(20 + (event_id * 37) % 900 AS BIGINT) AS tokens, is_error FROM (
            SELECT session_id, CAST(ord AS DOUBLE) AS place, 0 AS part, event_id, 'user' AS role, concat('please look at ', path) AS text,
                CAST(NULL AS STRING) AS call_id, false AS is_error FROM {steps} WHERE ord % 5 = 0
            UNION ALL SELECT session_id, CAST(ord AS DOUBLE), 1, event_id, 'assistant', concat('calling ', event_type), concat('call-', CAST(event_id AS STRING)), false FROM {steps}
            UNION ALL SELECT session_id, ord + CASE WHEN k % 3 = 0 THEN 1.5 ELSE 0 END, 2, event_id, 'toolResult', concat('result ', CAST(k AS STRING)),
                concat('call-', CAST(event_id AS STRING)), event_type = 'error' AND value > 80 FROM {steps}) t""",
    # Turns with what boundaries look at: tool names, touched files and anchors.
    "window_turns": """
        SELECT t.session_id, t.idx, t.role, t.call_id, t.tokens, replace(c.name, 'functions.', '') AS tool_name,
            CASE WHEN t.role = 'assistant' AND c.args LIKE '%ath":"src%' THEN regexp_extract(c.args, '"(src/[^"]*)"', 1) ELSE CAST(NULL AS STRING) END AS path,
            (t.role = 'toolResult' AND t.text = 'result 7') AS anchor
        FROM (SELECT session_id, idx, role, CASE WHEN role = 'toolResult' AND text = 'result 3' THEN 'gone' ELSE call_id END AS call_id, tokens, text,
            call_id AS made FROM {turns}) t
        LEFT JOIN (SELECT session_id, call_id, args, CASE name WHEN 'listDir' THEN 'mcp/list.dir' ELSE name END AS name FROM {calls}) c
            ON c.session_id = t.session_id AND c.call_id = t.made""",
    "clipped": "SELECT session_id, idx, CASE WHEN is_error THEN concat(text, '…✂', CAST(length(text) AS STRING)) ELSE text END AS text FROM {results}",
    # Notes of a state, some of them noise.
    "state_notes": """
        SELECT session_id, idx, CASE WHEN text LIKE 'ok%' THEN 'loop' ELSE 'unresolved' END AS kind, concat('Unresolved error: ', text) AS text FROM {results}
        UNION ALL SELECT session_id, ord, CASE k % 3 WHEN 0 THEN 'context' ELSE 'goal' END, concat(path, ':', CAST(k AS STRING), ': match') FROM {steps}
        UNION ALL SELECT session_id, ord, 'constraint', CASE WHEN k % 2 = 0 THEN 'npm error must not fail' ELSE 'never fail' END FROM {steps}""",
    "file_mentions": """
        SELECT DISTINCT session_id, path AS ref FROM {steps}
        UNION SELECT session_id, concat('./', path) FROM {steps} UNION SELECT session_id, regexp_extract(path, '[^/]*$', 0) FROM {steps}
        UNION SELECT session_id, substr(path, 2) FROM {steps} UNION SELECT session_id, concat(path, 'x') FROM {steps}""",
    "noted_loops": """
        SELECT session_id, ord AS idx, CASE WHEN event_type IN ('click', 'error') THEN 'blocked' ELSE 'follow-up' END AS type,
            concat('todo:  ', CASE WHEN k % 2 = 0 THEN path ELSE regexp_extract(path, '[^/]*$', 0) END) AS text FROM {steps}""",
    # Details as older runs left them: some broken, some with fields of other types.
    "details": """
        SELECT o_orderkey AS run_key, CASE o_orderkey % 9 WHEN 1 THEN 'broken {{' WHEN 2 THEN '[1]' WHEN 3 THEN '{{"modifiedFiles":["a",1],"readFiles":[],"topics":[]}}'
            ELSE concat('{{"modifiedFiles":["a.ts","b.ts","c.ts"],"readFiles":[],"topics":["x"],"method":"', CASE o_orderkey % 4 WHEN 0 THEN 'eesv' WHEN 1 THEN 'odd' ELSE 'heuristic' END,
                '","profile":"', CASE o_orderstatus WHEN 'P' THEN 'none' ELSE 'light' END, '","totalMessages":', CAST(o_orderkey % 50 - 5 AS STRING),
                CASE WHEN o_orderkey % 5 = 0 THEN ',"qualityScore":"high"' ELSE ',"qualityScore":87.5' END, CASE WHEN o_orderkey % 7 = 0 THEN ',"verified":1' ELSE ',"verified":true' END,
                CASE WHEN o_orderkey % 11 = 0 THEN ',"plannedYield":1.5}}' ELSE ',"plannedYield":0.5}}' END) END AS text FROM {orders}""",
    "evidence": """
        SELECT session_id AS doc_id, CASE side WHEN 'current' THEN 0 ELSE 1 END AS side, kind, ord, text, CAST(0.5 + (ord % 5) / 10.0 AS DOUBLE) AS confidence, (ord % 3 <> 0) AS explicit
        FROM {state_items}""",
    "asked": """
        SELECT CASE c_custkey % 4 WHEN 0 THEN 'maxCalls' WHEN 1 THEN 'maxInputTokens' WHEN 2 THEN 'maxLatencyMs' ELSE 'other' END AS name,
            CASE WHEN c_custkey % 13 = 0 THEN ' ' WHEN c_custkey % 17 = 0 THEN 'many' WHEN c_custkey % 19 = 0 THEN CAST(NULL AS STRING)
                WHEN c_custkey % 7 = 0 THEN concat(CAST(c_custkey * 60 AS STRING), '.5') ELSE CAST(c_custkey * CASE c_custkey % 4 WHEN 0 THEN 1 ELSE 900 END AS STRING) END AS value FROM {customer}""",
    "settings": """
        SELECT CASE c_custkey % 6 WHEN 0 THEN 'autoTriggerTimeoutMs' WHEN 1 THEN 'maxLlmCalls' WHEN 2 THEN 'codexMaxCallMs' WHEN 3 THEN 'maxLatencyMs' WHEN 4 THEN 'minContextPercent' ELSE 'backup' END AS name,
            CASE WHEN c_custkey % 13 = 0 THEN '0' WHEN c_custkey % 17 = 0 THEN '"50"' WHEN c_custkey % 19 = 0 THEN 'true' WHEN c_custkey % 7 = 0 THEN concat(CAST(c_custkey AS STRING), '.5')
                ELSE CAST(c_custkey * CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 100 END AS STRING) END AS value FROM {customer}""",
    "deltas": """
        SELECT session_id AS call_id, ord, CASE event_type WHEN 'view' THEN 'text_delta' WHEN 'click' THEN 'thinking_delta' WHEN 'purchase' THEN 'toolcall_delta' ELSE 'ping' END AS type,
            CAST(floor(value) AS BIGINT) AS chars, ord * 50 AS at_ms, CAST(100 + session_id % 5 * 200 AS BIGINT) AS max_tokens, CAST(1000 + session_id % 3 * 2000 AS BIGINT) AS deadline_ms FROM {steps}""",
    # A branch as stored: messages, with the marks of compactions between them.
    "branch": """
        SELECT session_id, idx * 2 AS ord, 'message' AS type, role, CASE WHEN anchor THEN 'context' ELSE tool_name END AS tool_name, anchor AS anchored
        FROM {window_turns}
        UNION ALL SELECT session_id, idx * 2 - 1, 'compaction', CAST(NULL AS STRING), CAST(NULL AS STRING), false FROM {window_turns} WHERE role = 'user'""",
    # Messages as logged: content is a JSON string or an array of blocks.
    "raw_messages": """
        SELECT session_id, idx, 'assistant' AS role, CASE WHEN idx % 18 = 4 THEN concat('[{{"type":"toolCall","id":"', call_id,
                '","name":"multi_tool_use.parallel","arguments":{{"tool_uses":[{{"recipient_name":"functions.', name, '","parameters":', args,
                '}},{{"recipient_name":"extra","id":"', call_id, '-x","parameters":{{}}}}]}}}}]')
            ELSE concat('["on ",{{"type":"text","text":"it"}},{{"type":"toolCall","id":"', call_id, '","name":"', name, '","arguments":', args, '}}]') END AS content
        FROM {calls}
        UNION ALL SELECT session_id, idx, 'toolResult', concat('"', replace(text, chr(10), concat(chr(92), 'n')), '"') FROM {results}
        UNION ALL SELECT session_id, 100000 + ord, 'user', CASE k % 4 WHEN 0 THEN concat('[{{"type":"image_url","url":"http://x/', CAST(k AS STRING), '.png"}}]')
            WHEN 1 THEN concat('[{{"type":"document","path":"', path, '","mime_type":"application/pdf","size":', CAST(k AS STRING), '}}]')
            WHEN 2 THEN '[{{"type":"odd"}}]' ELSE '{{"not":"content"}}' END FROM {steps} WHERE ord % 7 = 0""",
    "llm_calls": f"""
        SELECT event_id, CASE {_KEY} % 9 WHEN 0 THEN 'probe' WHEN 1 THEN 'explore' WHEN 2 THEN 'explore-loop' WHEN 3 THEN 'explore-retry'
            WHEN 4 THEN 'explore-direct' WHEN 5 THEN 'single-pass' WHEN 6 THEN 'batch' WHEN 7 THEN 'assemble' ELSE 'patch' END AS phase,
            concat('p', CAST(user_id % 4 AS STRING)) AS provider, concat('m', CAST(user_id % 7 AS STRING)) AS model,
            CAST(floor(value * 100) AS BIGINT) AS latency_ms, CAST(event_id % 5000 AS BIGINT) AS input_tokens,
            CAST(event_id % 800 AS BIGINT) AS output_tokens, CAST(event_id % 300 AS BIGINT) AS cache_hit_tokens,
            CAST(event_id % 40 AS BIGINT) AS cache_write_tokens, (event_type <> 'error') AS success FROM {{events}}""",
    "runs": """
        SELECT o_orderkey AS run_key, concat('run-', CAST(100000 + o_orderkey AS STRING)) AS run_id, o_custkey AS session_id, o_orderdate AS ts,
            CASE WHEN o_orderkey % 10 = 0 THEN CAST(NULL AS INT) ELSE 2 END AS metrics_schema_version,
            CASE WHEN o_orderkey % 50 = 7 THEN 'bad version!' ELSE '9.4.0' END AS version,
            CASE WHEN o_orderkey % 5 = 0 THEN 'canary' ELSE 'stable' END AS release_channel,
            CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'success' WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'error'
                ELSE 'dry-run' END ELSE 'timeout' END AS status,
            concat('p', substr(o_orderpriority, 1, 1)) AS provider,
            concat('p', substr(o_orderpriority, 1, 1), '/m', CAST(o_custkey % 3 AS STRING)) AS model,
            CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(70 + o_orderkey % 31 AS DOUBLE) END AS verification_score,
            CASE WHEN o_orderkey % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(60 + o_orderkey % 29 AS DOUBLE) END AS initial_score,
            CAST(o_orderkey % 4 AS BIGINT) AS gaps, CAST(o_orderkey % 3 AS BIGINT) AS patches,
            CASE WHEN o_orderkey % 19 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice / 10) AS BIGINT) END AS duration_ms,
            CAST(floor(o_totalprice / 40) AS BIGINT) AS avg_latency, CAST(1 + o_orderkey % 6 AS BIGINT) AS total_calls,
            CAST(o_orderkey % 9000 AS BIGINT) AS total_input, CAST(o_orderkey % 700 AS BIGINT) AS total_output,
            CAST(o_orderkey % 1100 AS BIGINT) AS cache_hit, CAST(o_orderkey % 90 AS BIGINT) AS cache_write,
            CAST(o_orderkey % 101 AS INT) AS context_percent, CAST(o_custkey % 101 AS INT) AS tool_percent,
            CASE WHEN o_orderkey % 11 = 0 THEN 'heuristic' ELSE 'staged' END AS method,
            CASE o_orderkey % 7 WHEN 1 THEN 'light' WHEN 2 THEN 'balanced' ELSE 'aggressive' END AS profile,
            CASE o_orderkey % 23 WHEN 1 THEN 'rate-limit' WHEN 2 THEN 'provider' WHEN 3 THEN 'made-up' ELSE CAST(NULL AS STRING) END AS failure_kind
        FROM {orders}""",
    "damage": """
        SELECT concat('run-', CAST(100000 + l_orderkey AS STRING)) AS run_id,
            CAST(CASE WHEN l_returnflag = 'R' THEN l_linenumber * 20 ELSE 0 END AS DOUBLE) AS damage_score FROM {lineitem}""",
    "nodes": """
        SELECT concat('f-', CAST(p_partkey AS STRING)) AS node_id, 'file' AS kind, p_name AS title, concat(p_brand, ' ', p_type) AS content,
            CAST(1.0 AS DOUBLE) AS confidence FROM {part}
        UNION ALL SELECT concat('d-', CAST(o_orderkey AS STRING)), 'decision', o_orderpriority, concat(o_orderstatus, ' ', o_orderpriority),
            CAST(0.85 AS DOUBLE) FROM {orders}""",
    "edges": """
        SELECT concat('d-', CAST(l_orderkey AS STRING)) AS from_id, concat('f-', CAST(l_partkey AS STRING)) AS to_id, max(l_discount) AS weight
        FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "lineage": """
        SELECT o_custkey AS session_id, o_orderkey AS branch_id,
            CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS lineage_rank,
            (o_orderkey % 3 = 0) AS has_snapshot FROM {orders}""",
    # Versions of facts along a branch: the same key is restated, sometimes as resolved.
    "facts": """
        SELECT session_id, branch_id, lineage_rank, CASE WHEN branch_id % 2 = 0 THEN 'decision' ELSE 'constraint' END AS kind,
            concat('  Key ', CAST(branch_id % 6 AS STRING), '  ') AS text,
            CASE WHEN branch_id % 5 = 0 THEN 'resolved' ELSE 'active' END AS status, lineage_rank * 10 AS updated_at
        FROM {lineage}""",
    # Two snapshots per session, for merges and deltas.
    "state_items": """
        SELECT session_id, CASE WHEN lineage_rank % 2 = 0 THEN 'previous' ELSE 'current' END AS side,
            CASE branch_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'constraint' WHEN 2 THEN 'unresolved' ELSE 'resolved' END AS kind,
            lineage_rank AS ord, concat('Item  ', CAST(branch_id % 9 AS STRING)) AS text,
            CASE WHEN branch_id % 3 = 0 THEN 'high' ELSE 'normal' END AS priority FROM {lineage}""",
}
_TABLES = ("customer", "orders", "lineitem", "part", "events", "documents", "conversations", "supplier", "nation", "region")


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation (or driver table) ``name`` as a lazy DataFrame."""
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = RELATIONS[name]
    needed = {n: relation(spark, sf_dir, n) for n in _names(text)}
    return spark.sql(text, **needed)


@cache
def inline(text: str) -> str:
    """``text`` with ``{name}`` of relations spelled out, for another SQL engine."""
    filled = {n: f"({inline(RELATIONS[n])})" if n in RELATIONS else n for n in _names(text)}
    return text.format(**filled)


def oracle(text: str, **common: str) -> str:
    """An oracle query: ``{name}`` of relations become common table expressions, in order."""
    seen: dict[str, str] = {}

    def need(name: str) -> None:
        if name in RELATIONS and name not in seen:
            for n in _names(RELATIONS[name]):
                need(n)
            seen[name] = RELATIONS[name].format(**{n: n for n in _names(RELATIONS[name])})

    for n in _names(text):
        need(n)
    body = text.format(**{n: n for n in _names(text)}, **common)
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in seen.items())
    if not ctes:
        return body
    found = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if found:
        return f"WITH {found[1] or ''}{ctes},\n{body[found.end():]}"
    return f"WITH {ctes}\n{body}"
