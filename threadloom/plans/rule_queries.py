"""Queries of the smaller rules: noise, grounding, details, evidence, settings, caches, streams, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import jsons as J
from threadloom.operators import facts as O
from threadloom.operators import graph as G
from threadloom.operators import llm_seam as M
from threadloom.operators import records as Q
from threadloom.operators import reduction as R
from threadloom.operators import state as S
from threadloom.operators import summary as Y
from threadloom.plans.message_queries import _SUMMARY, _summaries
from threadloom.plans.registry import query
from threadloom.plans.text_queries import _TOKENS
from threadloom.sources.logs import remediation_hints

# ---------------------------------------------------------------- noise and grounding


@query("truncated_sessions", "clipped", sql="SELECT session_id, bool_or(regexp_matches(text, '…✂[0-9]+$')) AS truncated FROM {clipped} GROUP BY 1")
def truncated_sessions(rows: DataFrame) -> DataFrame:
    return Q.any_truncated(rows)


@query(
    "sanitised_state",
    "state_notes",
    sql=r"""SELECT * FROM {state_notes} WHERE NOT (kind = 'constraint' AND regexp_matches(text, '^npm (error|warn)'))
    AND NOT (kind IN ('unresolved', 'loop', 'context') AND (regexp_matches(text, '^[^\s:][^:\n]*:[0-9]+:') OR regexp_matches(regexp_replace(text, '^Unresolved error: ', ''), '^Found [0-9]+ occurrences of edits')))""",
)
def sanitised_state(notes: DataFrame) -> DataFrame:
    return Q.sanitised_state(notes)


@query(
    "grounded_references",
    "file_mentions",
    "turns",
    sql=r"""WITH t AS (SELECT session_id, string_agg(lower(text), chr(10)) AS said FROM {turns} GROUP BY 1)
    SELECT m.session_id, ref, regexp_matches(said, '(^|[^a-z0-9_.-])' || replace(lower(ltrim(ref, './')), '.', '\.') || '($|[^a-z0-9_.-])') AS grounded FROM {file_mentions} m JOIN t USING (session_id)""",
)
def grounded_references(refs: DataFrame, turns: DataFrame) -> DataFrame:
    return Q.grounded(refs, turns)


@query(
    "first_needle_files",
    "results",
    "steps",
    sql="""WITH f AS (SELECT session_id, min(ord) AS ord, path FROM {steps} WHERE event_type = 'purchase' GROUP BY 1, 3)
    SELECT r.session_id, r.idx, arg_min(path, ord) AS path FROM {results} r JOIN f ON f.session_id = r.session_id AND contains(lower(r.text), path) WHERE is_error GROUP BY 1, 2""",
)
def first_needle_files(results: DataFrame, steps: DataFrame) -> DataFrame:
    needles = steps.where("event_type = 'purchase'").groupBy("session_id", "path").agg(F.min("ord").alias("ord")).withColumn("needle", F.col("path"))
    return Q.first_needle_file(results.where("is_error").withColumnRenamed("text", "message"), needles)


@query(
    "loops_without_restatements",
    "noted_loops",
    sql="""WITH RECURSIVE o AS (SELECT session_id, idx, type, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k,
        row_number() OVER (PARTITION BY session_id ORDER BY CASE type WHEN 'follow-up' THEN 0 ELSE 1 END, idx) AS i FROM {noted_loops}),
    f AS (SELECT session_id, 0::BIGINT AS i, []::STRUCT(idx BIGINT, type VARCHAR, text VARCHAR, k VARCHAR)[] AS kept FROM o WHERE i = 1
        UNION ALL SELECT f.session_id, o.i, CASE WHEN len(list_filter(kept, lambda x: abs(x.idx - o.idx) < 5 AND (contains(x.k, o.k) OR contains(o.k, x.k)))) > 0 THEN kept
            ELSE list_append(kept, {{'idx': o.idx, 'type': o.type, 'text': o.text, 'k': o.k}}) END FROM f JOIN o ON o.session_id = f.session_id AND o.i = f.i + 1),
    l AS (SELECT session_id, arg_max(kept, i) AS kept FROM f GROUP BY 1), u AS (SELECT session_id, unnest(kept) AS x FROM l)
    SELECT session_id, x.idx AS idx, x.type AS type, x.text AS text FROM u""",
)
def loops_without_restatements(loops: DataFrame) -> DataFrame:
    return Q.without_restated(loops)


# ---------------------------------------------------------------- details and evidence

_KINDS = """json_type(d, '$.modifiedFiles') = 'ARRAY' AND json_type(d, '$.readFiles') = 'ARRAY' AND json_type(d, '$.topics') = 'ARRAY'
    AND coalesce(list_bool_and(list_transform(CAST(json_extract(d, '$.modifiedFiles') AS JSON[]), lambda x: json_type(x) = 'VARCHAR')), true)"""


@query(
    "run_details",
    "details",
    sql=f"""WITH d AS (SELECT run_key, CASE WHEN json_valid(text) THEN text ELSE '{{{{}}}}' END AS d FROM {{details}}),
    k AS (SELECT *, {_KINDS} AS lists, json_extract_string(d, '$.method') AS method, json_extract_string(d, '$.profile') AS profile,
        json_type(d, '$.totalMessages') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract(d, '$.totalMessages') AS DOUBLE) >= 0 AS counted,
        json_type(d, '$.qualityScore') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS rated FROM d)
    SELECT run_key, coalesce(method IN ('eesv', 'single-pass', 'heuristic') AND profile IN ('light', 'balanced', 'aggressive') AND counted AND rated
            AND (json_type(d, '$.verified') IS NULL OR json_type(d, '$.verified') = 'BOOLEAN')
            AND (json_type(d, '$.plannedYield') IS NULL OR CAST(json_extract(d, '$.plannedYield') AS DOUBLE) BETWEEN 0 AND 1), false) AS valid,
        CASE WHEN method IN ('eesv', 'single-pass', 'heuristic') THEN method ELSE 'heuristic' END AS method, CASE WHEN profile IN ('light', 'balanced', 'aggressive') THEN profile ELSE 'balanced' END AS profile,
        CASE WHEN counted THEN CAST(json_extract(d, '$.totalMessages') AS DOUBLE) ELSE 0 END AS messages, CASE WHEN rated THEN CAST(json_extract(d, '$.qualityScore') AS DOUBLE) ELSE 0 END AS score,
        len(CAST(json_extract(d, '$.modifiedFiles') AS JSON[])) AS files FROM k WHERE lists""",
)
def run_details(details: DataFrame) -> DataFrame:
    d = details.select("run_key", Q.details(F.col("text")).alias("d")).where("d IS NOT NULL")
    return d.select("run_key", "d.valid", "d.method", "d.profile", "d.messages", "d.score", F.size("d.modified").alias("files"))


@query(
    "path_lists",
    "details",
    sql="""WITH p AS (SELECT run_key, CASE WHEN json_valid(text) AND json_type(text, '$.modifiedFiles') = 'ARRAY' THEN
        list_transform(list_filter(CAST(json_extract(text, '$.modifiedFiles') AS JSON[]), lambda x: json_type(x) = 'VARCHAR')[:2], lambda x: json_extract_string(x, '$')) ELSE [] END AS paths FROM {details})
    SELECT run_key, array_to_string(paths, '|') AS paths FROM p""",
)
def path_lists(details: DataFrame) -> DataFrame:
    return details.select("run_key", F.array_join(Q.string_list(F.get_json_object("text", "$.modifiedFiles"), 2), "|").alias("paths"))


@query(
    "decoded_paths",
    "steps",
    sql="""SELECT event_id, path AS plain, path AS quoted, concat('"', path) AS broken, '7' AS number FROM {steps}""",
)
def decoded_paths(steps: DataFrame) -> DataFrame:
    quoted = F.concat(F.lit('"'), "path", F.lit('"'))
    return steps.select(
        "event_id", Q.decoded_path(F.col("path")).alias("plain"), Q.decoded_path(quoted).alias("quoted"),
        Q.decoded_path(F.concat(F.lit('"'), "path")).alias("broken"), Q.decoded_path(F.lit("7")).alias("number"),
    )


@query(
    "required_evidence",
    "evidence",
    sql=r"""WITH t AS (SELECT * FROM {evidence} WHERE (kind <> 'constraint' OR confidence >= 0.8) AND (kind <> 'decision' OR explicit)),
    o AS (SELECT doc_id, kind, text, side, ord, row_number() OVER (PARTITION BY doc_id, kind, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY side, ord) AS n FROM t),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY side DESC, ord DESC) AS back FROM o WHERE n = 1)
    SELECT doc_id, kind, text FROM u WHERE kind <> 'resolved' OR back <= 5
    UNION ALL SELECT DISTINCT doc_id, 'constraint', 'Preserve detail about: caches' FROM {evidence} WHERE doc_id < 40""",
)
def required_evidence(facts: DataFrame) -> DataFrame:
    steering = facts.where("doc_id < 40").select("doc_id", F.lit("caches").alias("focus"), F.lit(" ").alias("note")).distinct()
    return Q.required_evidence(facts, steering)


@query(
    "capped_facts",
    "state_items",
    sql="SELECT session_id, kind, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY ord DESC) AS n FROM {state_items}) WHERE n <= 2",
)
def capped_facts(items: DataFrame) -> DataFrame:
    return Q.capped(items.select("session_id", "kind", "ord", "text"), dict.fromkeys(("decision", "constraint", "unresolved", "resolved"), 2))[0]


@query(
    "evidence_overflow",
    "state_items",
    sql="SELECT session_id, kind, count(*) - 2 AS omitted FROM {state_items} GROUP BY 1, 2 HAVING count(*) > 2",
)
def evidence_overflow(items: DataFrame) -> DataFrame:
    return Q.capped(items, dict.fromkeys(("decision", "constraint", "unresolved", "resolved"), 2))[1]


@query(
    "numbered_facts",
    "state_items",
    sql="""WITH p AS (SELECT *, CASE WHEN kind IN ('unresolved', 'resolved') THEN 'error-' ELSE kind || '-' END AS p FROM {state_items})
    SELECT session_id, kind, ord, p || (SELECT count(*) FROM p b WHERE b.session_id = a.session_id AND b.p = a.p AND (b.kind > a.kind OR (b.kind = a.kind AND b.ord <= a.ord))) AS id FROM p a""",
)
def numbered_facts(items: DataFrame) -> DataFrame:
    return Q.numbered_facts(items.select("session_id", "kind", "ord"))


_LINES = """l AS (SELECT session_id, kind, text AS line, count(*) AS n, min(ord) AS idx FROM {state_items} WHERE kind IN ('decision', 'constraint') GROUP BY ALL),
    t AS (SELECT session_id, kind, string_agg('[note] ' || line || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END, ', ' ORDER BY idx, '[note] ' || line || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END) FILTER (WHERE kind = 'constraint') AS c,
        string_agg('note: ' || line || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END, ', ' ORDER BY idx, 'note: ' || line || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END) FILTER (WHERE kind = 'decision') AS d FROM l GROUP BY 1, 2)"""


@query(
    "extraction_contexts",
    "state_items",
    sql=f"""WITH {_LINES}, o AS (SELECT session_id, string_agg(kind || ': +' || (n - 2), ', ' ORDER BY kind) AS over FROM (SELECT session_id, kind, count(*) AS n FROM {{state_items}} GROUP BY 1, 2) WHERE n > 2 GROUP BY 1)
    SELECT session_id, concat_ws(chr(10), '## Deterministic Extraction (verified facts)', 'Files modified: none', 'Files read: none', 'Files deleted: none', 'Errors: none',
        'Decisions: ' || coalesce(max(d), 'none'), 'Constraints: ' || coalesce(max(c), 'none'), 'Evidence omitted by safety bounds: ' || coalesce(any_value(over), 'none')) AS text
    FROM t LEFT JOIN o USING (session_id) GROUP BY 1""",
)
def extraction_contexts(items: DataFrame) -> DataFrame:
    facts = items.where("kind IN ('decision', 'constraint')").select("session_id", "kind", F.col("ord").alias("idx"), F.lit("note").alias("label"), "text")
    return Q.extraction_context(facts, Q.capped(items, dict.fromkeys(("decision", "constraint", "unresolved", "resolved"), 2))[1])


@query(
    "exploration_contexts",
    "messages",
    sql="""WITH g AS (SELECT session_id, count(*) AS n FROM {messages} GROUP BY 1)
    SELECT session_id AS doc_id, concat('## Exploration Report', chr(10), 'Main goal: goal ', n, chr(10), 'Session type: implementation') AS text FROM g WHERE n > 3
    UNION ALL SELECT session_id, '' FROM g WHERE n <= 3""",
)
def exploration_contexts(messages: DataFrame) -> DataFrame:
    goals = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).select("session_id", F.when(F.col("n") > 3, F.concat(F.lit("goal "), F.col("n").cast("string"))).alias("goal"))
    return Q.exploration_context(Q.fallback_report(goals))


# ---------------------------------------------------------------- settings, caches, streams


@query(
    "asked_budgets",
    "asked",
    sql="""SELECT name, value, coalesce(trim(value), '') = '' OR coalesce(CASE name WHEN 'maxCalls' THEN try_cast(value AS DOUBLE) BETWEEN 1 AND 100 AND try_cast(value AS DOUBLE) % 1 = 0
        WHEN 'maxInputTokens' THEN try_cast(value AS DOUBLE) BETWEEN 10000 AND 1000000 AND try_cast(value AS DOUBLE) % 1 = 0 WHEN 'maxLatencyMs' THEN try_cast(value AS DOUBLE) BETWEEN 5000 AND 600000 END, false) AS ok FROM {asked}""",
)
def asked_budgets(asked: DataFrame) -> DataFrame:
    return Q.budget_errors(asked)


@query(
    "checked_settings",
    "settings",
    sql="""WITH v AS (SELECT *, CASE WHEN json_valid(value) AND json_type(value) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(value AS DOUBLE) END AS x FROM {settings})
    SELECT name, value, CASE name WHEN 'autoTriggerTimeoutMs' THEN coalesce(x BETWEEN 1000 AND 300000, false) WHEN 'maxLlmCalls' THEN coalesce(x BETWEEN 0 AND 100 AND x % 1 = 0, false)
        WHEN 'codexMaxCallMs' THEN coalesce((x = 0 OR x BETWEEN 5000 AND 300000) AND x % 1 = 0, false) WHEN 'maxLatencyMs' THEN coalesce(x = 0 OR x BETWEEN 5000 AND 600000, false)
        WHEN 'minContextPercent' THEN coalesce(x BETWEEN 0 AND 100, false) END AS ok FROM v""",
)
def checked_settings(settings: DataFrame) -> DataFrame:
    return Q.valid_settings(settings)


@query("checked_profiles", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_linenumber > 0 AND l_linenumber <= l_quantity AND l_quantity <= 40 AS ok FROM lineitem")
def checked_profiles(lines: DataFrame) -> DataFrame:
    profiles = lines.select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("min_chunk"), F.col("l_quantity").alias("max_chunk"), F.lit(40).alias("batch"))
    return Q.ordered_bounds(profiles).select("l_orderkey", "l_linenumber", "ok")


@query(
    "cache_retentions",
    "llm_calls",
    sql="""SELECT event_id, CASE WHEN phase IN ('explore-retry', 'explore-direct', 'single-pass', 'batch', 'assemble', 'patch') THEN 'none' WHEN provider = 'p3' THEN 'none' ELSE 'short' END AS retention FROM {llm_calls}""",
)
def cache_retentions(calls: DataFrame) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, ("anthropic-eu", "openai", "my-gpt", "deepseek-x"))), F.substring("provider", 2, 1).cast("int") + 1)
    return calls.select("event_id", Q.cache_retention(F.col("phase"), named).alias("retention"))


@query(
    "cache_counters",
    "llm_calls",
    sql="SELECT phase, count(*) FILTER (WHERE cache_hit_tokens > 150) AS hits, count(*) FILTER (WHERE cache_hit_tokens <= 150) AS misses, avg(CASE WHEN cache_hit_tokens > 150 THEN 1.0 ELSE 0 END) AS hit_rate FROM {llm_calls} GROUP BY 1",
)
def cache_counters(calls: DataFrame) -> DataFrame:
    return Q.cache_counters(calls.withColumn("hit", F.col("cache_hit_tokens") > 150), "phase")


@query(
    "metric_rings",
    "llm_calls",
    sql="""WITH RECURSIVE c AS (SELECT phase, provider, count(*) AS n FROM {llm_calls} GROUP BY ALL),
    f AS (SELECT phase, provider, n, 0::BIGINT AS i, 0::BIGINT AS held FROM c UNION ALL SELECT phase, provider, n, i + 1, CASE WHEN held + 1 > 200 THEN 100 ELSE held + 1 END FROM f WHERE i < n),
    h AS (SELECT phase, provider, held FROM f WHERE i = n), r AS (SELECT *, row_number() OVER (PARTITION BY phase, provider ORDER BY event_id DESC) AS back FROM {llm_calls})
    SELECT r.event_id, r.phase, r.provider FROM r JOIN h USING (phase, provider) WHERE back <= held""",
)
def metric_rings(calls: DataFrame) -> DataFrame:
    return Q.ring(calls.select("event_id", "phase", "provider"), "phase", "provider", order="event_id")


@query(
    "stream_stops",
    "deltas",
    sql="""WITH v AS (SELECT *, sum(CASE WHEN type IN ('text_delta', 'thinking_delta', 'toolcall_delta') THEN chars ELSE 0 END) OVER (PARTITION BY call_id ORDER BY ord) AS visible FROM {deltas}),
    s AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ord) AS n FROM v WHERE visible > 3 * max_tokens OR at_ms > deadline_ms)
    SELECT call_id, ord, CASE WHEN at_ms > deadline_ms THEN 'time' ELSE 'visible-output' END AS reason, CAST(visible AS BIGINT) AS visible FROM s WHERE n = 1""",
)
def stream_stops(deltas: DataFrame) -> DataFrame:
    return Q.stream_stops(deltas)


@query(
    "stale_caches",
    "orders",
    sql="SELECT 'extract-' || o_orderkey || '.json' AS name FROM orders WHERE o_orderdate < DATE '1996-12-25' AND o_orderstatus <> 'P'",
)
def stale_caches(orders: DataFrame) -> DataFrame:
    name = F.concat(F.when(F.col("o_orderstatus") == "P", "state-").otherwise("extract-"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    files = orders.select(name.alias("name"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).alias("mtime_ms"))
    return Q.stale_files(files, "extract-", F.lit(852_076_800_000), 7 * 86_400_000).select("name")


@query(
    "legacy_prefixes",
    "lineage",
    sql="SELECT session_id, true AS whole, true AS start, count(*) = 1 AS last, false AS longer, false AS none FROM {lineage} GROUP BY 1",
)
def legacy_prefixes(lineage: DataFrame) -> DataFrame:
    ids = lineage.groupBy("session_id").agg(F.array_sort(F.collect_list(F.col("branch_id").cast("string"))).alias("ids"))
    old = {"whole": F.col("ids"), "start": F.slice("ids", 1, 1), "last": F.slice("ids", -1, 1), "longer": F.array_append("ids", F.lit("x")), "none": F.slice("ids", 1, 0)}
    return ids.select("session_id", *[Q.legacy_prefix(v, F.col("ids")).alias(k) for k, v in old.items()])


@query(
    "bounded_continuity",
    "documents",
    sql="""WITH m AS (SELECT doc_id, text, strlen(text) AS n, chr(10) || '… [continuity truncated from ' || strlen(text) || ' bytes]' || chr(10) AS mark FROM documents)
    SELECT doc_id, sha256(CASE WHEN n <= 300 THEN text ELSE text[:list_max(list_filter(range(0, 301), lambda i: strlen(text[:i]) <= 300 - strlen(mark)))] || mark END) AS text_sha256 FROM m""",
)
def bounded_continuity(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(Q.bounded_bytes(F.col("text"), 300), 256).alias("text_sha256"))


@query(
    "message_tokens",
    "results",
    sql=f"""WITH j AS (SELECT session_id, idx, json_object('role', 'toolResult', 'content', text, 'toolCallId', call_id)::VARCHAR AS j, is_error FROM {{results}}),
    t AS (SELECT session_id, idx, CASE WHEN is_error THEN j[:-2] || ',"isError":true}}}}' ELSE j END AS text FROM j) SELECT session_id, idx, {_TOKENS} AS tokens FROM t""",
)
def message_tokens(results: DataFrame) -> DataFrame:
    return results.select("session_id", "idx", Q.message_tokens(F.lit("toolResult"), F.col("text"), F.col("call_id"), F.lit(""), F.col("is_error")).alias("tokens"))


@query(
    "run_lines",
    "runs",
    sql="""SELECT run_id, concat('score ', coalesce(CAST(verification_score AS BIGINT) || '/100', '—'), ' • saved ', format('{{:,}}', total_input), 't • ', status, ' • ', profile, ' / ', provider) AS line,
        CASE WHEN status = 'dry-run' THEN 'tool' WHEN release_channel = 'canary' THEN 'auto' ELSE 'manual' END AS run_type, coalesce(nullif(duration_ms, 0), total_input + total_output) AS duration_ms FROM {runs}""",
)
def run_lines(runs: DataFrame) -> DataFrame:
    line = Q.run_line(F.col("verification_score"), F.col("total_input"), F.col("status"), F.col("profile"), F.col("provider"))
    length = Q.duration(F.nullif("duration_ms", F.lit(0)), F.array("total_input", "total_output"))
    return runs.select("run_id", line.alias("line"), Q.run_type(F.col("status") == "dry-run", F.col("release_channel") == "canary").alias("run_type"), length.alias("duration_ms"))


@query(
    "compact_numbers",
    "customer",
    sql="""SELECT c_custkey, CASE WHEN n >= 10000 THEN regexp_replace(printf('%.1f', round(n / 1000.0, 1)), '\\.0$', '') || 'K' ELSE format('{{:,}}', n) END AS thousands,
        regexp_replace(printf('%.1f', round(n / 1000.0, 1)), '\\.0$', '') || 'M' AS millions FROM (SELECT c_custkey, CAST(10000 + c_custkey AS BIGINT) AS n FROM customer)""",
)
def compact_numbers(customers: DataFrame) -> DataFrame:
    n = F.col("c_custkey").cast("long") + 10_000
    return customers.select("c_custkey", Q.compact_number(n).alias("thousands"), Q.compact_number(n * 1000).alias("millions"))


@query(
    "project_folders",
    "steps",
    sql="""SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL ELSE 'proj-' || substr(sha256(CASE WHEN k % 3 = 0 THEN '/git/root' ELSE '/work/' || path END), 1, 12) END AS project_id FROM {steps}""",
)
def project_folders(steps: DataFrame) -> DataFrame:
    folder = F.when(F.col("k") % 5 == 0, F.when(F.col("k") % 2 == 0, "/").otherwise("/home/me/")).otherwise(F.concat(F.lit(" /work/"), "path", F.lit("/ ")))
    return steps.select("event_id", Q.project_of_folder(folder, F.when(F.col("k") % 3 == 0, "/git/root"), "/home/me").alias("project_id"))


@query(
    "restored_texts",
    "nation",
    sql="SELECT n_nationkey, concat('# Restored context of a backup', chr(10), 'Source: ', n_name, chr(10), chr(10), n_name, ' body') AS text FROM nation",
)
def restored_texts(nations: DataFrame) -> DataFrame:
    return nations.select("n_nationkey", Q.restore_text(F.concat("n_name", F.lit(" body")), F.col("n_name")).alias("text"))


@query(
    "kept_for_damage",
    "turns",
    sql="""WITH k AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS kept, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS n FROM {turns} WHERE idx >= 60 AND session_id % 4 <> 1)
    SELECT session_id, idx, role FROM k WHERE kept >= 3 AND n <= 15""",
)
def kept_for_damage(turns: DataFrame) -> DataFrame:
    sessions = turns.select("session_id").distinct()
    told = F.when(F.col("session_id") % 4 != 1, "{}")
    done = sessions.select("session_id", F.lit(1).alias("ord"), F.lit(10).alias("keep_from"), F.lit("{}").alias("details")).unionByName(
        sessions.select("session_id", F.lit(2).alias("ord"), F.lit(60).alias("keep_from"), told.alias("details"))
    )
    return Q.kept_for_damage(turns, done).select("session_id", "idx", "role")


# ---------------------------------------------------------------- sections, hints, graph


@query(
    "remediation_hints",
    "steps",
    sql="SELECT DISTINCT session_id, path FROM {steps}",
)
def hints(steps: DataFrame) -> DataFrame:
    rows = steps.select("session_id", F.concat(F.lit(" "), "path", F.lit("  ")).alias("path"))
    return remediation_hints(rows.unionByName(rows.withColumn("path", F.lit("  "))), "session_id")


@query(
    "patchable_gaps",
    "steps",
    sql="SELECT event_id, event_type <> 'error' OR k % 2 = 0 AS patchable FROM {steps}",
)
def patchable_gaps(steps: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "inconsistency").otherwise("missing-file")
    detail = F.when(F.col("k") % 2 == 0, "blocked-none: x").otherwise("goal contradicted: x")
    return steps.select("event_id", Y.patchable(kind, detail).alias("patchable"))


@query(
    "truncated_patches",
    "steps",
    sql="""SELECT event_id, k % 7 IN (1, 2, 4, 6) AS cut FROM {steps}""",
)
def truncated_patches(steps: DataFrame) -> DataFrame:
    texts = ["fine", "cut …✂12", "```\nopen", "```\nx\n```", "fine", "a, b:", "y"]
    reasons = [None, "stop", "stop", "stop", "MAX_OUTPUT_TOKENS", "", "length"]
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("k") % 7 + 1)
    return steps.select("event_id", Y.truncated_patch(pick(texts), pick(reasons)).alias("cut"))


@query(
    "head_and_tail",
    "documents",
    sql="SELECT doc_id, sha256(CASE WHEN length(text) <= 1000 THEN text ELSE text[:498] || chr(10) || '…' || chr(10) || right(text, 498) END) AS text_sha256 FROM documents",
)
def head_and_tail(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(J.head_and_tail(F.col("text"), 1000), 256).alias("text_sha256"))


@query(
    "section_identities",
    "state_items",
    sql=f"WITH {_SUMMARY} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS place, CASE kind WHEN 'constraints' THEN 'unknown:odd part' ELSE kind END AS identity FROM parts",
)
def section_identities(items: DataFrame) -> DataFrame:
    parts = Y.sections(_summaries(items))
    kind = F.when(F.col("kind") == "constraints", "unknown").otherwise(F.col("kind"))
    return parts.select("doc_id", F.col("ord").alias("place"), Y.section_identity(kind, F.lit("## Odd Part ")).alias("identity"))


@query(
    "uncached_requests",
    "llm_calls",
    sql="SELECT event_id, phase, 'prompt ' || input_tokens AS prompt FROM {llm_calls} WHERE input_tokens >= 2000 OR phase <> 'batch'",
)
def uncached_requests(calls: DataFrame) -> DataFrame:
    requests = calls.select("event_id", "phase", F.concat(F.lit("prompt "), F.col("input_tokens").cast("string")).alias("prompt"), "input_tokens")
    held = requests.where("phase = 'batch' AND input_tokens < 2000").select(F.sha2(F.concat_ws("\u0000", "phase", "prompt"), 256).alias("key")).distinct()
    return M.uncached(requests, held).select("event_id", "phase", "prompt")


@query(
    "new_facts",
    "facts",
    sql="""WITH l AS (SELECT session_id, kind, lower(trim(text)) AS key, arg_max(status, lineage_rank) AS status FROM {facts} GROUP BY ALL)
    SELECT f.session_id, f.kind, lower(trim(f.text)) AS key, f.lineage_rank FROM {facts} f JOIN l ON l.session_id = f.session_id AND l.kind = f.kind AND l.key = lower(trim(f.text)) WHERE l.status <> 'active' OR f.lineage_rank > 2""",
)
def new_facts(facts: DataFrame) -> DataFrame:
    keyed = facts.withColumn("key", F.lower(F.trim("text")))
    new = keyed.select("session_id", "kind", "key", "lineage_rank", F.when(F.col("lineage_rank") > 2, "new").otherwise("old").alias("content"))
    latest = keyed.groupBy("session_id", "kind", "key").agg(F.max_by("status", "lineage_rank").alias("status")).withColumn("content", F.lit("old"))
    return G.active_facts(new, latest).select("session_id", "kind", "key", "lineage_rank")


@query(
    "fact_tombstones",
    "facts",
    sql="""WITH l AS (SELECT session_id, kind, lower(trim(text)) AS key, arg_max(status, lineage_rank) AS status FROM {facts} GROUP BY ALL)
    SELECT f.session_id, f.branch_id, f.kind, lower(trim(f.text)) AS key, 'resolved' AS status FROM {facts} f JOIN l ON l.session_id = f.session_id AND l.kind = f.kind AND l.key = lower(trim(f.text)) WHERE l.status <> 'resolved'""",
)
def fact_tombstones(facts: DataFrame) -> DataFrame:
    keyed = facts.withColumn("key", F.lower(F.trim("text")))
    latest = keyed.groupBy("session_id", "kind", "key").agg(F.max_by("status", "lineage_rank").alias("status"))
    return G.tombstones(keyed, latest, "resolved")


@query(
    "closed_memories",
    "nodes",
    sql="SELECT node_id, 'resolved' AS status FROM {nodes} WHERE kind = 'decision' AND title = '1-URGENT'",
)
def closed_memories(nodes: DataFrame) -> DataFrame:
    return G.closed_memories(nodes.withColumn("source", F.lit("manual")), "decision", "1-urgent").select("node_id", "status")


@query(
    "unposted_nodes",
    "nodes",
    sql="SELECT node_id, kind FROM {nodes} WHERE kind <> 'file' OR confidence < 1",
)
def unposted_nodes(nodes: DataFrame) -> DataFrame:
    return Q.without_postings(nodes.select("node_id", "kind"), nodes.where("kind = 'file' AND confidence >= 1"))


@query(
    "project_paths",
    "steps",
    sql="SELECT event_id, path FROM {steps}",
)
def project_paths(steps: DataFrame) -> DataFrame:
    foreign = steps.withColumn("path", F.concat(F.lit("/x/node_modules/"), "path"))
    return S.project_paths(steps.unionByName(foreign)).select("event_id", "path")


@query(
    "summary_allowances",
    "customer",
    sql="""SELECT c_custkey, CAST(greatest(c_custkey + ceil(c_custkey / 4.0), ceil(ceil(c_custkey * 3.5) / 3.5) + ceil(19600 / 3.5)) AS BIGINT) AS allowance FROM customer""",
)
def summary_allowances(customers: DataFrame) -> DataFrame:
    return customers.select("c_custkey", R.summary_allowance(F.col("c_custkey"), F.lit(3.5)).alias("allowance"))


def _section(parts: DataFrame, kind: str) -> DataFrame:
    return parts.where(F.col("kind") == kind).select("doc_id", "body")


@query(
    "pinned_paths",
    "state_items",
    sql=f"""WITH {_SUMMARY}, d AS (SELECT DISTINCT doc_id FROM parts), f AS (SELECT doc_id, body FROM parts WHERE kind = 'files-modified')
    SELECT d.doc_id, concat_ws(chr(10), f.body, CASE WHEN coalesce(f.body, '') <> '- src/Job1.ts' THEN '- src/Job1.ts' END, '- src/pinned.ts') AS body FROM d LEFT JOIN f USING (doc_id)""",
)
def pinned_paths(items: DataFrame) -> DataFrame:
    parts = Y.sections(_summaries(items))
    pinned = parts.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("src/Job1.ts"), F.lit("src/pinned.ts"))).alias("path"))
    return _section(Y.with_pinned_paths(parts, pinned), "files-modified")


@query(
    "change_sections",
    "state_items",
    sql=r"""SELECT session_id AS doc_id, string_agg('- ' || CASE side WHEN 'current' THEN 'New' ELSE 'Resolved' END || ' ' || kind || ': ' || regexp_replace(text, '\s+', ' ', 'g'), chr(10)
        ORDER BY CASE side WHEN 'current' THEN 'New' ELSE 'Resolved' END || ' ' || kind || ': ' || regexp_replace(text, '\s+', ' ', 'g')) AS body FROM {state_items} WHERE kind IN ('decision', 'constraint') GROUP BY 1""",
)
def change_sections(items: DataFrame) -> DataFrame:
    change = F.when(~F.col("kind").isin("decision", "constraint"), "persistent").when(F.col("side") == "current", "new").otherwise("resolved")
    return _section(Y.with_delta(Y.sections(_summaries(items)), items.select(F.col("session_id").alias("doc_id"), "kind", "text", change.alias("change"))), "changes")


@query(
    "open_loop_sections",
    "state_items",
    sql=r"""SELECT session_id AS doc_id, string_agg('- [' || priority || '] ' || regexp_replace(text, '\s+', ' ', 'g'), chr(10) ORDER BY '- [' || priority || '] ' || regexp_replace(text, '\s+', ' ', 'g')) AS body
    FROM {state_items} WHERE kind = 'unresolved' GROUP BY 1""",
)
def open_loop_sections(items: DataFrame) -> DataFrame:
    loops = items.where("kind = 'unresolved'").select(F.col("session_id").alias("doc_id"), "text", "priority")
    return _section(Y.with_open_loops(Y.sections(_summaries(items)), loops), "open-loops")


@query(
    "next_actions",
    "steps",
    sql="""SELECT event_id AS doc_id, unnest([1, 2, 3]) AS place, unnest(['open ' || path, 'test', 'ship']) AS text FROM {steps}""",
)
def next_actions(steps: DataFrame) -> DataFrame:
    body = F.concat(F.lit("- open "), "path", F.lit("\n* [ ] test\n- None\n\n3. ship"))
    return Y.next_actions(steps.select(F.col("event_id").alias("doc_id"), F.lit("next-steps").alias("kind"), body.alias("body")))


@query(
    "blocked_none_gaps",
    "steps",
    sql="SELECT event_id AS doc_id, 'inconsistency' AS kind, 'blocked-none' AS detail, 12 AS penalty FROM {steps} WHERE event_type = 'error' AND k % 3 > 0",
)
def blocked_none_gaps(steps: DataFrame) -> DataFrame:
    said = F.element_at(F.array(F.lit("- waiting for review"), F.lit("- None recorded."), F.lit("none")), F.col("k") % 3 + 1)
    parts = steps.select(F.col("event_id").alias("doc_id"), F.lit("progress").alias("kind"), F.concat(F.lit("### Done\n- x\n### Blocked\n"), said).alias("body"))
    return Y.blocked_none(parts, steps.where("event_type = 'error'").select(F.col("event_id").alias("doc_id")))


@query(
    "recall_texts",
    "state_items",
    sql=r"""WITH l AS (SELECT session_id, ord, '- [' || kind || '] ' || '‹b>' || ': ' || text AS line FROM {state_items}),
    u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY session_id ORDER BY ord) AS upto FROM l) SELECT session_id AS doc_id, string_agg(line, chr(10) ORDER BY ord) AS text FROM u WHERE upto <= 120 GROUP BY 1""",
)
def recall_texts(items: DataFrame) -> DataFrame:
    return Y.recall_text(items.select(F.col("session_id").alias("doc_id"), F.col("ord").alias("place"), "kind", F.lit("<b>").alias("title"), F.col("text").alias("content")), 120)


@query(
    "bounded_arguments",
    "steps",
    sql="""SELECT event_id, concat('{{"a":"', path[:6], '…","b":[1,2]}}') AS args FROM {steps}""",
)
def bounded_arguments(steps: DataFrame) -> DataFrame:
    args = F.concat(F.lit('{"a":"'), "path", F.lit('","b":[1,2,3],"c":{"d":{"e":1}}}'))
    return steps.select("event_id", J.bounded(args, {"chars": 6, "items": 2, "keys": 2, "depth": 2}).alias("args"))
