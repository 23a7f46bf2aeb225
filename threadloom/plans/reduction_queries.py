"""Queries of redundancy reduction, windows, batches, modes and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.numbers import context_percent
from threadloom.operators import facts as O
from threadloom.operators import reduction as R
from threadloom.operators.telemetry import newest
from threadloom.plans.fact_queries import _STEPS
from threadloom.plans.registry import query

_REDUNDANT = r"""
    epochs AS (SELECT *, CAST(sum(CASE WHEN operation IN ('mutate', 'delete', 'execute') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM steps2),
    redundant AS (SELECT session_id, idx, call_id, epoch FROM (SELECT *, row_number() OVER (PARTITION BY session_id, epoch, name, args ORDER BY idx DESC) AS n FROM epochs
        WHERE operation IN ('read', 'search', 'list') AND NOT is_error) WHERE n > 1)"""


def _steps(calls: DataFrame, results: DataFrame) -> DataFrame:
    return O.tool_steps(calls, results).join(calls.select("session_id", "call_id", "args"), ["session_id", "call_id"])


@query("redundant_accesses", "calls", "results", sql=f"WITH {_STEPS}, {_REDUNDANT} SELECT * FROM redundant")
def redundant_accesses(calls: DataFrame, results: DataFrame) -> DataFrame:
    return R.redundant_accesses(_steps(calls, results))


@query(
    "pruned_turns",
    "calls",
    "results",
    "turns",
    sql=f"""WITH {_STEPS}, {_REDUNDANT},
    n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM {{turns}})
    SELECT session_id, idx, role, call_id, text FROM n WHERE n < 5 OR NOT EXISTS (SELECT 1 FROM redundant r WHERE r.session_id = n.session_id AND r.call_id = n.call_id)""",
)
def pruned_turns(calls: DataFrame, results: DataFrame, turns: DataFrame) -> DataFrame:
    return R.pruned(turns, R.redundant_accesses(_steps(calls, results)))


@query(
    "retained_suffix",
    "turns",
    sql="""SELECT session_id, idx, CAST(sum(tokens) OVER w - tokens AS BIGINT) AS before, CAST(sum(tokens) OVER (PARTITION BY session_id) - sum(tokens) OVER w + tokens AS BIGINT) AS from_here
    FROM {turns} WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
)
def retained_suffix(turns: DataFrame) -> DataFrame:
    return R.retained_suffix(turns).select("session_id", "idx", "before", "from_here")


@query(
    "window_scan",
    "turns",
    sql="""WITH s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY idx DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS from_here,
        CAST(sum(tokens) OVER (PARTITION BY session_id) AS BIGINT) AS total FROM {turns})
    SELECT session_id, coalesce(max(idx) FILTER (WHERE from_here - tokens >= 10000 AND from_here > 14000) + 1, 0) AS keep_from, max(total) AS total FROM s GROUP BY 1""",
)
def window_scan(turns: DataFrame) -> DataFrame:
    return R.keep_scan(turns, 10_000, 14_000)


@query(
    "protected_user_turn",
    "turns",
    sql="""SELECT session_id, min(idx) AS protected FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS n FROM {turns} WHERE role = 'user') WHERE n <= 2 GROUP BY 1""",
)
def protected_user_turn(turns: DataFrame) -> DataFrame:
    return R.protected_user_turn(turns)


def plan_sql(context_window: int, modes: str = "'fast', 'balanced', 'thorough'") -> str:
    """Window plans as common table expressions, the last of them ``plans``; boundaries by search."""
    return f"""tp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS pos FROM {{window_turns}}),
    cp AS (SELECT session_id, call_id, max(pos) AS c FROM tp WHERE role = 'assistant' AND call_id IS NOT NULL GROUP BY ALL),
    pairs AS MATERIALIZED (SELECT tp.session_id, c, pos AS r FROM tp JOIN cp USING (session_id, call_id) WHERE role = 'toolResult' AND pos > c),
    facts AS MATERIALIZED (SELECT tp.session_id, tp.pos, tp.tokens, tp.role, tp.anchor,
        NOT EXISTS (SELECT 1 FROM pairs p WHERE p.session_id = tp.session_id AND p.c < tp.pos AND tp.pos <= p.r) AS safe,
        tp.role = 'toolResult' AND cp.c IS NULL AS lone,
        coalesce(regexp_extract(tp.path, '[^/]*$') = regexp_extract(before.path, '[^/]*$'), false) AS near,
        CASE WHEN regexp_full_match(tp.tool_name, '[A-Za-z0-9_-]{{{{1,64}}}}') OR tp.tool_name IS NULL THEN 0 WHEN tp.role = 'toolResult' THEN tp.pos + 1
            WHEN tp.role = 'assistant' THEN coalesce((SELECT max(r) + 1 FROM pairs p WHERE p.session_id = tp.session_id AND p.c = tp.pos), tp.pos + 1) ELSE 0 END AS odd_end
        FROM tp LEFT JOIN cp USING (session_id, call_id) LEFT JOIN tp before ON before.session_id = tp.session_id AND before.pos = tp.pos - 1),
    f AS MATERIALIZED (SELECT a.session_id, a.pos, a.role, a.near, coalesce((SELECT sum(b.tokens) FROM facts b WHERE b.session_id = a.session_id AND b.pos < a.pos), 0) AS before, a.tokens,
        (SELECT max(b.pos) FROM facts b WHERE b.session_id = a.session_id AND b.pos <= a.pos AND b.safe) AS back,
        (SELECT min(b.pos) FROM facts b WHERE b.session_id = a.session_id AND b.pos >= a.pos AND b.safe AND NOT b.lone) AS ahead,
        (SELECT max(b.odd_end) FROM facts b WHERE b.session_id = a.session_id AND b.pos >= a.pos) AS odd FROM facts a),
    s AS (SELECT session_id, count(*) AS n, sum(tokens) AS total, max(pos) FILTER (WHERE anchor) AS anchored,
        (SELECT min(pos) FROM (SELECT pos FROM facts u WHERE u.session_id = facts.session_id AND u.role = 'user' ORDER BY pos DESC LIMIT 2)) AS users FROM facts GROUP BY 1),
    modes AS (SELECT * FROM (VALUES ('fast', 30, 3000, 10000), ('balanced', 40, 6000, 20000), ('thorough', 50, 10000, 30000)) m(mode, percent, summary, least) WHERE mode IN ({modes})),
    m AS (SELECT *, total * 0.2e0 AS fixed, total * 1.2e0 AS used, least(2 * least, greatest(least, {context_window} * 0.04e0)) AS keep, summary + ceil(summary / 4.0) AS room, {context_window} * percent / 100.0 AS goal FROM s, modes),
    m1 AS (SELECT *, greatest(keep, greatest(0, goal - fixed - room)) AS ceiling FROM m),
    m2 AS (SELECT m1.*, least(n - 1, coalesce((SELECT max(pos) + 1 FROM f WHERE f.session_id = m1.session_id AND total - before - tokens >= keep AND total - before > ceiling), 0)) AS k0 FROM m1),
    m3 AS (SELECT m2.*, greatest(ceiling, total - f.before) AS most FROM m2 JOIN f ON f.session_id = m2.session_id AND f.pos = k0),
    m4 AS (SELECT m3.*, users < k0 AS t1, g.pos AS g1, total - g.before <= most AS o1 FROM m3 LEFT JOIN f c ON c.session_id = m3.session_id AND c.pos = users LEFT JOIN f g ON g.session_id = m3.session_id AND g.pos = c.back),
    m5 AS (SELECT *, CASE WHEN t1 AND o1 THEN g1 ELSE k0 END AS k1 FROM m4),
    m6 AS (SELECT m5.*, anchored < k1 AS t2, g.pos AS g2, total - g.before <= most AS o2 FROM m5 LEFT JOIN f c ON c.session_id = m5.session_id AND c.pos = anchored LEFT JOIN f g ON g.session_id = m5.session_id AND g.pos = c.back),
    m7 AS (SELECT *, CASE WHEN t2 AND o2 THEN g2 ELSE k1 END AS k2 FROM m6),
    m8 AS (SELECT m7.*, x.near AND k2 > 0 AS t3, g.pos AS g3, total - g.before <= most AS o3 FROM m7 JOIN f x ON x.session_id = m7.session_id AND x.pos = k2
        LEFT JOIN f c ON c.session_id = m7.session_id AND c.pos = k2 - 1 LEFT JOIN f g ON g.session_id = m7.session_id AND g.pos = c.back),
    m9 AS (SELECT *, CASE WHEN t3 AND o3 THEN g3 ELSE k2 END AS k3 FROM m8),
    h AS (SELECT m9.*, CASE WHEN total - b.before > most AND x.ahead > k3 AND total - a.before <= most THEN x.ahead ELSE x.back END AS k4 FROM m9 JOIN f x ON x.session_id = m9.session_id AND x.pos = k3
        JOIN f b ON b.session_id = m9.session_id AND b.pos = x.back LEFT JOIN f a ON a.session_id = m9.session_id AND a.pos = x.ahead),
    e AS (SELECT h.*, greatest(k4, odd) >= n AS blocked, CASE WHEN greatest(k4, odd) >= n THEN k4 ELSE greatest(k4, odd) END AS k5 FROM h JOIN f ON f.session_id = h.session_id AND f.pos = k4),
    z AS (SELECT e.*, f.before, total - f.before AS kept, f.role AS first_role, fixed + total - f.before + room AS after FROM e JOIN f ON f.session_id = e.session_id AND f.pos = k5),
    plans AS (SELECT session_id, mode, CAST(k5 AS BIGINT) AS keep_from, CAST(before AS BIGINT) AS compact_tokens, CAST(kept AS BIGINT) AS retained_tokens, CAST(after AS DOUBLE) AS after_tokens,
        CAST(greatest(0, used - after) AS DOUBLE) AS saved_tokens, CAST(goal AS DOUBLE) AS target_tokens,
        coalesce(t1 AND o1 AND g1 <> users, false) OR coalesce(t2 AND o2 AND g2 <> anchored, false) OR coalesce(t3 AND o3 AND g3 <> k2 - 1, false) OR k5 <> k3 AS adjusted,
        concat_ws(',', CASE WHEN t1 AND NOT o1 THEN 'recent-user-turn' END, CASE WHEN t2 AND NOT o2 THEN 'anchor' END, CASE WHEN t3 AND NOT o3 THEN 'topical' END) AS relaxed,
        CASE WHEN blocked OR first_role = 'toolResult' THEN 'unsafe-tool-boundary' WHEN k5 <= 0 THEN 'no-eligible-prefix' WHEN kept > most THEN 'retention-target-exceeded'
            WHEN after > goal THEN 'mode-target-not-met' WHEN greatest(0, used - after) / used < 0.1 THEN 'insufficient-projected-saving' ELSE 'viable' END AS reason FROM z)"""


def with_files(turns: DataFrame) -> DataFrame:
    return turns.withColumn("files", F.array_compact(F.array("path"))).drop("path")


@query("window_plans", "window_turns", sql=f"WITH {plan_sql(150_000)} SELECT * FROM plans")
def window_plans(turns: DataFrame) -> DataFrame:
    return R.plan_windows(with_files(turns), 150_000)


@query(
    "window_plan_outcomes",
    "window_turns",
    sql=f"""WITH {plan_sql(60_000)} SELECT mode, reason, count(*) AS sessions, CASE reason {" ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in R.REASON_TEXTS.items())} END AS text FROM plans GROUP BY ALL""",
)
def window_plan_outcomes(turns: DataFrame) -> DataFrame:
    plans = R.plan_windows(with_files(turns), 60_000)
    texts = F.create_map(*[F.lit(x) for pair in R.REASON_TEXTS.items() for x in pair])
    return plans.groupBy("mode", "reason").agg(F.count(F.lit(1)).alias("sessions")).withColumn("text", F.element_at(texts, F.col("reason")))


@query(
    "branch_anchors",
    "branch",
    sql="""WITH m AS (SELECT session_id, ord, role, tool_name, anchored, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS pos FROM {branch} WHERE type = 'message')
    SELECT session_id, max(pos) AS anchor FROM m WHERE role = 'toolResult' AND tool_name = 'context' AND anchored GROUP BY 1""",
)
def branch_anchors(branch: DataFrame) -> DataFrame:
    return R.anchors(branch)


@query(
    "token_batches",
    "turns",
    sql="""WITH RECURSIVE o AS (SELECT session_id, idx, tokens, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS i FROM {turns}),
    f AS (SELECT session_id, idx, tokens, i, CAST(0 AS INT) AS batch, tokens AS held FROM o WHERE i = 1
        UNION ALL SELECT o.session_id, o.idx, o.tokens, o.i, CASE WHEN f.held > 0 AND f.held + o.tokens > 4000 THEN f.batch + 1 ELSE f.batch END,
            CASE WHEN f.held > 0 AND f.held + o.tokens > 4000 THEN o.tokens ELSE f.held + o.tokens END FROM f JOIN o ON o.session_id = f.session_id AND o.i = f.i + 1)
    SELECT session_id, idx, tokens, batch FROM f""",
)
def token_batches(turns: DataFrame) -> DataFrame:
    return R.batches(turns, 4000, "session_id", order="idx", size="tokens")


@query(
    "document_batches",
    "documents",
    sql="""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    f AS (SELECT source, doc_id, n_chars, i, CAST(0 AS INT) AS batch, n_chars AS held FROM o WHERE i = 1
        UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.i, CASE WHEN f.held > 0 AND f.held + o.n_chars > 20000 THEN f.batch + 1 ELSE f.batch END,
            CASE WHEN f.held > 0 AND f.held + o.n_chars > 20000 THEN o.n_chars ELSE f.held + o.n_chars END FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
    SELECT source, doc_id, n_chars, batch FROM f""",
)
def document_batches(docs: DataFrame) -> DataFrame:
    return R.batches(docs, 20_000, "source", order="doc_id", size="n_chars")


@query(
    "merged_boundaries",
    "turns",
    sql="""WITH RECURSIVE b AS (SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS i FROM {turns} WHERE role <> 'toolResult'),
    f AS (SELECT session_id, idx, i, idx AS last, true AS kept FROM b WHERE i = 1
        UNION ALL SELECT b.session_id, b.idx, b.i, CASE WHEN b.idx - f.last > 3 THEN b.idx ELSE f.last END, b.idx - f.last > 3 FROM f JOIN b ON b.session_id = f.session_id AND b.i = f.i + 1)
    SELECT session_id, idx FROM f WHERE kept""",
)
def merged_boundaries(turns: DataFrame) -> DataFrame:
    return R.merged_boundaries(turns.where("role <> 'toolResult'"))


_TOPICS = """SELECT session_id, lineage_rank AS ord, concat('topic ', CAST(branch_id % 9 AS STRING)) AS topic, concat(CASE branch_id % 4 WHEN 0 THEN 'an error and a fix' WHEN 1 THEN 'crash' ELSE 'fine' END, ' in item') AS summary,
    CASE branch_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'normal' END AS priority, branch_id % 3 AS decisions FROM {lineage}"""


@query(
    "topic_budgets",
    "lineage",
    sql=f"""WITH t AS ({_TOPICS}),
    w AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, CASE priority WHEN 'critical' THEN 2.0::DOUBLE WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.6 ELSE 1.0 END
        * (1 + len(regexp_extract_all(summary, '(?i)error|fail|bug|fix|crash|exception')) * 0.2::DOUBLE)
        * (0.6::DOUBLE + 0.4::DOUBLE * row_number() OVER (PARTITION BY session_id ORDER BY ord) / count(*) OVER (PARTITION BY session_id)) * CASE WHEN decisions > 0 THEN 1.3::DOUBLE ELSE 1.0 END
        * CASE WHEN contains(topic, 'topic 3') THEN 1.75::DOUBLE ELSE 1.0 END AS weight FROM t)
    SELECT session_id, ord, greatest(200, CAST(floor(floor(6000 / n) * (weight / (sum(weight) OVER (PARTITION BY session_id) / n)) + 0.5) AS BIGINT)) AS budget FROM w""",
)
def topic_budgets(lineage: DataFrame) -> DataFrame:
    return R.topic_budgets(lineage.sparkSession.sql(_TOPICS, lineage=lineage), 6000, focus="Topic 3")


@query(
    "run_modes",
    "runs",
    sql="""SELECT run_id, CASE WHEN total_input + total_output < 5000 OR context_percent < 60 THEN 'none' WHEN context_percent < 80 THEN 'light' ELSE 'full' END AS tier,
        CASE profile WHEN 'light' THEN 'thorough' WHEN 'aggressive' THEN 'fast' ELSE 'balanced' END AS legacy,
        CASE WHEN context_percent >= 85 THEN 'fast' WHEN 2 * gaps + patches + total_calls + ceil(total_calls / 5) + ceil(gaps / 4) >= 12 THEN 'thorough'
            WHEN 2 * gaps + patches + total_calls + ceil(total_calls / 5) + ceil(gaps / 4) <= 3 THEN 'fast' ELSE 'balanced' END AS mode,
        CAST(least(12, gaps * 2 + patches + ceil((total_calls + gaps) / 5)) AS BIGINT) AS continuity_risk,
        least(greatest(1000, total_calls * 250), 4096, 3000) AS output_limit, CASE WHEN total_output <= 0 THEN 6 ELSE least(total_output, 6) END AS calls,
        CASE WHEN gaps > 0 AND (patches > 0 OR total_calls > 3) THEN 'debugging' WHEN total_input > 2 AND patches = 0 AND gaps = 0 THEN 'review' ELSE
            CASE WHEN gaps > 0 AND patches = 0 THEN 'implementation' ELSE 'implementation' END END AS session_type
    FROM {runs}""",
)
def run_modes(runs: DataFrame) -> DataFrame:
    c = F.col
    zero = F.lit(0)
    score = R.risk(c("gaps"), c("patches"), c("total_calls"), c("total_calls"), c("gaps"), zero)
    return runs.select(
        "run_id",
        R.tier(c("context_percent"), c("total_input") + c("total_output")).alias("tier"),
        R.legacy_mode(c("profile")).alias("legacy"),
        R.resolved_mode(c("context_percent"), score).alias("mode"),
        R.continuity_risk(c("gaps"), c("patches"), c("total_calls"), c("gaps")).alias("continuity_risk"),
        R.batch_output("balanced", c("total_calls"), F.lit(3000)).cast("long").alias("output_limit"),
        R.effective_budget(c("total_output"), 6).cast("long").alias("calls"),
        R.session_type(c("patches"), c("total_input"), c("gaps"), c("gaps"), F.when(c("total_calls") > 3, 1).otherwise(0)).alias("session_type"),
    )


@query(
    "yield_gate",
    "runs",
    sql="""SELECT run_id, CASE WHEN total_calls * 1000 + 0.5 * total_input + total_output > 4000 + 1 THEN 'target-miss'
        WHEN CASE WHEN total_input > 0 THEN greatest(0.0, total_input - (total_calls * 1000 + 0.5 * total_input + total_output)) / total_input ELSE 0 END < 0.1 THEN 'insufficient-saving' END AS refused,
        round(CASE WHEN total_input > 0 THEN total_input / 9000.0 * 100 ELSE 0 END, 6) AS percent FROM {runs}""",
)
def yield_gate(runs: DataFrame) -> DataFrame:
    refused = R.yield_gate(F.col("total_input"), F.col("total_calls") * 1000, F.col("total_input") * 0.5, F.col("total_output"), F.lit(4000))
    return runs.select("run_id", refused.alias("refused"), F.round(context_percent(F.col("total_input"), F.lit(9000)), 6).alias("percent"))


@query(
    "damage_profiles",
    "damage",
    sql="""WITH r AS (SELECT run_id, damage_score, row_number() OVER (PARTITION BY run_id ORDER BY damage_score DESC) AS n FROM {damage}),
    m AS (SELECT run_id, list_sort(list(damage_score))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM r WHERE n <= 3 GROUP BY 1)
    SELECT run_id, median, CASE WHEN median >= 50 THEN 30000 WHEN median >= 25 THEN 25000 ELSE 20000 END::BIGINT AS keep,
        CASE WHEN median >= 50 THEN 7800 WHEN median >= 25 THEN 7200 ELSE 6000 END::BIGINT AS summary FROM m""",
)
def damage_profiles(damage: DataFrame) -> DataFrame:
    """The upper middle of a run's three worst observations widens its budgets."""
    top = newest(damage, 3, "run_id", order="damage_score")
    ordered = F.array_sort(F.collect_list("damage_score"))
    median = top.groupBy("run_id").agg(F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")).alias("median"))
    keep, summary = R.damage_profile(F.col("median"), F.lit(20_000).cast("long"), F.lit(6000).cast("long"))
    return median.select("run_id", "median", keep.alias("keep"), summary.alias("summary"))


@query("session_topics", "calls", "results", "turns")
def session_topics(calls: DataFrame, results: DataFrame, turns: DataFrame) -> DataFrame:
    steps = O.tool_steps(calls, results).select("session_id", "call_id", "operation", "path")
    base = F.element_at(F.split("path", "/"), -1)
    known = turns.join(steps, ["session_id", "call_id"], "left")
    where = turns.where("role = 'assistant'").select("session_id", "call_id", F.col("idx").alias("call_idx"))
    assistant = F.col("role") == "assistant"
    frame = known.join(where, ["session_id", "call_id"], "left").select(
        "session_id", "idx", "role", "tokens",
        F.col("text").rlike(O.SHIFT).alias("shift"),
        F.when(assistant, F.col("path")).alias("path"),
        F.when(assistant & ~base.isin("index.ts"), base).alias("telling"),
        F.when(assistant, F.col("operation")).alias("operation"),
        F.when(F.col("role") == "toolResult", F.col("call_idx")).alias("call_idx"),
        F.col("is_error").alias("failed"),
    )
    return R.topics(frame)


@query(
    "extraction_confidence",
    "runs",
    sql="""SELECT run_id, round(least(1.0, greatest(0.0, 0.45 + 0.15 + CASE WHEN total_calls > 0 THEN 0.05 ELSE 0 END + CASE WHEN patches > 0 THEN 0.1 ELSE 0 END + CASE WHEN gaps > 0 THEN 0.15 ELSE 0 END
        + CASE WHEN total_calls > 80 THEN -0.2 ELSE 0 END + CASE WHEN total_input * 10 > 40000 THEN -0.4 ELSE 0 END + CASE WHEN total_calls > 0 AND total_input * 10 / total_calls > 2000 THEN -0.35 ELSE 0 END
        + CASE WHEN tool_percent > 60 THEN -0.25 ELSE 0 END + CASE WHEN total_calls > 6 THEN -0.15 ELSE 0 END + CASE WHEN gaps > 2 THEN -0.2 ELSE 0 END)), 6) AS confidence,
        NOT (total_calls <= 3 AND gaps <= 1 AND patches <= 2 AND gaps <= 2) AS explore FROM {runs}""",
)
def extraction_confidence(runs: DataFrame) -> DataFrame:
    c = F.col
    score = R.extraction_confidence(
        F.lit("goal"), c("total_calls"), c("patches"), c("gaps"), c("total_input") * 10, c("tool_percent"), c("total_calls"), c("gaps"), F.lit(0)
    )
    return runs.select("run_id", F.round(score, 6).alias("confidence"), R.worth_exploring(c("total_calls"), c("gaps"), c("patches"), c("gaps")).alias("explore"))
