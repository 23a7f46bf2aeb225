"""Queries of the state machines' batch forms, incremental plans, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.shell import file_operations
from threadloom.operators import llm_seam as L
from threadloom.plans.registry import query
from threadloom.streaming import state as Z



@query(
    "damage_monitor",
    "tool_events",
    sql="""
    WITH e AS (SELECT session_id, ts AS "at", event_id, operation = 'mutate' AS act, CASE WHEN is_error THEN 1.0::DOUBLE ELSE 0.0 END AS damage FROM {tool_events}),
    o AS (SELECT *, max(CASE WHEN act THEN "at" END) OVER (PARTITION BY session_id ORDER BY "at", CASE WHEN act THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS owner FROM e),
    p AS (SELECT *, row_number() OVER (PARTITION BY session_id, owner ORDER BY "at") AS place FROM o WHERE NOT act AND owner IS NOT NULL),
    g AS (SELECT session_id, owner, min(place) FILTER (WHERE damage > 0) AS hit, max(place) AS held FROM p WHERE place <= 15 GROUP BY 1, 2)
    SELECT session_id, owner AS activated, CAST(coalesce(hit, held) AS INT) AS emitted_after, CASE WHEN hit IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS damage FROM g WHERE hit IS NOT NULL OR held = 15""",
)
def damage_monitor(events: DataFrame) -> DataFrame:
    acts = events.where("operation = 'mutate'").select("session_id", F.col("ts").alias("at"))
    rest = events.where("operation <> 'mutate'").select("session_id", F.col("ts").alias("at"), F.when(F.col("is_error"), 1.0).otherwise(0.0).alias("damage"))
    return Z.monitor(rest, acts)


@query(
    "slot_outcomes",
    "tool_events",
    sql="""
    WITH e AS (SELECT session_id AS key, ts AS "at", event_id % 3 AS run, CASE operation WHEN 'mutate' THEN 0 ELSE 1 END AS op FROM {tool_events} WHERE operation IN ('mutate', 'execute')),
    s AS (SELECT *, max(CASE WHEN op = 0 THEN "at" END) OVER w AS set_at, arg_max(CASE WHEN op = 0 THEN run END, CASE WHEN op = 0 THEN "at" END) OVER w AS set_run, max(CASE WHEN op = 1 THEN "at" END) OVER w AS take_at FROM e
        WINDOW w AS (PARTITION BY key ORDER BY "at", op ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT key, "at", run, CASE WHEN set_at IS NULL OR take_at >= set_at THEN 'empty' WHEN epoch_us("at") - epoch_us(set_at) > 36000000000 THEN 'expired' WHEN run <> set_run THEN 'mismatch' ELSE 'ok' END AS outcome FROM s WHERE op = 1""",
)
def slot_outcomes(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("session_id").alias("key"), F.col("ts").alias("at"), (F.col("event_id") % 3).alias("run"), "operation")
    return Z.slot_outcomes(rows.where("operation = 'mutate'").drop("operation"), rows.where("operation = 'execute'").drop("operation"), minutes=600)


@query(
    "commit_outcomes",
    "tool_events",
    sql="""
    WITH s AS (SELECT session_id, event_id % 20 AS run, ts AS "at" FROM {tool_events} WHERE operation = 'mutate'), a AS (SELECT session_id, event_id % 20 AS run, ts AS "at" FROM {tool_events} WHERE operation = 'read'),
    m AS (SELECT s.session_id, s.run, s."at", min(a."at") AS applied FROM s LEFT JOIN a ON a.session_id = s.session_id AND a.run = s.run AND a."at" >= s."at" GROUP BY 1, 2, 3)
    SELECT session_id, run, CASE WHEN applied IS NULL THEN 'discarded' WHEN epoch_us(applied) - epoch_us("at") > 360000000000 THEN 'expired' ELSE 'committed' END AS status FROM m""",
)
def commit_outcomes(events: DataFrame) -> DataFrame:
    rows = events.select("session_id", (F.col("event_id") % 20).alias("run"), F.col("ts").alias("at"), "operation")
    return Z.commits(rows.where("operation = 'mutate'").drop("operation"), rows.where("operation = 'read'").drop("operation"), minutes=6000)


@query(
    "settled_triggers",
    "tool_events",
    sql="""
    WITH RECURSIVE d AS (SELECT session_id, epoch_us(ts) AS m, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS i FROM {tool_events} WHERE operation = 'search' AND value >= 30),
    f AS (SELECT session_id, m, i, m AS last, true AS fired FROM d WHERE i = 1
        UNION ALL SELECT d.session_id, d.m, d.i, CASE WHEN d.m - f.last >= 86400000000 THEN d.m ELSE f.last END, d.m - f.last >= 86400000000 FROM f JOIN d ON d.session_id = f.session_id AND d.i = f.i + 1)
    SELECT session_id, m AS at_us FROM f WHERE fired""",
)
def settled_triggers(events: DataFrame) -> DataFrame:
    rows = events.select("session_id", F.col("ts").alias("at"), (F.col("operation") == "search").alias("idle"), F.col("value").alias("tokens"), F.lit(90).alias("percent"))
    return Z.settled_triggers(rows, 30, 80, minutes=1440)


@query(
    "latest_states",
    "tool_events",
    sql="SELECT session_id, path, event_id, operation FROM {tool_events} QUALIFY row_number() OVER (PARTITION BY session_id, path ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_states(events: DataFrame) -> DataFrame:
    rows = events.select("session_id", "path", "event_id", "operation", F.struct("ts", "event_id").alias("at"))
    return Z.coalesced(rows, "session_id", "path").drop("at")


@query(
    "incremental_plan",
    "lineage",
    sql="""
    WITH c AS (SELECT session_id, list(CAST(branch_id AS VARCHAR) ORDER BY lineage_rank) AS ids FROM {lineage} GROUP BY 1),
    k AS (SELECT session_id, len(ids) AS n, CASE session_id % 6 WHEN 0 THEN NULL WHEN 1 THEN len(ids) + 1 WHEN 3 THEN len(ids) WHEN 4 THEN greatest(1, len(ids) - 2) ELSE 1 END AS count, session_id % 6 = 2 AS other FROM c),
    r AS (SELECT *, CASE WHEN count IS NULL THEN 'no-cache' WHEN count > n THEN 'cache-domain-ahead' WHEN other THEN 'entry-prefix-mismatch' WHEN count = n THEN 'exact' ELSE 'incremental' END AS reason FROM k)
    SELECT session_id, reason, CASE WHEN reason IN ('exact', 'incremental') THEN CAST(count AS BIGINT) ELSE 0 END AS from_idx FROM r""",
)
def incremental_plan(lineage: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("lineage_rank", "branch_id"))), lambda x: x["branch_id"].cast("string"))
    current = lineage.groupBy("session_id").agg(ordered.alias("ids"))
    kind, n = F.col("session_id") % 6, F.size("ids")
    count = F.when(kind == 1, n + 1).when(kind == 3, n).when(kind == 4, F.greatest(F.lit(1), n - 2)).otherwise(F.lit(1))
    digest = F.when(kind == 2, "other").otherwise(F.sha2(F.array_join(F.slice("ids", F.lit(1), F.col("count")), "\n"), 256))
    cached = current.where(kind != 0).withColumn("count", count).withColumn("hash", digest)
    return Z.incremental_plan(cached, current)


@query(
    "event_windows",
    "events",
    sql="SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM {events} GROUP BY 1, 2",
)
def event_windows(events: DataFrame) -> DataFrame:
    found = Z.event_windows(events)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


@query(
    "call_deadlines",
    "llm_calls",
    sql="""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 20000::BIGINT ELSE CAST(floor(least(90000, greatest(15000, 10000 + input_tokens * 8)) * CASE provider WHEN 'p1' THEN 1.2::DOUBLE ELSE 1.0 END + 0.5) AS BIGINT) END AS ms FROM {llm_calls}""",
)
def call_deadlines(calls: DataFrame) -> DataFrame:
    configured = F.when(F.col("event_id") % 9 == 0, F.lit(20_000)).otherwise(F.lit(0)).cast("long")
    factor = F.when(F.col("provider") == "p1", 1.2).otherwise(1.0)
    return calls.select("event_id", Z.watchdog_ms(F.col("input_tokens"), configured, factor).alias("ms"))


@query(
    "shell_operations",
    "steps",
    sql="""SELECT event_id, path || '.bak' AS path, 'mutate' AS op FROM {steps} UNION ALL SELECT event_id, path, 'delete' FROM {steps} WHERE k % 2 = 0
    UNION ALL SELECT event_id, 'out ' || CAST(k AS VARCHAR) || '.log', 'mutate' FROM {steps}""",
)
def shell_operations(steps: DataFrame) -> DataFrame:
    """C11–C14 on commands with options, wrappers, quotes and redirects."""
    log = F.concat(F.lit("'out "), F.col("k").cast("string"), F.lit(".log'"))
    remove = F.when(F.col("k") % 2 == 0, F.concat(F.lit("sudo rm -f "), "path")).otherwise(F.lit("rm -f $HOME/x"))
    command = F.concat(F.lit("A=1 env -i touch "), "path", F.lit(".bak && "), remove, F.lit("; npm test | tee -a /dev/null > "), log)
    return steps.select("event_id", F.explode(file_operations(command)).alias("f")).select("event_id", "f.path", "f.op")


@query(
    "dry_run_completions",
    "runs",
    sql="""SELECT run_key AS request_id, 'batch' AS phase, concat('Summarise ', run_id) AS text, true AS ok, CAST(ceil(length(concat('Summarise ', run_id, chr(10), 'x')) / 3.8) AS BIGINT) AS input_tokens,
    CAST(length(concat('Summarise ', run_id)) AS BIGINT) AS output_chars FROM {runs}""",
)
def dry_run_completions(runs: DataFrame) -> DataFrame:
    requests = runs.select(F.col("run_key").alias("request_id"), F.lit("batch").alias("phase"), F.concat(F.lit("Summarise "), "run_id", F.lit("\nx")).alias("prompt"))
    return L.completed(requests)
