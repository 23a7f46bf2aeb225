"""Retry windows, file states, lineage, recall and gates on literal sessions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import facts as O
from threadloom.operators import graph as G
from threadloom.operators import state as S
from threadloom.operators import telemetry as T
from threadloom.streaming import state as Z

CALLS = "session_id long, idx long, call_id string, name string, args string"
RESULTS = "session_id long, idx long, call_id string, is_error boolean, text string"


def session(spark, exchanges):
    """Exchanges (call idx, result idx, name, arguments, is_error, text) of one session."""
    calls = [(1, c, f"c{c}", name, json.dumps(args)) for c, _, name, args, _, _ in exchanges]
    results = [(1, r, f"c{c}", bad, text) for c, r, _, _, bad, text in exchanges]
    return O.tool_steps(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS))


@pytest.mark.parametrize(
    ("again", "done", "retried", "resolved"),
    [(6, 7, True, True), (7, 8, False, False), (6, 15, True, True), (6, 16, True, False)],
)
def test_retry_windows(spark, again, done, retried, resolved):
    run = {"command": "npm test"}
    steps = session(spark, [(0, 1, "bash", run, True, "boom"), (again, done, "bash", run, False, "ok")])
    row = O.retried_errors(O.error_catalog(steps), steps).first()
    assert (row["retried"], row["resolved"]) == (retried, resolved)


def test_retry_flags_do_not_matter(spark):
    steps = session(spark, [(0, 1, "bash", {"command": "npm  test --retry=3"}, True, "x"), (2, 3, "bash", {"cmd": "npm test"}, False, "ok"), (4, 5, "bash", {"command": "npm test x"}, False, "ok")])
    assert O.retried_errors(O.error_catalog(steps), steps).first()["resolved"]


def test_file_states(spark):
    w, d, r = {"path": "a", "content": ""}, {"path": "a"}, {"path": "a"}
    cases = {
        "write, delete": [("write", w, "ok"), ("deleteFile", d, "ok")],
        "delete, write": [("deleteFile", d, "ok"), ("write", w, "ok")],
        "delete, read": [("deleteFile", d, "ok"), ("read", r, "ok")],
        "no-op": [("write", w, "No changes applied")],
        "cut no-op": [("write", w, "No changes applied…✂99")],
        "rm": [("write", w, "ok"), ("bash", {"command": "rm a"}, "ok")],
        "failed rm": [("write", w, "ok"), ("bash", {"command": "rm a"}, "Command exited with code 1")],
    }
    got = {}
    for name, acts in cases.items():
        steps = session(spark, [(2 * i, 2 * i + 1, n, a, False, t) for i, (n, a, t) in enumerate(acts)])
        rows = O.file_states(steps).collect()
        got[name] = [(x["modified_count"], x["last_read"] is not None, x["deleted_at"] is not None) for x in rows]
    assert got == {
        "write, delete": [(0, False, True)], "delete, write": [(1, False, False)], "delete, read": [(0, True, False)], "no-op": [],
        "cut no-op": [(1, False, False)], "rm": [(0, False, True)], "failed rm": [(1, False, False)],
    }


def test_benign_searches(spark):
    steps = session(
        spark,
        [
            (0, 1, "bash", {"command": "rg x && grep y z"}, True, "Command exited with code 1"),
            (2, 3, "bash", {"command": "rg x; rm y"}, True, "Command exited with code 1"),
            (4, 5, "bash", {"command": "rg x"}, True, "rg: bad\nCommand exited with code 2"),
        ],
    )
    assert sorted(r["idx"] for r in O.error_catalog(steps).collect()) == [3, 5]


def test_facts_of_siblings(spark):
    """A fact resolved on one branch stays active on its sibling."""
    rows = [("left", 0, "active", 1), ("left", 1, "resolved", 2), ("right", 0, "active", 1)]
    facts = spark.createDataFrame([(b, "decision", "Use X", rank, s, at, rank) for b, rank, s, at in rows], "session_id string, kind string, text string, lineage_rank long, status string, updated_at long, branch_id long")
    got = {r["session_id"]: r["status"] for r in S.latest_facts(facts).collect()}
    assert got == {"left": "resolved", "right": "active"}


def test_merge_is_idempotent(spark):
    rows = [(1, "decision", i, f"text {i % 4}") for i in range(9)]
    items = spark.createDataFrame(rows, "session_id long, kind string, ord long, text string")
    once = S.merged(items, items.limit(0))
    again = S.merged(once.select("session_id", "kind", F.col("place").cast("long").alias("ord"), "text"), items)
    assert [r["text"] for r in once.orderBy("place").collect()] == [r["text"] for r in again.orderBy("place").collect()]


def test_recall_prefers_kind_and_manual(spark):
    rows = [("a", "decision", "cache policy", "x", "compaction"), ("b", "topic", "cache policy", "x", "manual"), ("c", "topic", "other", "cache", "compaction"), ("d", "session", "cache", "cache", "compaction")]
    nodes = spark.createDataFrame(rows, "node_id string, kind string, title string, content string, source string").withColumns(
        {"status": F.lit("active"), "confidence": F.lit(0.9), "session_id": F.lit(1), "updated_at": F.lit("2024-01-01").cast("timestamp")}
    )
    edges = spark.createDataFrame([("a", "c", 0.9)], "from_id string, to_id string, weight double")
    got = [r["node_id"] for r in G.recall(nodes, edges, G.postings(nodes), ["cache"], F.lit("2024-01-02").cast("date")).collect()]
    assert got[0] == "a" and set(got) == {"a", "b", "c"}
    kinds = G.recall(nodes, edges, G.postings(nodes), ["cache"], F.lit("2024-01-02").cast("date"), kinds=("topic",)).collect()
    assert {r["node_id"] for r in kinds} == {"b", "c"}


def runs(spark, canary_errors, n=20):
    rows = [(i, f"run-{100000 + i}", "canary" if i >= 40 else "stable", "error" if i >= 40 and i - 40 < canary_errors else "success") for i in range(40 + n)]
    frame = spark.createDataFrame(rows, "run_key long, run_id string, release_channel string, status string")
    return frame.withColumns(
        {"metrics_schema_version": F.lit(2), "version": F.lit("1"), "verification_score": F.lit(90.0), "duration_ms": F.lit(500), "avg_latency": F.lit(500), "total_input": F.lit(10),
         "cache_hit": F.lit(0), "cache_write": F.lit(0), "total_output": F.lit(1), "method": F.lit("staged")}
    )


@pytest.mark.parametrize(("errors", "n", "decision"), [(0, 20, "promote"), (1, 20, "promote"), (2, 20, "rollback"), (0, 19, "hold"), (2, 2, "hold"), (3, 3, "rollback")])
def test_canary(spark, errors, n, decision):
    frame = runs(spark, errors, n)
    damage = frame.select("run_id", F.lit(0.0).alias("damage_score"))
    assert T.assess_canary(frame, damage, "1").first()["decision"] == decision


def test_late_events_on_a_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    for i, stamps in enumerate([["2024-01-01 10:00:00", "2024-01-03 10:00:00"], ["2024-01-01 11:00:00", "2024-01-05 10:00:00"]]):
        rows = spark.createDataFrame([(s, "view", 1.0) for s in stamps], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/batch={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    query = Z.event_windows(stream, late="1 hour").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    days = {str(r["start"])[:10]: r["events"] for r in spark.table("windows").collect()}
    assert set(days) <= {"2024-01-01", "2024-01-03", "2024-01-05"} and days.get("2024-01-01") in (1, 2)


def test_tool_share_rounds_exact_halves_up(spark):
    """23 of 40 characters are 57.5 percent: 58, though 23 / 40 * 100 falls just short of 57.5 as a double."""
    sizes = [(1, 17, 23), (2, 3, 1), (3, 0, 0), (4, 199, 1)]
    messages = spark.createDataFrame([(k, "m" * n) for k, n, _ in sizes], "session_id long, text string")
    results = spark.createDataFrame([(k, "r" * n) for k, _, n in sizes], "session_id long, text string")
    shares = {r["session_id"]: r["tool_percent"] for r in O.tool_share(messages, results).collect()}
    assert shares == {1: 58, 2: 25, 3: 0, 4: 1}
