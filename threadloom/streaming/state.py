"""Keyed state over time: batch forms of the state machines, and their streaming functions.

Each machine keeps state per key in processing order. The batch form gives the same answer
from a table of events with windows and as-of joins; the streaming form keeps the state in
Spark's state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values.
MONITORED, SLOT_MINUTES, SLOTS, COMMITS = 15, 5, 64, 16
COOLDOWN_MINUTES = 10

# ---------------------------------------------------------------- batch forms


def monitor(messages: DataFrame, activations: DataFrame, most: int = MONITORED) -> DataFrame:
    """Per activation the buffer's outcome: the first damaging message, or the end of it.

    ``messages`` (session_id, at, damage), ``activations`` (session_id, at). A message belongs
    to the latest activation before it.
    """
    marked = messages.withColumn("activation", F.lit(None).cast(messages.schema["at"].dataType)).unionByName(
        activations.select("session_id", "at", F.lit(None).cast("double").alias("damage"), F.col("at").alias("activation"))
    )
    first = F.col("activation").isNotNull().cast("int")
    upto = Window.partitionBy("session_id").orderBy("at", F.desc(first)).rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("owner", F.last("activation", ignorenulls=True).over(upto)).where("activation IS NULL AND owner IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("session_id", "owner").orderBy("at"))
    buffer = owned.withColumn("place", place).where(F.col("place") <= most)
    hit = F.min(F.when(F.col("damage") > 0, F.col("place")))
    ended = buffer.groupBy("session_id", "owner").agg(hit.alias("hit"), F.max("place").alias("held"), F.min_by("damage", F.when(F.col("damage") > 0, F.col("place"))).alias("damage"))
    done = ended.where((F.col("hit").isNotNull()) | (F.col("held") == most))
    return done.select("session_id", F.col("owner").alias("activated"), F.coalesce("hit", "held").alias("emitted_after"), F.coalesce("damage", F.lit(0.0)).alias("damage"))


def slot_outcomes(sets: DataFrame, takes: DataFrame, minutes: int = SLOT_MINUTES) -> DataFrame:
    """What each take of a key finds: ok, empty, expired or mismatch; a value is taken once.

    ``sets`` (key, at, run), ``takes`` (key, at, run): the take's run must be the set's.
    """
    both = sets.withColumn("op", F.lit(0)).unionByName(takes.withColumn("op", F.lit(1)))
    upto = Window.partitionBy("key").orderBy("at", "op").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumns(
        {
            "set_at": F.last(F.when(F.col("op") == 0, F.col("at")), ignorenulls=True).over(upto),
            "set_run": F.last(F.when(F.col("op") == 0, F.col("run")), ignorenulls=True).over(upto),
            "take_at": F.last(F.when(F.col("op") == 1, F.col("at")), ignorenulls=True).over(upto),
        }
    ).where("op = 1")
    late = F.col("at") - F.col("set_at") > F.expr(f"INTERVAL '{minutes}' MINUTE")
    outcome = (
        F.when(F.col("set_at").isNull() | (F.col("take_at") >= F.col("set_at")), "empty")
        .when(late, "expired")
        .when(F.col("run") != F.col("set_run"), "mismatch")
        .otherwise("ok")
    )
    return seen.select("key", "at", "run", outcome.alias("outcome"))


def commits(staged: DataFrame, applied: DataFrame, minutes: int = SLOT_MINUTES) -> DataFrame:
    """Staged candidates with what became of them."""
    hit = applied.select(F.col("run").alias("r"), F.col("session_id").alias("s"), F.col("at").alias("applied_at"))
    met = staged.join(hit, (F.col("run") == F.col("r")) & (F.col("session_id") == F.col("s")) & (F.col("applied_at") >= F.col("at")), "left")
    first = met.groupBy("session_id", "run", "at").agg(F.min("applied_at").alias("applied_at"))
    late = F.col("applied_at") - F.col("at") > F.expr(f"INTERVAL '{minutes}' MINUTE")
    status = F.when(F.col("applied_at").isNull(), "discarded").when(late, "expired").otherwise("committed")
    return first.select("session_id", "run", status.alias("status"))


def settled_triggers(events: DataFrame, least_tokens: int, percent: int, minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """Which idle moments trigger: over both thresholds and not within the cool-down of the
    last trigger of the session. A fold over a session's candidate moments in order."""
    due = events.where(F.col("idle") & (F.col("tokens") >= least_tokens) & (F.col("percent") >= percent))
    moments = F.array_sort(F.collect_list(F.unix_micros(F.col("at").cast("timestamp"))))
    gap = minutes * 60_000_000
    fold = F.aggregate(
        moments,
        F.array().cast("array<bigint>"),
        lambda a, m: F.when((F.size(a) == 0) | (m - F.coalesce(F.element_at(a, -1), F.lit(0)) >= gap), F.concat(a, F.array(m))).otherwise(a),
    )
    return due.groupBy("session_id").agg(fold.alias("t")).select("session_id", F.explode("t").alias("at_us"))


def coalesced(updates: DataFrame, *keys: str, order: str = "at") -> DataFrame:
    """Only the latest state of each key is indexed."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return updates.withColumn("__n__", F.row_number().over(last)).where("__n__ = 1").drop("__n__")


def incremental_plan(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Per session whether its cached facts cover all, a prefix, or nothing of it, and from
    where facts are to be found anew.

    ``cached`` (session_id, count, hash, ids) and ``current`` (session_id, ids).
    """
    both = current.join(cached.withColumnRenamed("ids", "cached_ids"), "session_id", "left")
    prefix = F.sha2(F.array_join(F.slice("ids", F.lit(1), F.greatest(F.lit(1), F.coalesce("count", F.lit(1)))), "\n"), 256)
    reason = (
        F.when(F.col("count").isNull(), "no-cache")
        .when(F.col("count") > F.size("ids"), "cache-domain-ahead")
        .when(prefix != F.col("hash"), "entry-prefix-mismatch")
        .when(F.col("count") == F.size("ids"), "exact")
        .otherwise("incremental")
    )
    hit = F.col("reason").isin("exact", "incremental")
    return both.withColumn("reason", reason).select("session_id", "reason", F.when(hit, F.col("count")).otherwise(0).cast("long").alias("from_idx"))


def event_windows(events: DataFrame, width: str = "1 day", *, late: str | None = None) -> DataFrame:
    """Beyond the reference: counts and sums per window and type; with ``late`` on a stream."""
    source = events.withWatermark("ts", late) if late else events
    grouped = source.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "events", "value")


# ---------------------------------------------------------------- streaming forms

MONITOR_OUT = "session_id long, emitted_after long, damage double"
MONITOR_STATE = "held long"


def monitored(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Z1 on a stream: an activation (damage is null) starts a buffer; it ends once, at the first
    damage or when it is full."""
    held = state.get[0] if state.exists else -1
    rows = pd.concat(list(batches)).sort_values("at")
    out = []
    for damage in rows["damage"]:
        if pd.isna(damage):
            held = 0
        elif held >= 0:
            held += 1
            if damage > 0 or held >= MONITORED:
                out.append((key[0], held, float(damage)))
                held = -1
    state.update((held,))
    yield pd.DataFrame(out, columns=["session_id", "emitted_after", "damage"])


def monitor_stream(stream: DataFrame) -> DataFrame:
    """The stream (session_id, at, damage) of messages and activations, monitored."""
    return stream.groupBy("session_id").applyInPandasWithState(monitored, MONITOR_OUT, MONITOR_STATE, "append", GroupStateTimeout.NoTimeout)


SLOT_OUT = "key long, run long, outcome string"
SLOT_STATE = "run long, at_ms long"


def slotted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Z2 on a stream of sets and takes (``op``): one slot per key, taken once, with an age limit."""
    run, at = state.get if state.exists else (-1, 0)
    rows = pd.concat(list(batches)).sort_values(["at", "op"])
    out = []
    for moment, op, wanted in zip(rows["at"], rows["op"], rows["run"], strict=True):
        now = int(pd.Timestamp(moment).value // 1_000_000)
        if op == 0:
            run, at = int(wanted), now
            continue
        if run < 0:
            found = "empty"
        elif now - at > SLOT_MINUTES * 60_000:
            found = "expired"
        else:
            found = "ok" if run == wanted else "mismatch"
        out.append((key[0], int(wanted), found))
        run = -1
    state.update((run, at))
    yield pd.DataFrame(out, columns=["key", "run", "outcome"])


def slot_stream(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").applyInPandasWithState(slotted, SLOT_OUT, SLOT_STATE, "append", GroupStateTimeout.NoTimeout)


def latest_into(path: str, *keys: str):
    """A foreachBatch sink that keeps the latest row of each key of a batch."""

    def sink(batch: DataFrame, epoch: int) -> None:
        coalesced(batch, *keys).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def watchdog_ms(tokens: Column, configured: Column, multiplier: Column) -> Column:
    """How long a call may take, 15 to 90 seconds by its tokens, times a factor."""
    base = F.least(F.lit(90_000), F.greatest(F.lit(15_000), F.coalesce(tokens, F.lit(4096)) * 8 + 10_000))
    return F.when(configured > 0, configured).otherwise(F.floor(base * multiplier + F.lit(0.5)).cast("long"))
