"""Run and call telemetry: rollups, window statistics, gates, confidence and health scores.

Every function takes and returns DataFrames; nothing is collected. Runs have the columns
run_id, ts, metrics_schema_version, version, release_channel, status, provider, model,
verification_score, duration_ms, avg_latency, total_calls, total_input, total_output,
cache_hit, cache_write, context_percent, tool_percent, method, failure_kind, and run_key,
which orders the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.numbers import at_least_zero, clamp, half_up, half_up_long, prompt_tokens, safe_label

# Failure kinds in the order in which rules are tried.
FAILURE_KINDS = (
    "cancelled", "timeout", "rate-limit", "authentication", "budget", "output-limit",
    "provider", "persistence", "validation", "verification", "yield", "internal",
)
FAILURE_RULES = (
    ("timeout", "timeout|timed out|watchdog|deadline"),
    ("budget", "budgetexceeded|token budget|call budget|latency budget"),
    ("rate-limit", "rate.?limit|too many requests|quota"),
    ("authentication", "unauthori[sz]ed|authentication|api.?key|credential"),
    ("output-limit", "max(?:imum)? output|output.?limit|visible output|length limit"),
    ("cancelled", "abort|cancel"),
    ("persistence", "native compaction|persist|write|rename|filesystem|sqlite|database"),
    ("verification", "verificationgateerror|verification gate|verification.*(?:gap|summary)"),
    ("validation", "invalid|validation|schema|malformed|required"),
    ("provider", "provider|api error|stream|network|fetch failed|socket"),
)
NAMED_FAILURES = {"verificationgateerror": "verification", "yieldgateerror": "yield"}
STATUS_FAILURES = {"rate-limit": (429,), "authentication": (401, 403)}
CANARY_NEED = 20


def provider_stage(phase: Column) -> Column:
    """M8: the stage a call's phase belongs to."""
    return (
        F.when(phase == "patch", "verify")
        .when((phase == "probe") | phase.startswith("explore"), "explore")
        .otherwise("synthesize")
    )


def scenario(context_percent: Column, tool_percent: Column) -> Column:
    """M7: pressure of the window and kind of work."""
    context, tool = F.coalesce(context_percent, F.lit(0)), F.coalesce(tool_percent, F.lit(0))
    pressure = F.when(context >= 90, "critical").when(context >= 70, "pressure").otherwise("compact")
    work = F.when(tool >= 70, "tool-heavy").when(tool >= 30, "mixed").otherwise("conversational")
    return F.concat(pressure, F.lit("/"), work)


def route_rollup(calls: DataFrame) -> DataFrame:
    """A1: one row per stage, provider and model."""
    tokens = prompt_tokens(F.col("input_tokens"), F.col("cache_hit_tokens"), F.col("cache_write_tokens"))
    return (
        calls.groupBy(provider_stage(F.col("phase")).alias("stage"), F.coalesce("provider", F.lit("unknown")).alias("provider"), "model")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum(F.col("success").cast("long")).alias("successes"),
            half_up_long(F.sum(at_least_zero(F.col("latency_ms"))) / F.count(F.lit(1))).alias("avg_latency_ms"),
            F.sum(tokens).alias("input_tokens"),
            F.sum(at_least_zero(F.col("output_tokens"))).alias("output_tokens"),
        )
    )


def call_summary(calls: DataFrame) -> DataFrame:
    """Totals, mean latency and the capped cache-hit rate over all calls."""
    prompt = prompt_tokens(F.col("total_input"), F.col("total_cache_hit"), F.col("total_cache_write"))
    totals = calls.agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output"),
        F.coalesce(F.sum("cache_hit_tokens"), F.lit(0)).alias("total_cache_hit"),
        F.coalesce(F.sum("cache_write_tokens"), F.lit(0)).alias("total_cache_write"),
        F.coalesce(half_up_long(F.avg("latency_ms")), F.lit(0)).alias("avg_latency"),
    )
    rate = F.when(prompt > 0, F.least(F.lit(1.0), F.col("total_cache_hit") / prompt)).otherwise(F.lit(0.0))
    return totals.withColumn("cache_hit_rate", F.round(rate, 6))


def legacy_route(runs: DataFrame) -> DataFrame:
    """A3: the single route that a run without a route list stands for."""
    prefix = F.concat("provider", F.lit("/"))
    model = F.when(F.col("model").startswith(prefix), F.expr("substr(model, length(provider) + 2)")).otherwise(F.col("model"))
    done = F.col("status").isin("success", "dry-run")
    return runs.where("provider <> '' AND model <> '' AND total_calls > 0").select(
        "run_id",
        "metrics_schema_version",
        scenario(F.col("context_percent"), F.col("tool_percent")).alias("scenario"),
        F.lit("synthesize").alias("stage"),
        "provider",
        model.alias("model"),
        F.col("total_calls").alias("calls"),
        F.when(done, F.col("total_calls")).otherwise(F.lit(0)).alias("successes"),
        F.col("avg_latency").alias("avg_latency_ms"),
        F.col("total_input").alias("input_tokens"),
        F.col("total_output").alias("output_tokens"),
        F.lit(None).cast("double").alias("quality_score"),
        F.lit(None).cast("string").alias("quality_basis"),
    )


def valid_route(basis: str = "pre-repair-verification") -> Column:
    """F16: whether a stored route's fields are usable."""
    numbers = F.lit(True)
    for name in ("calls", "successes", "avg_latency_ms", "input_tokens", "output_tokens"):
        value = F.col(name).cast("double")
        numbers = numbers & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    quality = F.col("quality_score").isNull() & F.col("quality_basis").isNull() | (
        F.col("quality_score").between(0, 100) & (F.col("quality_basis") == basis)
    )
    return F.coalesce(
        quality & numbers & (F.col("calls") > 0) & F.col("stage").isin("explore", "synthesize", "verify")
        & F.col("provider").isNotNull() & F.col("model").isNotNull(),
        F.lit(False),
    )


def _route_sums(routes: DataFrame, *keys: str) -> DataFrame:
    measured = (F.col("metrics_schema_version") == 2) & F.col("quality_score").isNotNull()
    return routes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("calls").alias("calls"),
        F.sum(clamp(F.col("successes"), 0, F.col("calls"))).alias("successes"),
        F.sum(at_least_zero(F.col("avg_latency_ms")) * F.col("calls")).alias("latency"),
        F.sum(at_least_zero(F.col("input_tokens")) + at_least_zero(F.col("output_tokens"))).alias("tokens"),
        F.sum(F.when(measured, F.col("quality_score"))).alias("quality"),
        F.count(F.when(measured, 1)).alias("quality_runs"),
    )


def provider_matrix(routes: DataFrame, min_samples: int = 5) -> DataFrame:
    """A2: score of each provider and model per stage and scenario, shrunk by confidence."""
    need = max(2, min_samples)
    cells = _route_sums(routes.where(valid_route()), "stage", "scenario", "provider", "model").withColumns(
        {
            "sr": F.col("successes") / F.col("calls"),
            "lat": F.col("latency") / F.col("calls"),
            "tok": F.col("tokens") / F.col("calls"),
            "q": F.col("quality") / F.nullif(F.col("quality_runs"), F.lit(0)),
            "cov": F.col("quality_runs") / F.col("runs"),
        }
    )
    quality = F.coalesce(F.col("q") / 100, F.lit(0.5))
    speed, thrift = 1 / (1 + F.col("lat") / 30000), 1 / (1 + F.col("tok") / 100000)
    raw = F.when(F.col("stage") == "explore", F.col("sr") * 0.4 + speed * 0.3 + thrift * 0.15 + quality * 0.15).otherwise(
        quality * 0.4 + F.col("sr") * 0.3 + speed * 0.2 + thrift * 0.1
    )
    confidence = F.least(F.lit(1.0), F.col("runs") / need) * (F.lit(0.5) + F.col("cov") * 0.5)
    return cells.select(
        "stage", "scenario", "provider", "model", "runs", "calls",
        half_up(F.col("sr"), 3).alias("success_rate"),
        half_up_long(F.col("lat")).alias("avg_latency_ms"),
        half_up_long(F.col("tok")).alias("avg_tokens_per_call"),
        half_up(F.col("q"), 1).alias("avg_quality"),
        half_up(F.col("cov"), 3).alias("quality_coverage"),
        half_up(F.lit(0.5) + (raw - 0.5) * confidence, 3).alias("score"),
        half_up(confidence, 3).alias("confidence"),
        F.coalesce((F.col("runs") >= need) & (F.col("sr") >= 0.8) & (F.col("cov") >= 0.5) & (F.col("q") >= 85), F.lit(False)).alias("eligible"),
    )


def provider_recommendations(cells: DataFrame) -> DataFrame:
    """A2: the best eligible model of each stage and scenario, or none."""
    best = Window.partitionBy("stage", "scenario").orderBy(F.desc("eligible"), F.desc("score"), F.desc("confidence"), "provider", "model")
    top = cells.withColumn("place", F.row_number().over(best)).where("place = 1")
    chosen = F.col("eligible")
    return top.select(
        "stage",
        "scenario",
        F.when(chosen, F.concat_ws("/", "provider", "model")).alias("model"),
        F.when(chosen, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(chosen, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
    )


def provider_insight(routes: DataFrame) -> DataFrame:
    """Reliability and cost per stage, provider and model for the dashboard."""
    label = r"\A[A-Za-z0-9_./:@+-]{1,160}\z"
    usable = routes.where(F.col("provider").rlike(label) & F.col("model").rlike(label) & (F.col("calls") > 0))
    basis = F.col("quality_basis") == "pre-repair-verification"
    usable = usable.withColumn("quality_score", F.when(basis & F.col("quality_score").between(0, 100), F.col("quality_score")))
    return _route_sums(usable, "stage", "provider", "model").select(
        "stage", "provider", "model", "runs", "calls",
        F.round(F.col("successes") / F.col("calls"), 6).alias("reliability"),
        F.round(F.col("quality") / F.nullif(F.col("quality_runs"), F.lit(0)), 6).alias("avg_quality"),
        F.round(F.col("quality_runs") / F.col("runs"), 6).alias("quality_coverage"),
        half_up_long(F.col("latency") / F.col("calls")).alias("avg_latency_ms"),
        half_up_long(F.col("tokens") / F.col("calls")).alias("avg_tokens_per_call"),
    )


def newest(runs: DataFrame, limit: int, *partition: str, order: str = "run_key") -> DataFrame:
    """The last ``limit`` rows of the log (of each partition).

    Without partition this is a distributed top-k: no task sees more than ``limit`` rows of
    each other task.
    """
    if not partition:
        return runs.orderBy(F.desc(order)).limit(limit)
    back = Window.partitionBy(*partition).orderBy(F.desc(order))
    return runs.withColumn("__back__", F.row_number().over(back)).where(F.col("__back__") <= limit).drop("__back__")


def observed_damage(damage: DataFrame) -> DataFrame:
    """One observation per run, the worst, between 0 and 100."""
    return damage.groupBy("run_id").agg(F.max(clamp(F.col("damage_score"), 0.0, 100.0)).alias("damage"))


def window_stats(runs: DataFrame, damage: DataFrame, *keys: str) -> DataFrame:
    """A4 (unrounded): statistics of the runs of each group; dry runs are no evidence.

    Damage is joined by run id; only successful runs with a usable id can have any.
    """
    evidence = ~F.col("status").eqNullSafe(F.lit("dry-run"))
    success = F.col("status") == "success"
    joined = runs.join(observed_damage(damage), "run_id", "left")
    tokens = F.col("total_input") + F.col("cache_hit") + F.coalesce("cache_write", F.lit(0)) + F.col("total_output")
    scored = F.when(success, F.col("verification_score"))
    observed = success & (F.length("run_id") >= 8) & F.col("damage").isNotNull()
    n, ok = F.count(F.when(evidence, 1)), F.count(F.when(success, 1))
    seen = F.count_distinct(F.when(observed, F.col("run_id")))
    hurt = F.count_distinct(F.when(observed & (F.col("damage") > 0), F.col("run_id")))
    joined = joined.withColumn("latency", F.when(evidence, F.coalesce("duration_ms", "avg_latency")))
    zero = F.lit(0.0)
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        n.alias("applied_runs"),
        F.when(n > 0, ok / n).otherwise(F.lit(1.0)).alias("success_rate"),
        F.avg(scored).alias("avg_quality"),
        F.when(n > 0, F.count(scored) / n).otherwise(zero).alias("quality_coverage"),
        # A6, nearest rank; Spark counts by value, so the state holds distinct values only.
        F.coalesce(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").cast("double"), zero).alias("p95_latency_ms"),
        F.coalesce(F.avg(F.when(evidence, tokens)), zero).alias("avg_tokens"),
        F.coalesce(F.avg(F.when(evidence, (F.col("method") == "heuristic").cast("double"))), zero).alias("fallback_rate"),
        F.when(seen > 0, hurt / seen).otherwise(zero).alias("damage_rate"),
        F.when(ok > 0, seen / ok).otherwise(zero).alias("damage_coverage"),
    )


RATES = ("success_rate", "quality_coverage", "fallback_rate", "damage_rate", "damage_coverage")


def rounded_stats(stats: DataFrame) -> DataFrame:
    """A5: three digits for ratios, one for quality, whole milliseconds and tokens."""
    changed = {c: half_up(F.col(c), 3) for c in RATES} | {"avg_quality": half_up(F.col("avg_quality"), 1)}
    return stats.withColumns(changed | {c: half_up_long(F.col(c)) for c in ("p95_latency_ms", "avg_tokens")})


def assess_canary(runs: DataFrame, damage: DataFrame, version: str, min_runs: int = CANARY_NEED) -> DataFrame:
    """Promote, hold or roll back a canary version; one row.

    Triggers are tried first; then the first gate that is not passed holds the canary.
    """
    need = max(5, min_runs)
    base_need = max(20, need)
    current = runs.where(F.col("metrics_schema_version") == 2)
    canary = newest(current.where((F.col("version") == version) & (F.col("release_channel") == "canary")), max(100, need))
    stable = newest(current.where(F.coalesce("release_channel", F.lit("stable")) == "stable"), max(50, 2 * need))
    sides = []
    for frame, mark in ((canary, "c"), (stable, "b")):
        stats = window_stats(frame, damage)
        sides.append(stats.select([F.col(c).alias(f"{mark}_{c}") for c in stats.columns]))
    both = sides[0].crossJoin(sides[1])  # one row each
    c = {k.removeprefix("c_"): F.col(k) for k in sides[0].columns}
    b = {k.removeprefix("b_"): F.col(k) for k in sides[1].columns}
    fail_c, fail_b = 1 - c["success_rate"], 1 - b["success_rate"]
    triggers = [
        ("failure-rate", (c["applied_runs"] >= 3) & ((fail_c > 0.050001) | (fail_c - fail_b >= 0.050001)),
         F.when(fail_c > 0.050001, ">5% absolute").otherwise("+5pp regression")),
        ("quality", (c["avg_quality"] < 85) | (b["avg_quality"] - c["avg_quality"] >= 5),
         F.when(c["avg_quality"] < 85, "<85 absolute").otherwise("-5 points")),
        ("latency", (b["p95_latency_ms"] >= 1000) & (c["p95_latency_ms"] >= b["p95_latency_ms"] * 1.5), F.lit("+50% p95")),
        ("tokens", (b["avg_tokens"] >= 1000) & (c["avg_tokens"] >= b["avg_tokens"] * 1.5), F.lit("+50%")),
        ("fallback", c["fallback_rate"] - b["fallback_rate"] >= 0.1, F.lit("+10pp")),
        ("damage", c["damage_rate"] - b["damage_rate"] >= 0.1, F.lit("+10pp")),
    ]
    crossed = F.array_compact(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.concat(F.lit(f"{name} crossed "), how)) for name, test, how in triggers])
    )
    c_full, b_full = F.least(F.lit(1.0), c["applied_runs"] / need), F.least(F.lit(1.0), b["applied_runs"] / base_need)
    confidence = 100 * (
        c_full * 0.25 + b_full * 0.15 + c["quality_coverage"] * c_full * 0.2
        + c["damage_coverage"] * c_full * 0.2 + b["damage_coverage"] * b_full * 0.2
    )
    gates = [
        (c["applied_runs"] < need, "need more canary runs with applied outcomes"),
        (b["applied_runs"] < base_need, "stable baseline is too small"),
        (c["quality_coverage"] < 0.7, "quality coverage is below 70%"),
        (c["damage_coverage"] < 0.7, "canary damage coverage is below 70%"),
        (b["damage_coverage"] < 0.7, "stable damage coverage is below 70%"),
        (F.coalesce(c["avg_quality"], F.lit(0.0)) < 85, "quality is below 85"),
        (c["success_rate"] < 0.949999, "success rate is below 95%"),
    ]
    held = F.coalesce(*[F.when(test, why) for test, why in gates])
    rollback = (F.size("crossed") > 0) & (c["applied_runs"] >= 3)
    return both.withColumns({"crossed": crossed, "held": held}).select(
        F.lit(version).alias("version"),
        F.when(rollback, "rollback").when(F.col("held").isNotNull(), "hold").otherwise("promote").alias("decision"),
        half_up_long(confidence).alias("data_confidence"),
        F.when(rollback, F.array_join("crossed", "; ")).when(F.col("held").isNotNull(), F.col("held")).otherwise("all gates passed").alias("reason"),
        F.col("c_runs").alias("canary_runs"),
        F.col("b_runs").alias("baseline_runs"),
        half_up(c["success_rate"], 3).alias("canary_success_rate"),
        half_up(b["success_rate"], 3).alias("baseline_success_rate"),
        half_up(c["avg_quality"], 1).alias("canary_quality"),
        half_up_long(c["p95_latency_ms"]).alias("canary_p95_ms"),
        half_up(c["damage_rate"], 3).alias("canary_damage_rate"),
    )


def privacy_aggregate(runs: DataFrame) -> DataFrame:
    """Totals by harmless labels only."""
    provider = safe_label(F.col("provider"), "unknown")
    model = safe_label(F.col("model"), "unknown")
    bare = F.when(F.col("m").startswith(F.concat("p", F.lit("/"))), F.expr("substr(m, length(p) + 2)")).otherwise(F.col("m"))
    labelled = runs.withColumns({"p": provider, "m": model}).withColumn("bare", bare)
    quality = F.when(F.col("metrics_schema_version") == 2, F.col("verification_score"))
    channel = F.when(F.col("release_channel") == "canary", "canary").otherwise("stable")
    return labelled.groupBy(
        safe_label(F.col("version"), "legacy").alias("version"), channel.alias("channel"), F.col("p").alias("provider"), F.col("bare").alias("model")
    ).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(F.when(F.col("status").isin("success", "dry-run"), 1)).alias("successes"),
        half_up(F.avg(quality), 1).alias("avg_quality"),
        half_up_long(F.avg("avg_latency")).alias("avg_latency_ms"),
        F.sum(F.col("total_input") + F.col("cache_hit") + F.coalesce("cache_write", F.lit(0))).alias("input_tokens"),
        F.sum("total_output").alias("output_tokens"),
    )


def failure_histogram(runs: DataFrame) -> DataFrame:
    """Counts of the known failure kinds."""
    known = runs.where(F.col("failure_kind").isin(*FAILURE_KINDS))
    return known.groupBy("failure_kind").agg(F.count(F.lit(1)).alias("runs"))


def classify_failure(name: Column, code: Column, message: Column, status: Column, timed_out: Column) -> Column:
    """Failure kind from an error's fields; rules in order, the first that fits."""
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(code, F.lit("")), F.coalesce(message, F.lit(""))))
    kind = F.when(F.coalesce(timed_out, F.lit(False)) | text.rlike(FAILURE_RULES[0][1]), "timeout")
    for error, found in NAMED_FAILURES.items():
        kind = kind.when(F.lower(name) == error, found)
    for found, pattern in FAILURE_RULES[1:]:
        test = text.rlike(pattern)
        if found in STATUS_FAILURES:
            test = test | F.coalesce(status.isin(*STATUS_FAILURES[found]), F.lit(False))
        if found == "provider":
            test = test | F.coalesce(status >= 500, F.lit(False))
        kind = kind.when(test, found)
    return kind.otherwise("internal")


def dashboard(runs: DataFrame, *keys: str) -> DataFrame:
    """Totals, mean and floor-index p95 duration; zero durations do not count.

    The percentile is found by rank, so no group's durations are gathered in one place
    unsorted: a window numbers them, and the one row wanted is picked.
    """
    frame = runs
    for key in keys:
        frame = frame.where(F.col(key).isNotNull() & (F.col(key) != ""))
    group = list(keys)
    timed = frame.where("duration_ms <> 0")
    counts = timed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    ranked = _rank_pick(timed.select(*group, "duration_ms"), counts, group)
    status = F.coalesce("status", F.lit("success"))
    totals = frame.groupBy(*group).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(F.when(status == "success", 1)).alias("success"),
        F.count(F.when(status == "timeout", 1)).alias("timeout"),
        F.count(F.when(status == "error", 1)).alias("error"),
        F.count(F.when(status == "dry-run", 1)).alias("dry_run"),
        F.coalesce(half_up_long(F.avg(F.when(F.col("duration_ms") != 0, F.col("duration_ms")))), F.lit(0)).alias("avg_duration"),
        F.sum("total_calls").alias("total_calls"),
        F.sum(F.col("total_input") + F.col("cache_hit") + F.col("cache_write")).alias("total_input"),
        F.sum("total_output").alias("total_output"),
        F.coalesce(half_up_long(F.avg("verification_score")), F.lit(0)).alias("avg_score"),
        F.round(F.count(F.when(status.isin("timeout", "error"), 1)) / F.count(F.lit(1)), 6).alias("error_rate"),
    )
    joined = totals.join(ranked, group, "left") if group else totals.crossJoin(ranked)  # one row each without keys
    return joined.withColumn("p95_duration", F.coalesce("p95_duration", F.lit(0)))


def _rank_pick(timed: DataFrame, counts: DataFrame, group: list[str]) -> DataFrame:
    """The duration at index min(n - 1, floor(0.95 n)) of each group.

    Durations are first counted by value, so what is ordered is distinct values.
    """
    by_value = timed.groupBy(*group, "duration_ms").agg(F.count(F.lit(1)).alias("m"))
    running = Window.partitionBy(*group).orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    summed = by_value.withColumn("upto", F.sum("m").over(running))
    with_n = summed.join(counts, group) if group else summed.crossJoin(counts)
    index = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return with_n.where(F.col("upto") > index).groupBy(*group).agg(F.min("duration_ms").alias("p95_duration"))


def data_confidence(runs: DataFrame, now: Column, last: int = 40) -> DataFrame:
    """How much the newest runs can be trusted, in points; one row."""
    recent = newest(runs, last)
    v2 = F.col("metrics_schema_version") == 2
    complete = (
        F.col("ts").isNotNull() & (F.coalesce("status", F.lit("")) != "") & (F.col("duration_ms") > 0)
        & (F.coalesce("provider", "model", F.lit("")) != "") & (F.coalesce("method", F.lit("")) != "")
    )
    n = F.col("n")
    counted = recent.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(v2, 1)).alias("v2"),
        F.count(F.when(v2 & F.col("verification_score").isNotNull(), 1)).alias("measured"),
        F.count(F.when(complete, 1)).alias("complete"),
        F.max("ts").alias("latest"),
    )
    age_days = F.datediff(now, F.col("latest"))
    parts = {
        "sample": F.pow(F.least(F.lit(1.0), n / 20), F.lit(3)) * 25,
        "schema": F.col("v2") / n * 25,
        "quality": F.col("measured") / n * 20,
        "completeness": F.col("complete") / n * 20,
        "freshness": F.when(age_days <= 7, 10.0).when(age_days <= 30, 5.0).otherwise(0.0),
    }
    scored = counted.select([F.when(n > 0, v).otherwise(F.lit(0.0)).alias(k) for k, v in parts.items()])
    score = half_up_long(sum((F.col(k) for k in parts), F.lit(0.0)))
    label = F.when(score >= 85, "high").when(score >= 60, "medium").otherwise("low")
    return scored.select(
        score.alias("score"), label.alias("label"), *[half_up_long(F.col(k)).alias(f"{k}_score") for k in parts]
    )


def quality_insight(runs: DataFrame) -> DataFrame:
    """Bands, repair gain and health of schema-2 runs; one row."""
    v2 = runs.where("metrics_schema_version = 2")
    score = F.col("verification_score")
    done = F.col("status").isin("success", "dry-run")
    found = v2.agg(
        F.count(score).alias("measured_runs"),
        (F.count(F.lit(1)) - F.count(score)).alias("missing_runs"),
        F.avg(score).alias("average"),
        F.median(score).alias("median"),
        F.min(score).alias("minimum"),
        F.count(F.when(score >= 90, 1)).alias("excellent"),
        F.count(F.when((score >= 75) & (score < 90), 1)).alias("passing"),
        F.count(F.when(score < 75, 1)).alias("low"),
        F.round(F.avg("initial_score"), 6).alias("average_initial"),
        F.round(F.avg(score - F.col("initial_score")), 6).alias("average_gain"),
        F.count(F.when(F.col("patches") > 0, 1)).alias("patched_runs"),
        F.coalesce(F.sum(F.coalesce("gaps", F.lit(0))), F.lit(0)).alias("remaining_gaps"),
        (F.count(F.when(score >= 85, 1)) / F.nullif(F.count(score), F.lit(0))).alias("pass_rate"),
        F.avg((F.coalesce("gaps", F.lit(0)) == 0).cast("double")).alias("gap_free"),
        F.avg(done.cast("double")).alias("done"),
    )
    health = F.col("average") / 100 * 60 + F.col("pass_rate") * 20 + F.col("gap_free") * 10 + F.col("done") * 10
    scored = found.withColumn("health_score", F.coalesce(half_up_long(health), F.lit(0)))
    label = F.when(F.col("health_score") >= 85, "healthy").when(F.col("health_score") >= 60, "degraded").otherwise("critical")
    return scored.withColumn("health_label", label).withColumn("average", F.round("average", 6)).drop("pass_rate", "gap_free", "done")


def status_class(status: Column) -> Column:
    """E38."""
    return F.when(status.isin("timeout", "error"), "bad").when(status.isin("dry-run", "cancelled"), "warn").otherwise("good")


def session_overview(runs: DataFrame, last: int = 20) -> DataFrame:
    """Per session its runs, successes, mean score, and its last run ids, newest first."""
    totals = runs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(F.when(F.col("status") == "success", 1)).alias("successes"),
        F.round(F.avg("verification_score"), 6).alias("avg_score"),
    )
    tail = newest(runs, last, "session_id").groupBy("session_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_key", "run_id")), asc=False), lambda x: x["run_id"]), ",").alias("last_runs")
    )
    return totals.join(tail, "session_id")


def sparkline(runs: DataFrame, width: int = 520, height: int = 120) -> DataFrame:
    """Points of the duration trend of each session with two runs or more."""
    whole = Window.partitionBy("session_id")
    place = F.row_number().over(whole.orderBy("run_key")) - 1
    n, low, high = F.count(F.lit(1)).over(whole), F.min("duration_ms").over(whole), F.max("duration_ms").over(whole)
    points = runs.withColumns({"i": place, "n": n, "low": low, "high": high}).where("n >= 2")
    span = F.greatest(F.lit(1), F.col("high") - F.col("low"))
    y = F.lit(float(height)) - (F.col("duration_ms") - F.col("low")) / span * (height - 18) - 9
    return points.select(
        "session_id", "i", F.round(F.col("i") / F.greatest(F.lit(1), F.col("n") - 1) * width, 1).alias("x"), F.round(y, 1).alias("y")
    )


def budget_guard(calls: DataFrame, max_calls: int, max_latency: int, max_input: int, max_output: int, *, by: str = "provider") -> DataFrame:
    """Running use of each budget in call order, and the first call that would exceed one."""
    run = Window.partitionBy(by).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    used = calls.select(
        by,
        "event_id",
        F.count(F.lit(1)).over(run).alias("calls"),
        F.sum("latency_ms").over(run).alias("latency"),
        F.sum(prompt_tokens(F.col("input_tokens"), F.col("cache_hit_tokens"), F.col("cache_write_tokens"))).over(run).alias("input"),
        F.sum("output_tokens").over(run).alias("output"),
    )
    reason = (
        F.when(F.col("calls") > max_calls, "calls")
        .when(F.col("latency") > max_latency, "latency")
        .when(F.col("input") > max_input, "input")
        .when(F.col("output") > max_output, "output")
    )
    over = used.withColumn("exceeded", reason).where("exceeded IS NOT NULL")
    first = F.row_number().over(Window.partitionBy(by).orderBy("event_id"))
    return over.withColumn("__first__", first).where("__first__ = 1").drop("__first__")


def calibration(calls: DataFrame, *, by: tuple[str, ...] = ("provider", "model")) -> DataFrame:
    """The token factor of each key after smoothing over its calls in order.

    ``estimated`` includes the factor so far, so a call's target is factor * actual / estimated,
    within 0.3 and 3. The fold is over one key's calls, in order, as the smoothing demands.
    """
    usable = calls.where("actual > 0 AND estimated > 0")
    ordered = F.array_sort(F.collect_list(F.struct("event_id", (F.col("actual") / F.col("estimated")).alias("ratio"))))
    fold = F.aggregate(ordered, F.lit(1.0), lambda f, x: f * 0.7 + F.least(F.lit(3.0), F.greatest(F.lit(0.3), f * x["ratio"])) * 0.3)
    return usable.groupBy(*by).agg(F.round(fold, 6).alias("factor"), F.count(F.lit(1)).alias("samples"))


# Fixed value: how a provider says that it knows no tools.
NO_TOOLS = (
    r"(?i)(?:(?:tools?|function(?:[ -]calling)?).{0,60}(?:unsupported|not supported|unknown|unavailable|invalid)|"
    r"(?:unsupported|does not support|doesn't support).{0,60}(?:tools?|function))"
)


def rejects_tools(status: Column, message: Column) -> Column:
    """whether an error says outright that tools are not supported."""
    return F.coalesce(status.isin(400, 404, 422) & message.rlike(NO_TOOLS), F.lit(False))


def session_identity(session_id: Column) -> Column:
    """The host's id, or one that cannot be taken for another."""
    return F.coalesce(F.nullif(session_id, F.lit("")), F.concat(F.lit("unresolved:"), F.uuid()))


def unresolved(session_id: Column) -> Column:
    """F28."""
    return session_id.startswith("unresolved:")


def clamped_tokens(requested: Column, model_most: Column) -> Column:
    """Requested tokens within the model's bound, at least one."""
    bound = F.when((model_most > 0) & ~F.isnan(model_most.cast("double")), model_most).otherwise(requested)
    return F.greatest(F.lit(1), F.least(requested, bound))
