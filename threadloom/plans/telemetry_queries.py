"""Telemetry queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import telemetry as T
from threadloom.plans.registry import query

_STAGE = "CASE WHEN phase = 'patch' THEN 'verify' WHEN phase = 'probe' OR phase LIKE 'explore%' THEN 'explore' ELSE 'synthesize' END"
_SCENARIO = (
    "concat(CASE WHEN coalesce(context_percent, 0) >= 90 THEN 'critical' WHEN coalesce(context_percent, 0) >= 70 THEN 'pressure' ELSE 'compact' END, '/', "
    "CASE WHEN coalesce(tool_percent, 0) >= 70 THEN 'tool-heavy' WHEN coalesce(tool_percent, 0) >= 30 THEN 'mixed' ELSE 'conversational' END)"
)


@query(
    "provider_route_rollup",
    "llm_calls",
    sql=f"""
    SELECT {_STAGE} AS stage, provider, model, count(*) AS calls, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successes,
        CAST(floor(sum(greatest(latency_ms, 0)) / count(*) + 0.5) AS BIGINT) AS avg_latency_ms,
        CAST(sum(input_tokens + cache_hit_tokens + cache_write_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(output_tokens) AS BIGINT) AS output_tokens
    FROM {{llm_calls}} GROUP BY 1, 2, 3""",
)
def provider_route_rollup(calls: DataFrame) -> DataFrame:
    return T.route_rollup(calls)


@query(
    "call_metrics_summary",
    "llm_calls",
    sql="""
    SELECT *, round(least(1.0, total_cache_hit / (total_input + total_cache_hit + total_cache_write)), 6) AS cache_hit_rate FROM (
        SELECT count(*) AS total_calls, CAST(sum(input_tokens) AS BIGINT) AS total_input, CAST(sum(output_tokens) AS BIGINT) AS total_output,
            CAST(sum(cache_hit_tokens) AS BIGINT) AS total_cache_hit, CAST(sum(cache_write_tokens) AS BIGINT) AS total_cache_write,
            CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency FROM {llm_calls})""",
)
def call_metrics_summary(calls: DataFrame) -> DataFrame:
    return T.call_summary(calls)


# A run's stored routes: derived from the run, valid ones and broken ones.
_ROUTES = f"""
    SELECT run_id, metrics_schema_version, {_SCENARIO} AS scenario,
        CASE run_key % 4 WHEN 0 THEN 'explore' WHEN 1 THEN 'verify' WHEN 2 THEN 'synthesize' ELSE 'other' END AS stage,
        provider, substr(model, 4) AS model, total_calls AS calls, total_calls - run_key % 2 AS successes,
        avg_latency AS avg_latency_ms, total_input AS input_tokens, total_output AS output_tokens,
        CASE WHEN run_key % 8 < 6 THEN verification_score END AS quality_score,
        CASE WHEN run_key % 8 < 6 AND verification_score IS NOT NULL THEN CASE WHEN run_key % 16 = 3 THEN 'guess' ELSE 'pre-repair-verification' END END AS quality_basis
    FROM {{runs}}"""
_VALID = """((quality_score IS NULL AND quality_basis IS NULL) OR (quality_score BETWEEN 0 AND 100 AND quality_basis = 'pre-repair-verification'))
    AND calls > 0 AND stage IN ('explore', 'synthesize', 'verify')"""


def _routes(runs: DataFrame) -> DataFrame:
    key = F.col("run_key")
    scored = key % 8 < 6
    basis = F.when(key % 16 == 3, "guess").otherwise("pre-repair-verification")
    return runs.select(
        "run_id",
        "metrics_schema_version",
        T.scenario(F.col("context_percent"), F.col("tool_percent")).alias("scenario"),
        F.when(key % 4 == 0, "explore").when(key % 4 == 1, "verify").when(key % 4 == 2, "synthesize").otherwise("other").alias("stage"),
        "provider",
        F.expr("substr(model, 4)").alias("model"),
        F.col("total_calls").alias("calls"),
        (F.col("total_calls") - key % 2).alias("successes"),
        F.col("avg_latency").alias("avg_latency_ms"),
        F.col("total_input").alias("input_tokens"),
        F.col("total_output").alias("output_tokens"),
        F.when(scored, F.col("verification_score")).alias("quality_score"),
        F.when(scored & F.col("verification_score").isNotNull(), basis).alias("quality_basis"),
    )


_MATRIX = f"""
    routes AS ({_ROUTES}),
    cells AS (
        SELECT stage, scenario, provider, model, count(*) AS runs, CAST(sum(calls) AS BIGINT) AS calls,
            sum(least(calls, greatest(0, successes))) / sum(calls) AS sr, sum(greatest(0, avg_latency_ms) * calls) / sum(calls) AS lat,
            sum(input_tokens + output_tokens) / sum(calls) AS tok,
            sum(quality_score) FILTER (WHERE metrics_schema_version = 2) / nullif(count(quality_score) FILTER (WHERE metrics_schema_version = 2), 0) AS q,
            count(quality_score) FILTER (WHERE metrics_schema_version = 2) / count(*) AS cov
        FROM routes WHERE {_VALID} GROUP BY 1, 2, 3, 4),
    scored AS (
        SELECT *, coalesce(q / 100, 0.5) AS qq, 1 / (1 + lat / 30000) AS speed, 1 / (1 + tok / 100000) AS thrift,
            least(1.0, runs / 5) * (0.5 + cov * 0.5) AS conf FROM cells),
    matrix AS (
        SELECT stage, scenario, provider, model, runs, calls, floor(sr * 1000 + 0.5) / 1000 AS success_rate,
            CAST(floor(lat + 0.5) AS BIGINT) AS avg_latency_ms, CAST(floor(tok + 0.5) AS BIGINT) AS avg_tokens_per_call,
            floor(q * 10 + 0.5) / 10 AS avg_quality, floor(cov * 1000 + 0.5) / 1000 AS quality_coverage,
            floor((0.5 + (CASE WHEN stage = 'explore' THEN sr * 0.4 + speed * 0.3 + thrift * 0.15 + qq * 0.15
                ELSE qq * 0.4 + sr * 0.3 + speed * 0.2 + thrift * 0.1 END - 0.5) * conf) * 1000 + 0.5) / 1000 AS score,
            floor(conf * 1000 + 0.5) / 1000 AS confidence,
            coalesce(runs >= 5 AND sr >= 0.8 AND cov >= 0.5 AND q >= 85, false) AS eligible FROM scored)"""


@query("provider_matrix", "runs", sql=f"WITH {_MATRIX} SELECT * FROM matrix")
def provider_matrix(runs: DataFrame) -> DataFrame:
    return T.provider_matrix(_routes(runs))


@query(
    "provider_recommendations",
    "runs",
    sql=f"""WITH {_MATRIX}
    SELECT stage, scenario, CASE WHEN eligible THEN concat(provider, '/', model) END AS model,
        CASE WHEN eligible THEN score ELSE 0.0 END AS score, CASE WHEN eligible THEN confidence ELSE 0.0 END AS confidence
    FROM matrix QUALIFY row_number() OVER (PARTITION BY stage, scenario ORDER BY eligible DESC, score DESC, confidence DESC, provider, model) = 1""",
)
def provider_recommendations(runs: DataFrame) -> DataFrame:
    return T.provider_recommendations(T.provider_matrix(_routes(runs)))


@query(
    "legacy_route_matrix",
    "runs",
    sql=f"""
    SELECT {_SCENARIO} AS scenario, provider, substr(model, 4) AS model, count(*) AS runs, CAST(sum(total_calls) AS BIGINT) AS calls,
        CAST(sum(CASE WHEN status IN ('success', 'dry-run') THEN total_calls ELSE 0 END) AS BIGINT) AS successes
    FROM {{runs}} GROUP BY 1, 2, 3""",
)
def legacy_route_matrix(runs: DataFrame) -> DataFrame:
    routes = T.legacy_route(runs)
    return routes.groupBy("scenario", "provider", "model").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("calls").alias("calls"), F.sum("successes").alias("successes")
    )


@query(
    "provider_insight",
    "runs",
    sql=f"""
    WITH routes AS ({_ROUTES})
    SELECT stage, provider, model, count(*) AS runs, CAST(sum(calls) AS BIGINT) AS calls,
        round(sum(successes) / sum(calls), 6) AS reliability,
        round(avg(quality_score) FILTER (WHERE metrics_schema_version = 2 AND quality_basis = 'pre-repair-verification'), 6) AS avg_quality,
        round(count(quality_score) FILTER (WHERE metrics_schema_version = 2 AND quality_basis = 'pre-repair-verification') / count(*), 6) AS quality_coverage,
        CAST(floor(sum(avg_latency_ms * calls) / sum(calls) + 0.5) AS BIGINT) AS avg_latency_ms,
        CAST(floor(sum(input_tokens + output_tokens) / sum(calls) + 0.5) AS BIGINT) AS avg_tokens_per_call
    FROM routes WHERE calls > 0 AND stage <> 'other' GROUP BY 1, 2, 3""",
)
def provider_insight(runs: DataFrame) -> DataFrame:
    return T.provider_insight(_routes(runs).where("stage <> 'other'"))


def _stats_sql(source: str, keys: str = "") -> str:
    """Window statistics of the rows of ``source``, which has its damage joined."""
    return f"""
        SELECT {keys}{', ' if keys else ''}count(*) AS runs, count(*) FILTER (WHERE status <> 'dry-run') AS applied_runs,
            coalesce(count(*) FILTER (WHERE status = 'success') / nullif(count(*) FILTER (WHERE status <> 'dry-run'), 0), 1.0) AS success_rate,
            avg(verification_score) FILTER (WHERE status = 'success') AS avg_quality,
            coalesce(count(verification_score) FILTER (WHERE status = 'success') / nullif(count(*) FILTER (WHERE status <> 'dry-run'), 0), 0.0) AS quality_coverage,
            CAST(coalesce(quantile_disc(coalesce(duration_ms, avg_latency), 0.95) FILTER (WHERE status <> 'dry-run'), 0) AS DOUBLE) AS p95_latency_ms,
            coalesce(avg(total_input + cache_hit + cache_write + total_output) FILTER (WHERE status <> 'dry-run'), 0.0) AS avg_tokens,
            coalesce(avg(CASE WHEN method = 'heuristic' THEN 1.0 ELSE 0.0 END) FILTER (WHERE status <> 'dry-run'), 0.0) AS fallback_rate,
            coalesce(count(DISTINCT run_id) FILTER (WHERE status = 'success' AND damage > 0)
                / nullif(count(DISTINCT run_id) FILTER (WHERE status = 'success' AND damage IS NOT NULL), 0), 0.0) AS damage_rate,
            coalesce(count(DISTINCT run_id) FILTER (WHERE status = 'success' AND damage IS NOT NULL)
                / nullif(count(*) FILTER (WHERE status = 'success'), 0), 0.0) AS damage_coverage
        FROM {source}{' GROUP BY ' + keys if keys else ''}"""


_SEEN = "seen AS (SELECT run_id, max(least(100.0, greatest(0.0, damage_score))) AS damage FROM {damage} GROUP BY run_id)"


@query(
    "run_window_stats",
    "runs",
    "damage",
    sql=f"""WITH {_SEEN}, joined AS (SELECT r.*, s.damage FROM {{runs}} r LEFT JOIN seen s ON r.run_id = s.run_id),
    stats AS ({_stats_sql('joined', 'release_channel, provider')})
    SELECT * REPLACE (floor(success_rate * 1000 + 0.5) / 1000 AS success_rate, floor(quality_coverage * 1000 + 0.5) / 1000 AS quality_coverage,
        floor(fallback_rate * 1000 + 0.5) / 1000 AS fallback_rate, floor(damage_rate * 1000 + 0.5) / 1000 AS damage_rate,
        floor(damage_coverage * 1000 + 0.5) / 1000 AS damage_coverage, floor(avg_quality * 10 + 0.5) / 10 AS avg_quality,
        CAST(floor(p95_latency_ms + 0.5) AS BIGINT) AS p95_latency_ms, CAST(floor(avg_tokens + 0.5) AS BIGINT) AS avg_tokens) FROM stats""",
)
def run_window_stats(runs: DataFrame, damage: DataFrame) -> DataFrame:
    return T.rounded_stats(T.window_stats(runs, damage, "release_channel", "provider"))


@query(
    "canary_assessment",
    "runs",
    "damage",
    sql=f"""WITH {_SEEN}, joined AS (SELECT r.*, s.damage FROM {{runs}} r LEFT JOIN seen s ON r.run_id = s.run_id),
    canary AS (SELECT * FROM joined WHERE metrics_schema_version = 2 AND version = '9.4.0' AND release_channel = 'canary' ORDER BY run_key DESC LIMIT 100),
    stable AS (SELECT * FROM joined WHERE metrics_schema_version = 2 AND coalesce(release_channel, 'stable') = 'stable' ORDER BY run_key DESC LIMIT 50),
    c AS ({_stats_sql('canary')}), b AS ({_stats_sql('stable')}),
    tests AS (
        SELECT c.*, b.runs AS b_runs, b.success_rate AS b_success, b.applied_runs AS b_applied, b.damage_coverage AS b_damage_coverage,
            list_filter([
                CASE WHEN c.applied_runs >= 3 AND (1 - c.success_rate > 0.050001 OR (1 - c.success_rate) - (1 - b.success_rate) >= 0.050001)
                    THEN 'failure-rate crossed ' || CASE WHEN 1 - c.success_rate > 0.050001 THEN '>5% absolute' ELSE '+5pp regression' END END,
                CASE WHEN c.avg_quality < 85 OR b.avg_quality - c.avg_quality >= 5
                    THEN 'quality crossed ' || CASE WHEN c.avg_quality < 85 THEN '<85 absolute' ELSE '-5 points' END END,
                CASE WHEN b.p95_latency_ms >= 1000 AND c.p95_latency_ms >= b.p95_latency_ms * 1.5 THEN 'latency crossed +50% p95' END,
                CASE WHEN b.avg_tokens >= 1000 AND c.avg_tokens >= b.avg_tokens * 1.5 THEN 'tokens crossed +50%' END,
                CASE WHEN c.fallback_rate - b.fallback_rate >= 0.1 THEN 'fallback crossed +10pp' END,
                CASE WHEN c.damage_rate - b.damage_rate >= 0.1 THEN 'damage crossed +10pp' END], lambda t: t IS NOT NULL) AS crossed,
            CASE WHEN c.applied_runs < 20 THEN 'need more canary runs with applied outcomes'
                WHEN b.applied_runs < 20 THEN 'stable baseline is too small' WHEN c.quality_coverage < 0.7 THEN 'quality coverage is below 70%'
                WHEN c.damage_coverage < 0.7 THEN 'canary damage coverage is below 70%' WHEN b.damage_coverage < 0.7 THEN 'stable damage coverage is below 70%'
                WHEN coalesce(c.avg_quality, 0) < 85 THEN 'quality is below 85' WHEN c.success_rate < 0.949999 THEN 'success rate is below 95%' END AS held,
            least(1.0, c.applied_runs / 20) AS cf, least(1.0, b.applied_runs / 20) AS bf
        FROM c, b)
    SELECT '9.4.0' AS version, CASE WHEN len(crossed) > 0 AND applied_runs >= 3 THEN 'rollback' WHEN held IS NOT NULL THEN 'hold' ELSE 'promote' END AS decision,
        CAST(floor(100 * (cf * 0.25 + bf * 0.15 + quality_coverage * cf * 0.2 + damage_coverage * cf * 0.2 + b_damage_coverage * bf * 0.2) + 0.5) AS BIGINT) AS data_confidence,
        CASE WHEN len(crossed) > 0 AND applied_runs >= 3 THEN array_to_string(crossed, '; ') WHEN held IS NOT NULL THEN held ELSE 'all gates passed' END AS reason,
        runs AS canary_runs, b_runs AS baseline_runs, floor(success_rate * 1000 + 0.5) / 1000 AS canary_success_rate,
        floor(b_success * 1000 + 0.5) / 1000 AS baseline_success_rate, floor(avg_quality * 10 + 0.5) / 10 AS canary_quality,
        CAST(floor(p95_latency_ms + 0.5) AS BIGINT) AS canary_p95_ms, floor(damage_rate * 1000 + 0.5) / 1000 AS canary_damage_rate FROM tests""",
)
def canary_assessment(runs: DataFrame, damage: DataFrame) -> DataFrame:
    return T.assess_canary(runs, damage, "9.4.0")


@query(
    "privacy_aggregate",
    "runs",
    sql=r"""
    SELECT CASE WHEN regexp_full_match(version, '[A-Za-z0-9_./:@+-]{{1,160}}') THEN version ELSE 'legacy' END AS version,
        CASE WHEN release_channel = 'canary' THEN 'canary' ELSE 'stable' END AS channel, provider, substr(model, 4) AS model, count(*) AS runs,
        count(*) FILTER (WHERE status IN ('success', 'dry-run')) AS successes,
        floor(avg(verification_score) FILTER (WHERE metrics_schema_version = 2) * 10 + 0.5) / 10 AS avg_quality,
        CAST(floor(avg(avg_latency) + 0.5) AS BIGINT) AS avg_latency_ms,
        CAST(sum(total_input + cache_hit + cache_write) AS BIGINT) AS input_tokens, CAST(sum(total_output) AS BIGINT) AS output_tokens
    FROM {runs} GROUP BY 1, 2, 3, 4""",
)
def privacy_aggregate(runs: DataFrame) -> DataFrame:
    return T.privacy_aggregate(runs)


@query(
    "failure_histogram",
    "runs",
    sql="SELECT failure_kind, count(*) AS runs FROM {runs} WHERE failure_kind IN ('rate-limit', 'provider') GROUP BY 1",
)
def failure_histogram(runs: DataFrame) -> DataFrame:
    return T.failure_histogram(runs)


def _dashboard_sql(keys: str) -> str:
    return f"""
    WITH timed AS (SELECT *, row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY duration_ms) - 1 AS i,
            count(*) OVER ({'PARTITION BY ' + keys if keys else ''}) AS n FROM {{runs}} WHERE duration_ms <> 0),
    picked AS (SELECT {keys + ', ' if keys else ''}duration_ms AS p95_duration FROM timed WHERE i = least(n - 1, floor(n * 0.95))),
    totals AS (SELECT {keys + ', ' if keys else ''}count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS success,
        count(*) FILTER (WHERE status = 'timeout') AS timeout, count(*) FILTER (WHERE status = 'error') AS error,
        count(*) FILTER (WHERE status = 'dry-run') AS dry_run,
        CAST(coalesce(floor(avg(duration_ms) FILTER (WHERE duration_ms <> 0) + 0.5), 0) AS BIGINT) AS avg_duration,
        CAST(sum(total_calls) AS BIGINT) AS total_calls, CAST(sum(total_input + cache_hit + cache_write) AS BIGINT) AS total_input,
        CAST(sum(total_output) AS BIGINT) AS total_output, CAST(coalesce(floor(avg(verification_score) + 0.5), 0) AS BIGINT) AS avg_score,
        round(count(*) FILTER (WHERE status IN ('timeout', 'error')) / count(*), 6) AS error_rate FROM {{runs}}{' GROUP BY ' + keys if keys else ''})
    SELECT totals.*, coalesce(p95_duration, 0) AS p95_duration FROM totals {f'LEFT JOIN picked USING ({keys})' if keys else ', picked'}"""


@query("dashboard_summary", "runs", sql=_dashboard_sql(""))
def dashboard_summary(runs: DataFrame) -> DataFrame:
    return T.dashboard(runs)


@query("dashboard_by_profile", "runs", sql=_dashboard_sql("profile"))
def dashboard_by_profile(runs: DataFrame) -> DataFrame:
    return T.dashboard(runs, "profile")


@query("dashboard_by_provider", "runs", sql=_dashboard_sql("provider"))
def dashboard_by_provider(runs: DataFrame) -> DataFrame:
    return T.dashboard(runs, "provider")


@query(
    "data_confidence",
    "runs",
    sql="""
    WITH recent AS (SELECT * FROM {runs} ORDER BY run_key DESC LIMIT 40),
    c AS (SELECT count(*) AS n, count(*) FILTER (WHERE metrics_schema_version = 2) AS v2,
        count(verification_score) FILTER (WHERE metrics_schema_version = 2) AS measured,
        count(*) FILTER (WHERE ts IS NOT NULL AND status <> '' AND duration_ms > 0 AND provider <> '' AND method <> '') AS complete, max(ts) AS latest FROM recent),
    p AS (SELECT power(least(1.0, n / 20), 3) * 25 AS sample, v2 / n * 25 AS schema, measured / n * 20 AS quality, complete / n * 20 AS completeness,
        CASE WHEN date_diff('day', CAST(latest AS DATE), DATE '1998-08-10') <= 7 THEN 10.0
            WHEN date_diff('day', CAST(latest AS DATE), DATE '1998-08-10') <= 30 THEN 5.0 ELSE 0.0 END AS freshness FROM c),
    s AS (SELECT *, CAST(floor(sample + schema + quality + completeness + freshness + 0.5) AS BIGINT) AS score FROM p)
    SELECT score, CASE WHEN score >= 85 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS label,
        CAST(floor(sample + 0.5) AS BIGINT) AS sample_score, CAST(floor(schema + 0.5) AS BIGINT) AS schema_score,
        CAST(floor(quality + 0.5) AS BIGINT) AS quality_score, CAST(floor(completeness + 0.5) AS BIGINT) AS completeness_score,
        CAST(floor(freshness + 0.5) AS BIGINT) AS freshness_score FROM s""",
)
def data_confidence(runs: DataFrame) -> DataFrame:
    return T.data_confidence(runs, F.lit("1998-08-10").cast("date"))


@query(
    "quality_insight",
    "runs",
    sql="""
    WITH v AS (SELECT * FROM {runs} WHERE metrics_schema_version = 2),
    a AS (SELECT count(verification_score) AS measured_runs, count(*) - count(verification_score) AS missing_runs, avg(verification_score) AS average,
        median(verification_score) AS median, min(verification_score) AS minimum, count(*) FILTER (WHERE verification_score >= 90) AS excellent,
        count(*) FILTER (WHERE verification_score >= 75 AND verification_score < 90) AS passing, count(*) FILTER (WHERE verification_score < 75) AS low,
        round(avg(initial_score), 6) AS average_initial, round(avg(verification_score - initial_score), 6) AS average_gain,
        count(*) FILTER (WHERE patches > 0) AS patched_runs, CAST(sum(gaps) AS BIGINT) AS remaining_gaps,
        CAST(floor(avg(verification_score) / 100 * 60 + 20 * count(*) FILTER (WHERE verification_score >= 85) / count(verification_score)
            + 10 * avg(CASE WHEN gaps = 0 THEN 1.0 ELSE 0.0 END) + 10 * avg(CASE WHEN status IN ('success', 'dry-run') THEN 1.0 ELSE 0.0 END) + 0.5) AS BIGINT) AS health_score
        FROM v)
    SELECT * REPLACE (round(average, 6) AS average), CASE WHEN health_score >= 85 THEN 'healthy' WHEN health_score >= 60 THEN 'degraded' ELSE 'critical' END AS health_label FROM a""",
)
def quality_insight(runs: DataFrame) -> DataFrame:
    return T.quality_insight(runs)


@query(
    "session_overview",
    "runs",
    sql="""
    WITH tail AS (SELECT session_id, string_agg(run_id, ',' ORDER BY run_key DESC) AS last_runs FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY run_key DESC) AS back FROM {runs}) WHERE back <= 20 GROUP BY session_id)
    SELECT r.session_id, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS successes, round(avg(verification_score), 6) AS avg_score,
        any_value(last_runs) AS last_runs FROM {runs} r JOIN tail t ON r.session_id = t.session_id GROUP BY r.session_id""",
)
def session_overview(runs: DataFrame) -> DataFrame:
    return T.session_overview(runs)


@query(
    "duration_sparkline",
    "runs",
    sql="""
    WITH p AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY run_key) - 1 AS i, count(*) OVER w AS n,
        min(duration_ms) OVER w AS low, max(duration_ms) OVER w AS high, duration_ms FROM {runs} WINDOW w AS (PARTITION BY session_id))
    SELECT session_id, CAST(i AS INT) AS i, round(i / greatest(1, n - 1) * 520, 1) AS x,
        round(120.0 - (duration_ms - low) / greatest(1, high - low) * 102 - 9, 1) AS y FROM p WHERE n >= 2""",
)
def duration_sparkline(runs: DataFrame) -> DataFrame:
    return T.sparkline(runs)


@query(
    "budget_guard",
    "llm_calls",
    sql="""
    WITH u AS (SELECT provider, event_id, count(*) OVER w AS calls, CAST(sum(latency_ms) OVER w AS BIGINT) AS latency,
        CAST(sum(input_tokens + cache_hit_tokens + cache_write_tokens) OVER w AS BIGINT) AS input, CAST(sum(output_tokens) OVER w AS BIGINT) AS output
        FROM {llm_calls} WINDOW w AS (PARTITION BY provider ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT *, CASE WHEN calls > 400 THEN 'calls' WHEN latency > 1500000 THEN 'latency' WHEN input > 800000 THEN 'input' WHEN output > 150000 THEN 'output' END AS exceeded FROM u)
    SELECT * FROM o WHERE exceeded IS NOT NULL QUALIFY row_number() OVER (PARTITION BY provider ORDER BY event_id) = 1""",
)
def budget_guard(calls: DataFrame) -> DataFrame:
    return T.budget_guard(calls, 400, 1_500_000, 800_000, 150_000)


@query(
    "token_calibration",
    "llm_calls",
    sql="""
    WITH RECURSIVE o AS (SELECT provider, model, input_tokens / (1.0 + latency_ms) AS ratio,
        row_number() OVER (PARTITION BY provider, model ORDER BY event_id) AS i, count(*) OVER (PARTITION BY provider, model) AS n
        FROM {llm_calls} WHERE input_tokens > 0),
    f AS (SELECT provider, model, CAST(0 AS BIGINT) AS i, CAST(1.0 AS DOUBLE) AS factor, max(n) AS n FROM o GROUP BY 1, 2
        UNION ALL SELECT f.provider, f.model, o.i, f.factor * 0.7 + least(3.0, greatest(0.3, f.factor * o.ratio)) * 0.3, f.n
        FROM f JOIN o ON o.provider = f.provider AND o.model = f.model AND o.i = f.i + 1)
    SELECT provider, model, round(factor, 6) AS factor, n AS samples FROM f WHERE i = n""",
)
def token_calibration(calls: DataFrame) -> DataFrame:
    return T.calibration(calls.withColumns({"actual": F.col("input_tokens").cast("double"), "estimated": F.col("latency_ms") + 1.0}))


_ERRORS = """SELECT event_id, CASE k % 6 WHEN 0 THEN 'VerificationGateError' WHEN 1 THEN 'YieldGateError' ELSE 'Error' END AS name,
    CASE k % 7 WHEN 0 THEN 'ECONN' ELSE '' END AS code,
    CASE k % 11 WHEN 0 THEN 'request timed out' WHEN 1 THEN 'token budget used up' WHEN 2 THEN 'Too Many Requests' WHEN 3 THEN 'bad API key'
        WHEN 4 THEN 'output limit reached' WHEN 5 THEN 'aborted by user' WHEN 6 THEN 'sqlite is locked' WHEN 7 THEN 'malformed plan'
        WHEN 8 THEN 'fetch failed' ELSE 'odd' END AS message,
    CASE k % 5 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE CAST(NULL AS INT) END AS status, event_id % 97 = 0 AS timed_out FROM {steps}"""


@query(
    "failure_taxonomy",
    "steps",
    sql=f"""
    WITH e AS (SELECT *, lower(concat(name, ' ', code, ' ', message)) AS t FROM ({_ERRORS}))
    SELECT event_id, CASE WHEN timed_out OR regexp_matches(t, 'timeout|timed out|watchdog|deadline') THEN 'timeout'
        WHEN name = 'VerificationGateError' THEN 'verification' WHEN name = 'YieldGateError' THEN 'yield'
        WHEN contains(t, 'token budget') THEN 'budget' WHEN status = 429 OR contains(t, 'too many requests') THEN 'rate-limit'
        WHEN status IN (401, 403) OR regexp_matches(t, 'api.?key') THEN 'authentication' WHEN contains(t, 'output limit') THEN 'output-limit'
        WHEN contains(t, 'abort') THEN 'cancelled' WHEN contains(t, 'sqlite') THEN 'persistence' WHEN contains(t, 'malformed') THEN 'validation'
        WHEN status >= 500 OR contains(t, 'fetch failed') THEN 'provider' ELSE 'internal' END AS kind FROM e""",
)
def failure_taxonomy(steps: DataFrame) -> DataFrame:
    errors = steps.sparkSession.sql(_ERRORS, steps=steps)
    kind = T.classify_failure(*(F.col(c) for c in ("name", "code", "message", "status", "timed_out")))
    return errors.select("event_id", kind.alias("kind"))


@query(
    "status_classes",
    "runs",
    sql="""SELECT CASE WHEN status IN ('timeout', 'error') THEN 'bad' WHEN status IN ('dry-run', 'cancelled') THEN 'warn' ELSE 'good' END AS class,
    count(*) AS runs FROM {runs} GROUP BY 1""",
)
def status_classes(runs: DataFrame) -> DataFrame:
    return runs.groupBy(T.status_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("runs"))
