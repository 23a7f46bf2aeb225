"""Records that runs leave and take: details, evidence, context texts, budgets and settings.

Everything is a projection, a window or one aggregation by session or run; JSON of unknown
shape is read as a variant, whose type decides what a field is worth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import tools as K
from threadloom.functions.text import fact_key, project_hash, provider_name, token_estimate
from threadloom.operators.facts import DIAGNOSTIC

# Known names, bounds and caps.
METHODS = ("eesv", "single-pass", "heuristic")
PROFILES = ("light", "balanced", "aggressive")
DETAIL_MODES = ("balanced", "aggressive", "fast", "thorough")
COUNTS = (
    "chunkCount", "totalMessages", "totalTokensSummarized", "llmCalls", "tokensSaved", "explorationRounds", "explorationBoundaries",
    "tokensBefore", "plannedAfterTokens", "plannedSavedTokens", "estimatedAfterTokens", "estimatedSavedTokens", "retainedTailTokens",
    "summaryTokens", "summaryBudgetTokens", "targetAfterTokens",
)
YIELDS = ("plannedYield", "estimatedYield")
SOFT_BOUNDARIES = ("recent-user-turn", "anchor", "topical")
ROUTE_STAGES = ("explore", "synthesize", "verify")
INTERNAL_PHASES = ("explore-retry", "explore-direct", "single-pass", "batch", "assemble", "patch")
UNCACHED_PROVIDERS = ("deepseek", "crofai")  # and those that are not known
#: Settings and their bounds: (whole numbers only, least, most, nought is allowed below the least).
SETTINGS = {
    "autoTriggerTimeoutMs": (False, 1000, 300_000, False), "maxLlmCalls": (True, 0, 100, False), "maxLlmInputTokens": (True, 0, 1_000_000, False),
    "codexMaxCallMs": (True, 5000, 300_000, True), "maxLatencyMs": (False, 5000, 600_000, True), "minContextPercent": (False, 0, 100, False),
}
#: Budgets a user may ask for: (whole numbers only, least, most).
BUDGETS = {"maxCalls": (True, 1, 100), "maxInputTokens": (True, 10_000, 1_000_000), "maxLatencyMs": (False, 5000, 600_000)}
RING, RING_KEPT = 200, 100
CONFIDENT, LAST_RESOLVED = 0.8, 5
CONTINUITY_BYTES = 256 * 1024
NEAR, SNIPPET = 5, 120

# ---------------------------------------------------------------- noise and grounding


def legacy_search_output(text: Column) -> Column:
    """a first line that begins like a search hit, ``path:line:``."""
    first = F.regexp_extract(F.trim(text), r"\A([^\r\n]*)", 1)
    return first.rlike(r"\A[^\s:][^:]*:\d+(?::\d+)?:")


def sanitised_state(items: DataFrame) -> DataFrame:
    """state items (kind, text) without diagnostics taken for constraints and search noise
    taken for errors, loops or context."""
    bare = F.regexp_replace("text", r"(?i)\AUnresolved error:\s*", "")
    noise = legacy_search_output(F.col("text")) | K.transient(bare)
    evidence = F.col("kind").isin("unresolved", "resolved", "loop", "context")
    gone = F.when(F.col("kind") == "constraint", F.col("text").rlike(DIAGNOSTIC)).when(evidence, noise).otherwise(F.lit(False))
    return items.where(~F.coalesce(gone, F.lit(False)))


def any_truncated(messages: DataFrame) -> DataFrame:
    """sessions and whether any of their messages is truncated."""
    return messages.groupBy("session_id").agg(F.bool_or(K.truncated(F.col("text"))).alias("truncated"))


def grounded(refs: DataFrame, messages: DataFrame) -> DataFrame:
    """file references (session_id, ref) and whether any message of the session holds them.

    A reference counts where neither a word character, a dot nor a hyphen is next to it. So it
    is a row of whole segments of a path in the text: all such rows of segments are spelled
    out, and references meet them by equality.
    """
    text = F.lower(F.translate("text", "\\", "/"))
    runs = messages.select("session_id", F.explode(F.regexp_extract_all(text, F.lit(r"[a-z0-9_./-]+"), F.lit(0))).alias("run")).distinct()
    parts = F.split("run", "/")
    n = F.size(parts)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "/"))))
    said = runs.select("session_id", F.explode(F.array_distinct(spans)).alias("low")).distinct().withColumn("grounded", F.lit(True))
    low = F.lower(F.regexp_replace(F.translate("ref", "\\", "/"), r"\A\./", ""))
    met = refs.withColumn("low", low).join(said, ["session_id", "low"], "left")
    return met.select("session_id", "ref", (F.coalesce("grounded", F.lit(False)) & (F.col("low") != "")).alias("grounded"))


def first_needle_file(errors: DataFrame, needles: DataFrame) -> DataFrame:
    """Of the files (ord, path, needle) whose needle an error's message holds, the first in order."""
    met = errors.join(needles, "session_id").where(F.contains(F.lower("message"), F.col("needle")))
    return met.groupBy("session_id", "idx").agg(F.min_by("path", F.struct("ord", "path")).alias("path"))


def without_restated(loops: DataFrame) -> DataFrame:
    """Loops (session_id, idx, type, text), follow-ups before blocked items, without those
    that restate one already kept less than five messages away.

    A fold over the loops of one session, of which there are few.
    """
    key = fact_key(F.col("text"))
    place = F.when(F.col("type") == "follow-up", 0).otherwise(1)
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("place"), "idx", "type", "text", key.alias("key"))))

    def keep(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda k: (F.abs(k["idx"] - x["idx"]) < NEAR) & (F.contains(k["key"], x["key"]) | F.contains(x["key"], k["key"])))
        return F.when(near, kept).otherwise(F.array_append(kept, x))

    held = loops.groupBy("session_id").agg(ordered.alias("l")).withColumn("k", F.aggregate("l", F.slice("l", 1, 0), keep))
    return held.select("session_id", F.inline("k")).select("session_id", "idx", "type", "text")


# ---------------------------------------------------------------- details and evidence


def _kind(document: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(document, path, "variant")), F.lit("MISSING"))


def _number(document: Column, name: str) -> Column:
    numeric = _kind(document, f"$.{name}").rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(document, f"$.{name}", "double"))


def _strings(document: Column, name: str) -> Column:
    return F.when(_kind(document, f"$.{name}").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(document, f"$.{name}", "array<string>"))


def _text(document: Column, name: str) -> Column:
    return F.when(_kind(document, f"$.{name}") == "STRING", F.try_variant_get(document, f"$.{name}", "string"))


def details(text: Column) -> Column:
    """what a run's details (JSON) say, put right where they can be, else null.

    ``valid`` says that nothing had to be put right. Without lists of files and topics there
    is nothing to repair.
    """
    d = F.try_parse_json(text)
    gone = lambda name: _kind(d, f"$.{name}") == "MISSING"
    count = lambda name: F.when(_number(d, name) >= 0, _number(d, name))
    lists = _strings(d, "modifiedFiles").isNotNull() & _strings(d, "readFiles").isNotNull() & _strings(d, "topics").isNotNull()
    fields = [
        _text(d, "method").isin(*METHODS), _text(d, "profile").isin(*PROFILES), _number(d, "qualityScore").isNotNull(), count("totalMessages").isNotNull(),
        gone("gaps") | _strings(d, "gaps").isNotNull(), gone("verified") | (_kind(d, "$.verified") == "BOOLEAN"),
        _kind(d, "$.backupPath").isin("MISSING", "VOID", "STRING"), gone("mode") | _text(d, "mode").isin(*DETAIL_MODES),
        gone("runId") | F.length(_text(d, "runId")).between(8, 100), gone("version") | _text(d, "version").isNotNull(),
        gone("releaseChannel") | _text(d, "releaseChannel").isin("stable", "canary"),
        *[gone(k) | count(k).isNotNull() for k in COUNTS], *[gone(k) | _number(d, k).between(0, 1) for k in YIELDS],
        gone("hardBoundaryAdjusted") | (_kind(d, "$.hardBoundaryAdjusted") == "BOOLEAN"),
        gone("relaxedSoftBoundaries") | F.forall(_strings(d, "relaxedSoftBoundaries"), lambda x: x.isin(*SOFT_BOUNDARIES)),
        gone("providerRoutes") | F.array_contains(F.array(*[_kind(d, f"$.providerRoutes.{s}") == "STRING" for s in ROUTE_STAGES]), False).__invert__(),
    ]
    valid = lists
    for field in fields:
        valid = valid & F.coalesce(field, F.lit(False))
    known = lambda name, values, other: F.when(_text(d, name).isin(*values), _text(d, name)).otherwise(other)
    return F.when(
        lists,
        F.struct(
            valid.alias("valid"), known("method", METHODS, "heuristic").alias("method"), known("profile", PROFILES, "balanced").alias("profile"),
            _strings(d, "modifiedFiles").alias("modified"), _strings(d, "readFiles").alias("read"), _strings(d, "topics").alias("topics"),
            F.coalesce(count("totalMessages"), F.lit(0.0)).alias("messages"), F.coalesce(_number(d, "qualityScore"), F.lit(0.0)).alias("score"),
            F.coalesce(_text(d, "model"), F.lit("unknown")).alias("model"), F.coalesce(_strings(d, "gaps"), F.array().cast("array<string>")).alias("gaps"),
        ),
    )


def string_list(text: Column, most: int = 20) -> Column:
    """The strings of a JSON array, the first ``most``; none of anything else."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    strings = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.slice(F.transform(strings, lambda x: F.try_variant_get(x, "$", "string")), 1, most), F.array().cast("array<string>"))


def as_strings(items: Column) -> Column:
    """E27."""
    return F.coalesce(items.cast("array<string>"), F.array().cast("array<string>"))


def decoded_path(display: Column) -> Column:
    """The string that a JSON string stands for; anything else as it is."""
    return F.coalesce(_text(F.try_parse_json(F.concat(F.lit('{"v":'), display, F.lit("}"))), "v"), display)


def required_evidence(facts: DataFrame, steering: DataFrame | None = None) -> DataFrame:
    """What a summary must bear out: facts (doc_id, side, kind, ord, text, confidence, explicit)
    of the session, then of its previous state, each text once.

    Constraints count from a confidence of 0.8 on and not if they are diagnostics, decisions if
    they are explicit, and of the resolved errors the last five. ``steering`` (doc_id, focus,
    note) adds constraints after these.
    """
    sure = (F.col("kind") != "constraint") | (F.col("confidence") >= CONFIDENT)
    told = facts.where(sure & ((F.col("kind") != "decision") | F.col("explicit"))).select("doc_id", "side", "kind", "ord", "text")
    if steering is not None:
        focus = steering.where("trim(focus) <> ''").select("doc_id", F.lit(2).alias("side"), F.lit("constraint").alias("kind"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("Preserve detail about: "), "focus").alias("text"))
        note = steering.where("trim(note) <> ''").select("doc_id", F.lit(3).alias("side"), F.lit("constraint").alias("kind"), F.lit(0).cast("long").alias("ord"), F.col("note").alias("text"))
        told = told.unionByName(focus).unionByName(note)
    once = Window.partitionBy("doc_id", "kind", fact_key(F.col("text"))).orderBy("side", "ord")
    first = told.where(fact_key(F.col("text")) != "").withColumn("n", F.row_number().over(once)).where("n = 1")
    kept = first.where((F.col("kind") != "constraint") | ~F.col("text").rlike(DIAGNOSTIC))
    last = Window.partitionBy("doc_id", "kind").orderBy(F.desc("side"), F.desc("ord"))
    recent = kept.withColumn("back", F.row_number().over(last)).where((F.col("kind") != "resolved") | (F.col("back") <= LAST_RESOLVED))
    return recent.select("doc_id", "kind", "text")


def capped(facts: DataFrame, caps: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """The newest facts (session_id, kind, ord) of each kind within its cap, and how
    many each session lost."""
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("kind"))
    back = Window.partitionBy("session_id", "kind").orderBy(F.desc("ord"))
    numbered = facts.withColumn("n", F.row_number().over(back)).withColumn("cap", cap)
    over = numbered.groupBy("session_id", "kind").agg((F.max("n") - F.max("cap")).cast("long").alias("omitted")).where("omitted > 0")
    return numbered.where(F.col("cap").isNull() | (F.col("n") <= F.col("cap"))).drop("n", "cap"), over


def numbered_facts(facts: DataFrame) -> DataFrame:
    """Ids of a state's facts (session_id, kind, ord): decision-n, constraint-n and error-n,
    the errors counted on from the unresolved to the resolved."""
    prefix = F.when(F.col("kind").isin("unresolved", "resolved"), "error-").otherwise(F.concat("kind", F.lit("-")))
    order = Window.partitionBy("session_id", prefix).orderBy(F.desc("kind"), "ord")
    return facts.withColumn("id", F.concat(prefix, F.row_number().over(order).cast("string")))


def extraction_context(facts: DataFrame, omitted: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Facts (session_id, kind, idx, label, text) as the text a model is shown.

    Equal lines of a kind are told once with their number. A range keeps what lies in it, and
    leaves the files read and deleted out.
    """
    if first is not None:
        facts = facts.where(F.col("idx").between(first, last) & ~F.col("kind").isin("read", "deleted"))
    names = {"modified": "Files modified", "read": "Files read", "deleted": "Files deleted", "error": "Errors", "decision": "Decisions", "constraint": "Constraints"}
    line = F.when(F.col("kind").isin("modified", "read", "deleted"), F.col("text")).when(
        F.col("kind") == "decision", F.concat("label", F.lit(": "), F.substring("text", 1, SNIPPET))
    ).otherwise(F.concat(F.lit("["), "label", F.lit("] "), F.substring("text", 1, SNIPPET)))
    said = facts.groupBy("session_id", "kind", line.alias("line")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"))
    told = F.concat("line", F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise(""))
    lists = said.groupBy("session_id", "kind").agg(F.array_sort(F.collect_list(F.struct("idx", told.alias("line")))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), ", ")
    kinds = lists.groupBy("session_id").pivot("kind", list(names)).agg(F.first(joined))
    over = omitted.groupBy("session_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit(": +"), F.col("omitted").cast("string")))), ", ").alias("over")
    )
    met = kinds.join(over, "session_id", "left")
    rows = [F.concat(F.lit(f"{name}: "), F.coalesce(k, F.lit("none"))) for k, name in names.items()]
    text = F.concat_ws("\n", F.lit("## Deterministic Extraction (verified facts)"), *rows, F.concat(F.lit("Evidence omitted by safety bounds: "), F.coalesce("over", F.lit("none"))))
    return met.select("session_id", text.alias("text"))


def exploration_context(reports: DataFrame) -> DataFrame:
    """A report (doc_id, goal, type, references, constraints, done, in_progress, context) as
    text; empty where it has neither goal nor references nor constraints."""
    def line(label: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{label}: "), F.array_join(column, "; ")))

    empty = (F.coalesce("goal", F.lit("")) == "") & (F.size("references") == 0) & (F.size("constraints") == 0)
    text = F.concat_ws(
        "\n", F.lit("## Exploration Report"), F.concat(F.lit("Main goal: "), F.coalesce("goal", F.lit(""))), F.concat(F.lit("Session type: "), "type"),
        line("Cross-references", "references"), line("Enriched constraints", "constraints"), line("Assessed done", "done"),
        line("Assessed in-progress", "in_progress"), line("Critical context", "context"),
    )
    return reports.select("doc_id", F.when(empty, "").otherwise(text).alias("text"))


def fallback_report(goals: DataFrame) -> DataFrame:
    """The report of a session that was not explored: its goal and nothing else."""
    none = F.array().cast("array<string>")
    return goals.select(
        F.col("session_id").alias("doc_id"), F.coalesce("goal", F.lit("")).alias("goal"), F.lit("implementation").alias("type"),
        *[none.alias(c) for c in ("references", "constraints", "done", "in_progress", "context")],
    )


# ---------------------------------------------------------------- budgets, settings, caches, streams


def budget_errors(asked: DataFrame) -> DataFrame:
    """Asked budgets (name, value) and whether they may stand; null and blank stand for none."""
    value = F.expr("try_cast(value AS double)")
    ok = F.lit(False)
    for name, (whole, least, most) in BUDGETS.items():
        fits = value.between(least, most) & (F.lit(not whole) | (value == F.floor(value)))
        ok = F.when(F.col("name") == name, F.coalesce(fits, F.lit(False))).otherwise(ok)
    return asked.withColumn("ok", F.when(F.coalesce(F.trim("value"), F.lit("")) == "", F.lit(True)).otherwise(ok))


def valid_settings(settings: DataFrame) -> DataFrame:
    """Settings (name, value as JSON) that have a rule and keep it."""
    held = F.try_parse_json("value")
    value = F.when(F.schema_of_variant(held).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(held, "$", "double"))
    ok = F.lit(None).cast("boolean")
    for name, (whole, least, most, nought) in SETTINGS.items():
        fits = (value.between(least, most) | (F.lit(nought) & (value == 0))) & (F.lit(not whole) | (value == F.floor(value)))
        ok = F.when(F.col("name") == name, F.coalesce(fits, F.lit(False))).otherwise(ok)
    return settings.withColumn("ok", ok)


def ordered_bounds(profiles: DataFrame) -> DataFrame:
    """Profiles whose chunk bounds are positive and in order: least, most, batch."""
    good = (F.col("min_chunk") > 0) & (F.col("min_chunk") <= F.col("max_chunk")) & (F.col("max_chunk") <= F.col("batch"))
    return profiles.withColumn("ok", F.coalesce(good, F.lit(False)))


def cache_retention(phase: Column, provider: Column) -> Column:
    """How long a provider may keep a prompt."""
    name = provider_name(provider)
    none = F.coalesce(phase.isin(*INTERNAL_PHASES), F.lit(False)) | name.isNull() | name.isin(*UNCACHED_PROVIDERS)
    return F.when(none, "none").otherwise("short")


def cache_counters(lookups: DataFrame, *keys: str) -> DataFrame:
    """Hits, misses and their rate."""
    hits, all_ = F.count(F.when(F.col("hit"), 1)), F.count(F.lit(1))
    return lookups.groupBy(*keys).agg(hits.alias("hits"), (all_ - hits).alias("misses"), (hits / all_).alias("hit_rate"))


def ring(metrics: DataFrame, *keys: str, order: str) -> DataFrame:
    """What a buffer holds that, beyond 200 records, drops all but the newest 100.

    After n records it holds 100 and those since the last cut, and cuts are 101 records apart.
    """
    back, whole = Window.partitionBy(*keys).orderBy(F.desc(order)), Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(whole)
    held = F.when(n <= RING, n).otherwise(RING_KEPT + (n - RING - 1) % (RING - RING_KEPT + 1))
    return metrics.withColumns({"held": held, "back": F.row_number().over(back)}).where("back <= held").drop("held", "back")


def stream_stops(deltas: DataFrame, factor: int = 3) -> DataFrame:
    """Where a watchdog ends a stream (call_id, ord, type, chars, at_ms, max_tokens,
    deadline_ms): its visible characters exceed three per token, or its time is up."""
    visible = F.when(F.col("type").isin("text_delta", "thinking_delta", "toolcall_delta"), F.col("chars")).otherwise(0)
    upto = Window.partitionBy("call_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    seen = deltas.withColumn("visible", F.sum(visible).over(upto))
    reason = F.when(F.col("at_ms") > F.col("deadline_ms"), "time").when(F.col("visible") > F.col("max_tokens") * factor, "visible-output")
    stopped = seen.withColumn("reason", reason).where("reason IS NOT NULL")
    return stopped.groupBy("call_id").agg(F.min_by(F.struct("ord", "reason", "visible"), "ord").alias("s")).select("call_id", "s.*")


def stale_files(files: DataFrame, prefix: str, now: Column, most_ms: int) -> DataFrame:
    """Cache files (name, mtime_ms) of the prefix that are too old."""
    return files.where(F.col("name").startswith(prefix) & F.col("name").endswith(".json") & (now - F.col("mtime_ms") > most_ms))


def legacy_prefix(legacy: Column, current: Column) -> Column:
    """Whether a cached list of ids, not empty, begins the current one."""
    return F.coalesce((F.size(legacy) > 0) & (F.size(legacy) <= F.size(current)) & (F.slice(current, 1, F.greatest(F.size(legacy), F.lit(0))) == legacy), F.lit(False))


def bounded_bytes(text: Column, most: int = CONTINUITY_BYTES) -> Column:
    """A text within so many bytes of UTF-8, cut between characters, with a mark that says so."""
    octets = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    mark = F.concat(F.lit("\n… [continuity truncated from "), size.cast("string"), F.lit(" bytes]\n"))
    end = F.greatest(F.lit(0), F.lit(most) - F.octet_length(mark))

    def inside(back: int) -> Column:
        """Whether the byte ``back`` before the cut goes on with a character."""
        return F.hex(F.substring(octets, end + F.lit(1 - back), F.lit(1))).between("80", "BF")

    shift = F.when(inside(0), F.when(inside(1), F.when(inside(2), 3).otherwise(2)).otherwise(1)).otherwise(0)
    cut = F.decode(F.substring(octets, F.lit(1), end - shift), "UTF-8")
    return F.when(size <= most, text).otherwise(F.concat(cut, mark))


def message_tokens(role: Column, text: Column, call_id: Column, tool: Column, failed: Column) -> Column:
    """M3: tokens of a message as it is sent, as JSON; absent fields are left out."""
    sent = F.struct(
        role.alias("role"), text.alias("content"), F.nullif(call_id, F.lit("")).alias("toolCallId"), F.nullif(tool, F.lit("")).alias("toolName"),
        F.when(failed, F.lit(True)).alias("isError"),
    )
    return token_estimate(F.to_json(sent))


def duration(told: Column, timings: Column) -> Column:
    """A run's duration as told, else the sum of its phases."""
    return F.coalesce(told, F.aggregate(timings, F.lit(0).cast("long"), lambda a, x: a + x))


def run_type(skipped: Column, triggered: Column) -> Column:
    """E4."""
    return F.when(skipped, "tool").when(triggered, "auto").otherwise("manual")


def number_text(value: Column) -> Column:
    """A number with separators, or a dash."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "—").otherwise(F.format_number(value, 0))


def compact_number(value: Column) -> Column:
    """From ten thousand on in thousands, millions or billions, with one place at most."""
    size = F.abs(value)

    def short(unit: float, name: str) -> Column:
        return F.concat(F.regexp_replace(F.format_string("%.1f", F.round(value / unit, 1)), r"\.0\z", ""), F.lit(name))

    return F.when(size >= 999_950_000, short(1e9, "B")).when(size >= 999_950, short(1e6, "M")).when(size >= 10_000, short(1e3, "K")).otherwise(F.format_number(value, 0))


def run_line(score: Column, saved: Column, status: Column, mode: Column, provider: Column) -> Column:
    """One run as one line."""
    told = F.when(score.isNull(), "—").otherwise(F.concat(score.cast("long").cast("string"), F.lit("/100")))
    some = lambda c: F.coalesce(c, F.lit("?"))
    return F.concat(F.lit("score "), told, F.lit(" • saved "), number_text(saved), F.lit("t • "), some(status), F.lit(" • "), some(mode), F.lit(" / "), some(provider))


def restore_text(content: Column, source: Column) -> Column:
    """A backup's body as the message that brings it back."""
    return F.concat(F.lit("# Restored context of a backup\nSource: "), source, F.lit("\n\n"), content)


def project_of_folder(folder: Column, git_root: Column, home: str) -> Column:
    """A project's id from its git root or else its folder; none for the root and home."""
    at = F.regexp_replace(F.trim(folder), r"(?<=.)/+\z", "")
    return F.when((at == "") | at.isin("/", home), F.lit(None)).otherwise(project_hash(F.coalesce(git_root, at)))


def without_postings(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """The posting list without the nodes (node_id) that were removed."""
    return postings.join(gone.select("node_id").distinct(), "node_id", "left_anti")


def kept_for_damage(turns: DataFrame, compactions: DataFrame, most: int = 15, least: int = 3) -> DataFrame:
    """The first turns that a session kept, to be held against its latest compaction.

    ``compactions`` (session_id, ord, keep_from, details); sessions that kept fewer than
    ``least`` turns, or whose latest compaction has no details, give none.
    """
    latest = compactions.groupBy("session_id").agg(F.max_by(F.struct("keep_from", "details"), "ord").alias("c"))
    kept = turns.join(latest.where("c.details IS NOT NULL"), "session_id").where(F.col("idx") >= F.col("c.keep_from"))
    ahead, whole = Window.partitionBy("session_id").orderBy("idx"), Window.partitionBy("session_id")
    numbered = kept.withColumns({"n": F.row_number().over(ahead), "kept": F.count(F.lit(1)).over(whole)})
    return numbered.where((F.col("kept") >= least) & (F.col("n") <= most)).drop("n", "kept", "c")
