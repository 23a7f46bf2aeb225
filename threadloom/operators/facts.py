"""Facts of many sessions at once: files, errors and retries, decisions, constraints, goals, loops.

``calls`` (session_id, idx, call_id, name, args), ``results`` (session_id, idx, call_id,
is_error, text) and ``messages`` (session_id, idx, role, text) share the positions ``idx``
of a session. Joins and windows are by session and key, never over all sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import tools as K
from threadloom.functions.shell import file_operations
from threadloom.functions.text import begins_with, evidence_line, fact_key, path_needles

# Cue patterns in the order in which they are tried, and windows and caps.
CHOICE = r"(?i)use\s+\S+\s+(?:instead|not|rather)|don't\s+use|avoid\s+|switch\s+to\s+|go\s+with\s+|prefer\s+"
SHIFT = (
    "(?iu)şimdi|simdi|peki|bi de|bide|geçelim|gecelim|bakalım|bakalim|yapalım|yapalim|başka|baska|sonra|tamam şimdi|tamam simdi|"
    "now let|also|next|let's|moving on|switch to"
)
_EDGE, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
CONSTRAINTS = (
    ("requirement", 0.85, rf"(?i){_EDGE}(?:must|need|require|has to|important){_END}.*{_EDGE}(?:be|use|have|include|support){_END}"),
    ("prohibition", 0.8, rf"(?i){_EDGE}(?:don't|never|avoid|shouldn't|must not|do not|no\s+(?:need|want)){_END}"),
    ("preference", 0.6, rf"(?i){_EDGE}(?:prefer|like|want|would rather|should){_END}.*{_EDGE}(?:use|be|have|with){_END}"),
    ("prohibition", 0.8, rf"(?iu){_EDGE}(?:yapma|kullanma|sakın|sakınha|asla(?:\s+(?:kullanma|yapma|getirme))?|bunu yapma){_END}"),
    ("requirement", 0.8, rf"(?iu){_EDGE}(?:kritik|kritikal|önemli|onemli|şart|sart|zorunlu|şart koşul|önemli şart|kesinlikle|"
     rf"kesinlikle şart|böyle olsun|böyle yapın|şöyle olsun|şöyle yapın){_END}"),
    ("preference", 0.6, rf"(?iu){_EDGE}(?:tercih|isterim|olsun|kullanalım|yapalım|istiyorum){_END}"),
)
DIAGNOSTIC = r"(?i)\A(?:\[[^\]]+\]\s*)?(?:npm\s+(?:error|warn|notice|audit|verbose|info)\b|(?:rg|grep):|command exited\b)"
FOLLOW_UP = (
    r"(?iu)(?:next\s+(?:step|thing)|todo|action item|follow\s*up|still (?:need|have) to|gotta|yapalim|yapalım|yapmamiz|yapmamız|gerekiyor|"
    "eklenecek|düzeltilecek|duzeltilecek|bitmedi|kaldi|kaldı)"
)
BLOCKED = rf"(?i){_EDGE}blocked{_END}|waiting for|{_EDGE}depends?\s+on{_END}|ba[ğg]l[iı]|bekliyor|engell"
ACKNOWLEDGED = (
    r"(?iu)\A(?:(?:ok(?:ay)?|tamam|evet|yes|thanks?|teşekkürler|continue|devam(?:\s+et)?|go\s+ahead|proceed)[\s.!]*){1,3}\z"
)
HISTORY = (
    r"(?is)\A(?:The conversation history before this point was compacted|The following is a summary of a branch that this conversation "
    r"came back from).*<summary>"
)
COMPLETED = (
    rf"(?iu){_EDGE}(?:done|completed?|finished|implemented|fixed|resolved|updated|added|removed|shipped|tamamland[ıi]|tamamlad[ıi]m|"
    rf"bitti|[çc][öo]z[üu]ld[üu]){_END}"
)
NOT_COMPLETED = (
    rf"(?iu){_EDGE}(?:not|isn['’]?t|wasn['’]?t|hen[üu]z|de[ğg]il){_END}.{{0,20}}{_EDGE}(?:done|complete|finished|fixed|resolved|bitti){_END}"
)
LOOP_STOP_WORDS = (
    "next", "step", "thing", "todo", "action", "item", "follow", "still", "need", "have", "gotta", "eklenecek", "duzeltilecek",
    "düzeltilecek", "gerekiyor", "yapalim", "yapalım", "kaldi", "kaldı",
)
RETRY_REACH, RESOLVE_REACH, LOOP_REACH = 6, 10, 50
ERROR_CHARS, MESSAGE_CHARS, SUMMARY_CHARS, TIMELINE_CHARS, TIMELINE_ERROR_CHARS = 500, 300, 200, 150, 100
LOOP_CHARS = 120


def tool_steps(calls: DataFrame, results: DataFrame) -> DataFrame:
    """J1's relation: each result with its call (if known), its operation, path and signature."""
    read = calls.withColumn("a", K.parsed(F.col("args")))
    known = read.withColumn("operation", K.operation(F.col("a"), F.col("name"))).select(
        "session_id",
        "call_id",
        F.col("idx").alias("call_idx"),
        "name",
        "a",
        "operation",
        K.tool_path(F.col("a")).alias("path"),
        K.signature(F.col("a"), F.col("args"), F.col("name"), F.col("operation")).alias("signature"),
    )
    return results.join(known, ["session_id", "call_id"], "left")


def shell_operations(steps: DataFrame) -> DataFrame:
    """J1's shell part: files that successful commands write or remove, as (session_id, idx, path, op)."""
    command = K.first_text(F.col("a"), K.COMMAND_KEYS)
    ran = steps.where((F.col("operation") == "execute") & ~F.col("is_error") & ~K.command_failed(F.col("text")))
    return ran.select("session_id", "idx", F.explode(file_operations(command)).alias("f")).select("session_id", "idx", "f.path", "f.op")


def file_states(steps: DataFrame) -> DataFrame:
    """Per session and path the latest state that its successful operations leave.

    ``modified_count`` counts the mutations after the last deletion; a path is ``deleted``
    when nothing touched it after its deletion, ``read`` when an access followed that.
    """
    does = F.col("operation")
    usable = steps.where(~F.col("is_error") & F.col("path").isNotNull() & (does != "execute"))
    op = (
        F.when((does == "mutate") & ~K.no_op(F.col("text")), "mutate")
        .when(does == "delete", "delete")
        .when(does.isin(*K.ACCESSES), "access")
    )
    acts = usable.select("session_id", "idx", "path", op.alias("op")).where("op IS NOT NULL").unionByName(shell_operations(steps))
    whole = Window.partitionBy("session_id", "path")
    gone = F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("idx"))).over(whole), F.lit(-1))
    live = acts.withColumn("gone", gone)
    after = F.col("idx") > F.col("gone")
    mutated, accessed = after & (F.col("op") == "mutate"), after & (F.col("op") == "access")
    return live.groupBy("session_id", "path").agg(
        F.count(F.when(mutated, 1)).alias("modified_count"),
        F.max(F.when(mutated, F.col("idx"))).alias("last_modified"),
        F.max(F.when(accessed, F.col("idx"))).alias("last_read"),
        F.when(F.max("gone") == F.max("idx"), F.max("gone")).alias("deleted_at"),
    )


def error_catalog(steps: DataFrame) -> DataFrame:
    """Failed results; explicit errors, else commands whose output shows a failure."""
    text = F.col("text")
    calm = (F.col("a").isNotNull() & K.benign_search(F.col("a"), text)) | K.transient(text)
    failed = (F.col("operation") == "execute") & K.command_failed(text)
    found = steps.where(~F.coalesce(calm, F.lit(False)) & (F.col("is_error") | F.coalesce(failed, F.lit(False))))
    message = F.when(F.col("is_error"), F.substring(text, 1, ERROR_CHARS)).otherwise(K.failure_evidence(text, MESSAGE_CHARS))
    return found.select("session_id", "idx", "call_id", F.coalesce("name", F.lit("unknown")).alias("tool"), message.alias("message"), "signature")


def retried_errors(errors: DataFrame, steps: DataFrame) -> DataFrame:
    """Each error with whether its operation was tried again soon, and then went well.

    Both joins are by session and key with a bound on the distance; the first retry counts.
    """
    again = steps.where("signature IS NOT NULL").select(
        F.col("session_id").alias("s"), F.col("signature").alias("g"), F.col("call_idx").alias("j"), F.col("idx").alias("k"),
        F.col("is_error").alias("again_failed"),
    )
    near = (F.col("j") > F.col("idx")) & (F.col("j") < F.col("idx") + RETRY_REACH)
    met = errors.join(again, (F.col("session_id") == F.col("s")) & (F.col("signature") == F.col("g")) & near, "left")
    first = F.min(F.struct("j", "k", "again_failed"))
    tried = met.groupBy("session_id", "idx", "tool", "message", "signature").agg(first.alias("r"))
    soon = (F.col("r.k") > F.col("r.j")) & (F.col("r.k") < F.col("r.j") + RESOLVE_REACH)
    return tried.select(
        "session_id",
        "idx",
        "tool",
        "message",
        "signature",
        F.col("r.j").isNotNull().alias("retried"),
        F.coalesce(soon & ~F.col("r.again_failed"), F.lit(False)).alias("resolved"),
    )


def cached_error_reconciliation(errors: DataFrame, steps: DataFrame, base: Column) -> DataFrame:
    """Unresolved errors of a cached prefix against the steps after it (bound inclusive)."""
    later = steps.where(F.col("call_idx") >= base).select(
        F.col("session_id").alias("s"), F.col("signature").alias("g"), F.col("call_idx").alias("j"), F.col("is_error").alias("again_failed")
    )
    near = (F.col("j") > F.col("idx")) & (F.col("j") <= F.col("idx") + RETRY_REACH)
    old = errors.where(F.col("idx") < base)
    met = old.join(later, (F.col("session_id") == F.col("s")) & (F.col("signature") == F.col("g")) & near, "left")
    return met.groupBy("session_id", "idx", "signature").agg(
        F.max(F.col("j").isNotNull()).alias("retried"),
        F.coalesce(F.max(~F.col("again_failed")), F.lit(False)).alias("resolved"),
    )


def decisions(calls: DataFrame, results: DataFrame, messages: DataFrame) -> DataFrame:
    """Questions that the user answered within three positions, and choices in user turns."""
    asked = calls.where("name = 'ask_user'").select(
        "session_id", "call_id", F.col("idx").alias("asked"), F.coalesce(F.get_json_object("args", "$.question"), F.get_json_object("args", "$.prompt")).alias("question")
    )
    answers = asked.where("question <> ''").join(results, ["session_id", "call_id"]).where("idx BETWEEN asked + 1 AND asked + 3")
    explicit = answers.select(
        "session_id",
        F.col("asked").alias("idx"),
        F.lit("explicit").alias("type"),
        F.substring("question", 1, SUMMARY_CHARS).alias("summary"),
        F.substring("text", 1, MESSAGE_CHARS).alias("response"),
    )
    implicit = messages.where((F.col("role") == "user") & F.col("text").rlike(CHOICE)).select(
        "session_id", "idx", F.lit("implicit").alias("type"), F.substring("text", 1, SUMMARY_CHARS).alias("summary"), F.lit(None).cast("string").alias("response")
    )
    return explicit.unionByName(implicit)


def constraints(messages: DataFrame) -> DataFrame:
    """Constraints in lines of user turns, each text once per session (the first)."""
    users = messages.where((F.col("role") == "user") & (F.length("text") >= 10) & ~F.col("text").startswith("/"))
    lines = users.select("session_id", "idx", F.posexplode(F.split("text", "\n+")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", r"\A\s*[-*]\s+", ""))
    kept = lines.withColumn("text", bare).where((F.length("text") >= 10) & ~F.col("text").rlike(DIAGNOSTIC))
    rule = F.coalesce(*[F.when(F.col("text").rlike(p), F.struct(F.lit(c).alias("category"), F.lit(v).alias("confidence"))) for c, v, p in CONSTRAINTS])
    found = kept.withColumn("rule", rule).where("rule IS NOT NULL").withColumn("key", fact_key(F.col("text")))
    once = Window.partitionBy("session_id", "key").orderBy("idx", "line")
    return found.withColumn("n", F.row_number().over(once)).where("n = 1").select(
        "session_id", "idx", F.substring("text", 1, MESSAGE_CHARS).alias("text"), "rule.category", "rule.confidence"
    )


def timeline(messages: DataFrame, errors: DataFrame, full: int = 30, requests: int = 10) -> DataFrame:
    """User requests and errors; a long timeline keeps the last requests and all errors."""
    asked = messages.where((F.col("role") == "user") & ~F.col("text").startswith("/")).select(
        "session_id", "idx", F.lit("user_request").alias("event"), F.substring("text", 1, TIMELINE_CHARS).alias("summary")
    )
    failed = errors.select("session_id", "idx", F.lit("error").alias("event"), F.substring("message", 1, TIMELINE_ERROR_CHARS).alias("summary"))
    both = asked.unionByName(failed)
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    back = F.row_number().over(Window.partitionBy("session_id", "event").orderBy(F.desc("idx")))
    kept = (F.col("n") <= full) | (F.col("event") == "error") | (F.col("back") <= requests)
    return both.withColumns({"n": n, "back": back}).where(kept).drop("n", "back")


def main_goal(messages: DataFrame, status_labels: Sequence[str] = ()) -> DataFrame:
    """The latest substantive user request of each session.

    A turn that carries a compacted history is a barrier: only its Goal section counts, and
    not if it begins with one of the host's ``status_labels`` (in any case).
    """
    text = F.trim("text")
    barrier = text.rlike(HISTORY)
    users = messages.where((F.col("role") == "user") & (text != "")).where(barrier | ~(text.startswith("/") | text.rlike(ACKNOWLEDGED)))
    last = users.groupBy("session_id").agg(F.max_by(F.struct(text.alias("text"), barrier.alias("barrier")), "idx").alias("m"))
    section = F.regexp_extract("m.text", r"(?is)(?:\A|\n)#{1,3}\s+(?:goals?|objectives?)[:\s]*\n(.*?)(?=\n#{1,3}\s|\z)", 1)
    carried = evidence_line(section, MESSAGE_CHARS)
    status = begins_with(F.lower(F.regexp_replace(carried, "\\A[\"'`]+", "")), [x.lower() for x in status_labels])
    goal = F.when(F.col("m.barrier"), F.when(~status, carried)).otherwise(evidence_line(F.col("m.text"), MESSAGE_CHARS))
    return last.select("session_id", F.nullif(goal, F.lit("")).alias("goal"))


def needle_files(errors: DataFrame, states: DataFrame) -> DataFrame:
    """The modified files whose needles an unresolved error's message holds, all of them."""
    needles = states.where("modified_count > 0").select(
        F.col("session_id").alias("s"), "path", F.explode(path_needles(F.col("path"))).alias("needle")
    )
    open_ = errors.where("NOT resolved")
    met = open_.join(needles, (F.col("session_id") == F.col("s")) & F.contains(F.lower("message"), F.col("needle")))
    return met.groupBy("session_id", "idx").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("files"))


def cue_loops(messages: DataFrame) -> DataFrame:
    """N17's follow-ups and blocked items, with N15: a follow-up is resolved when a later answer
    in the same turn says that something is done and shares a telling word with it."""
    users = messages.where((F.col("role") == "user") & (F.length("text") >= 10) & ~F.col("text").startswith("/"))
    kind = F.when(F.col("text").rlike(FOLLOW_UP), "follow-up").when(F.col("text").rlike(BLOCKED), "blocked")
    loops = users.withColumn("type", kind).where("type IS NOT NULL").withColumn("summary", F.substring("text", 1, LOOP_CHARS))
    words = F.regexp_extract_all(F.lower("summary"), F.lit(r"[\p{L}\p{N}_-]{4,}"), F.lit(0))
    loops = loops.withColumn("words", F.filter(words, lambda w: ~w.isin(*LOOP_STOP_WORDS)))
    substantive = (F.col("role") == "user") & (F.length("text") >= 10) & ~F.col("text").rlike(ACKNOWLEDGED)
    ends = messages.where(substantive).select(F.col("session_id").alias("s"), F.col("idx").alias("end"))
    nxt = loops.join(ends, (F.col("session_id") == F.col("s")) & (F.col("end") > F.col("idx")), "left")
    bounded = nxt.groupBy("session_id", "idx", "type", "summary", "words").agg(F.min("end").alias("end"))
    done = messages.where(
        (F.col("role") == "assistant") & F.col("text").rlike(COMPLETED) & ~F.col("text").rlike(NOT_COMPLETED)
    ).select(F.col("session_id").alias("s"), F.col("idx").alias("at"), F.lower("text").alias("said"))
    within = (F.col("at") > F.col("idx")) & (F.col("at") < F.col("idx") + LOOP_REACH) & (F.col("end").isNull() | (F.col("at") < F.col("end")))
    shares = F.exists("words", lambda w: F.contains(F.col("said"), w))
    met = bounded.join(done, (F.col("session_id") == F.col("s")) & (F.col("type") == "follow-up") & within & shares, "left")
    return met.groupBy("session_id", "idx", "type", "summary").agg(
        F.when(F.max("at").isNotNull(), "resolved").otherwise("open").alias("status")
    ).withColumn("priority", F.when(F.col("type") == "blocked", "high").otherwise("normal"))


def error_loops(errors: DataFrame, states: DataFrame) -> DataFrame:
    """N17's bug-fix loops: unresolved errors with the files they mention."""
    files = needle_files(errors, states)
    return errors.where("NOT resolved").join(files, ["session_id", "idx"], "left").select(
        "session_id", "idx", F.lit("bugfix").alias("type"), F.substring("message", 1, LOOP_CHARS).alias("summary"),
        F.lit("open").alias("status"), F.when(F.col("retried"), "high").otherwise("normal").alias("priority"),
        F.coalesce("files", F.lit("")).alias("files"),
    )


def tool_share(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Tool output in percent of all characters of a session."""
    sizes = messages.select("session_id", F.length("text").alias("n"), F.lit(0).alias("tool")).unionByName(
        results.select("session_id", F.length("text").alias("n"), F.lit(1).alias("tool"))
    )
    # Multiplied before it is divided: a percentage of exactly x.5 is then exact, and rounds up.
    share = F.sum(F.col("n") * F.col("tool")) * F.lit(100.0) / F.nullif(F.sum("n"), F.lit(0))
    return sizes.groupBy("session_id").agg(F.coalesce(F.floor(share + F.lit(0.5)), F.lit(0)).cast("long").alias("tool_percent"))
