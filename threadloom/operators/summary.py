"""Summaries: assembly from facts, sections, verification rules, deterministic repair.

A summary is Markdown text per document; its sections are rows (doc_id, ord, kind, heading,
body). Verification rules are anti-joins and predicates that give rows (doc_id, kind,
detail, penalty). Only the state of code fences is followed line by line in Python, in
Arrow batches; the rest is joins, windows and aggregates.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.semantics import judged
from threadloom.functions.text import canonical_heading, evidence_line, file_refs, heading_kind, normal_path

# Fixed values.
REQUIRED = (("goal", 5), ("progress", 5), ("critical-context", 3))
PENALTY = {
    "missing-file": 5, "missing-read-file": 5, "missing-deleted-file": 5, "missing-error": 5, "missing-resolved-error": 2,
    "missing-open-loops": 5, "fabricated-file": 4, "unsupported-claim": 20, "blocked-none": 12,
}
VERIFIED_SCORE, SNIPPET, CLAIMS = 85, 30, 12
PATH_SECTIONS = {"files-modified": "missing-file", "files-read": "missing-read-file", "files-deleted": "missing-deleted-file"}
SECTION_ORDER = (
    "goal", "constraints", "progress", "decisions", "files-modified", "files-deleted", "files-read", "next-steps", "critical-context",
    "topics", "open-loops",
)
OUTCOME = (
    r"(?iu)(?:\ball\s+tests?\s+(?:pass|passed|passing)\b|\btests?\s+(?:pass|passed|passing)\b|\b(?:build|deployment|migration)\s+"
    r"(?:completed|succeeded|passed|successful)\b|\b(?:deployed|published|released)\b|\b(?:bug|issue|error)\s+(?:fixed|resolved)\b|"
    r"\bno\s+(?:errors?|failures?)\b|\bcompleted successfully\b|\btestler?\s+(?:geçti|başarılı)\b|"
    r"\bbaşarıyla\s+(?:tamamlandı|dağıtıldı|yayınlandı)\b|\b(?:deploy edildi|yayınlandı|hata yok)\b)"
)
NEGATED_OUTCOME = r"(?iu)\b(?:not|never|pending|failed|failing|unresolved|henüz|değil|başarısız)\b"
CLAIM_KINDS = (
    ("test", r"\btests?\b|\btestler?\b"), ("build", r"\bbuild\b|\bcompil(?:e|ed|ation)\b|\btypecheck\b"),
    ("release", r"\bdeploy(?:ed|ment)?\b|\bpublish(?:ed)?\b|\breleas(?:e|ed)\b"),
    ("error", r"\bbug\b|\bissue\b|\berror\b|\bfail(?:ed|ure)?\b|\bhata\b"), ("file", r"\bfile\b|\bdosya\b"),
)
CLAIM_TOOLS = {
    "test": r"(?i)\b(?:test|tests|pytest|jest|vitest|mocha|rspec)\b", "build": r"(?i)\b(?:build|compile|typecheck|tsc|check)\b",
    "release": r"(?i)\b(?:deploy|publish|release)\b",
}
NONE_LINE = r"(?i)\A(?:[-*+]|\d+[.)])\s+(?:none|no blockers?|yok)\s*(?:recorded|known)?[.!]?\z"
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})(.*)$")


def _fenced(text: str | None) -> list[bool]:
    out, mark, length = [], "", 0
    for line in (text or "").split("\n"):
        found = _FENCE.match(line)
        out.append(bool(found) or bool(mark))
        if found and not mark:
            mark, length = found[1][0], len(found[1])
        elif found and found[1][0] == mark and len(found[1]) >= length and not found[2].strip():
            mark = ""
    return out


def _fenced_of(texts: pd.Series) -> pd.Series:
    return texts.map(_fenced)


def fenced_lines(text: Column) -> Column:
    """Whether each line of a text belongs to a code fence, its marks included."""
    return F.pandas_udf(_fenced_of, "array<boolean>")(text)


#: Fixed value: stop reasons of an answer that was cut off.
CUT_OFF = r"(?i)length|truncat|max(?:imum)?[_ -]?(?:output[_ -]?)?tokens?|token[_ -]?limit"


def unclosed_fence(text: Column) -> Column:
    """whether a text ends inside a code fence."""
    marks = fenced_lines(F.concat(text, F.lit("\n")))
    return F.element_at(marks, -1)


def truncated_patch(text: Column, stop_reason: Column) -> Column:
    """whether an answer was cut off: by its stop reason, a truncation mark or an open fence."""
    return F.coalesce(stop_reason.rlike(CUT_OFF), F.lit(False)) | text.rlike(r"…✂\d+\s*\z") | unclosed_fence(text)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def sections(summaries: DataFrame, doc: str = "doc_id", text: str = "summary") -> DataFrame:
    """Sections in order; of one kind there is one, with each line of its bodies once.

    First and second level headings start a section, third level ones if their kind is known.
    """
    lines = summaries.select(
        F.col(doc).alias("doc_id"), F.posexplode(F.arrays_zip(F.split(text, "\n", -1).alias("line"), fenced_lines(F.col(text)).alias("fenced"))).alias("pos", "l")
    ).select("doc_id", "pos", "l.line", "l.fenced")
    level = F.length(F.regexp_extract("line", r"\A(#{1,3})\s+\S", 1))
    title = F.regexp_extract("line", r"\A#{1,3}\s+(.+?)\s*\z", 1)
    kinds = lines.withColumns({"title": title, "kind": heading_kind(title)})
    starts = ~F.col("fenced") & (F.col("title") != "") & ((level <= 2) | (F.col("kind") != "unknown"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    numbered = kinds.withColumn("starts", starts).withColumn("sec", F.sum(F.col("starts").cast("int")).over(order)).where("sec > 0")
    section = Window.partitionBy("doc_id", "sec")
    head = numbered.withColumns(
        {
            "kind": F.first(F.when(F.col("starts"), F.col("kind")), ignorenulls=True).over(section),
            "heading": F.first(F.when(F.col("starts"), F.concat(F.lit("## "), F.col("title"))), ignorenulls=True).over(section),
        }
    )
    # Sections of an unknown kind stand alone; the others are one by kind.
    own = F.when(F.col("kind") == "unknown", F.col("sec")).otherwise(F.lit(0))
    merged = head.withColumn("own", own)
    several = F.count(F.when(F.col("starts"), 1)).over(Window.partitionBy("doc_id", "kind", "own")) > 1
    body = merged.withColumn("several", several)
    ordered = F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("pos", "line"))))
    grouped = body.groupBy("doc_id", "kind", "own").agg(
        F.min("sec").alias("ord"), F.min_by("heading", "pos").alias("heading"), ordered.alias("lines"), F.max("several").alias("several")
    )
    texts = F.transform("lines", lambda x: x["line"])
    joined = F.array_join(F.when(F.col("several"), F.array_distinct(texts)).otherwise(texts), "\n")
    return grouped.select("doc_id", "ord", "kind", "heading", _stripped(joined).alias("body"))


def rendered(parts: DataFrame, canonical: bool = False) -> DataFrame:
    """Sections as Markdown."""
    heading = F.when((F.col("kind") != "unknown") & F.lit(canonical), canonical_heading(F.col("kind"))).otherwise(F.col("heading"))
    one = F.concat(heading, F.lit("\n"), F.col("body"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", one.alias("t"))))
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("t"))
    return whole.select("doc_id", F.concat(_stripped(F.regexp_replace("t", "\n{3,}", "\n\n")), F.lit("\n")).alias("summary"))


def upserted(parts: DataFrame, bodies: DataFrame, append: bool = False) -> DataFrame:
    """Bodies (doc_id, kind, text) put into sections, replacing or after what is there.

    A missing section comes last, in the canonical order of kinds; a body that only says that
    there is none counts as empty.
    """
    old = parts.withColumnRenamed("body", "was")
    put = bodies.select(F.col("doc_id").alias("d"), F.col("kind").alias("k"), "text")
    met = old.join(put, (F.col("doc_id") == F.col("d")) & (F.col("kind") == F.col("k")), "left")
    none = F.col("was").rlike(r"(?i)\A-\s*(?:none|none recorded|no blockers?|yok)[.!]?\z")
    before = F.when(none, "").otherwise(F.col("was"))
    both = _stripped(F.concat_ws("\n", F.nullif(before, F.lit("")), "text")) if append else _stripped(F.col("text"))
    kept = met.select(
        "doc_id", "ord", "kind", F.when(F.col("text").isNull(), F.col("heading")).otherwise(canonical_heading(F.col("kind"))).alias("heading"),
        F.when(F.col("text").isNull(), F.col("was")).otherwise(both).alias("body"),
    )
    place = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("kind")).cast("int")
    new = bodies.join(parts.select("doc_id", "kind"), ["doc_id", "kind"], "left_anti").select(
        "doc_id", (F.lit(1_000_000) + place).alias("ord"), "kind", canonical_heading(F.col("kind")).alias("heading"), _stripped(F.col("text")).alias("body")
    )
    return kept.unionByName(new)


def assembled(facts: DataFrame) -> DataFrame:
    """The deterministic summary of facts (doc_id, kind, ord, text), a bullet each.

    It is the default of the engine; a language model is an option behind the same shape.
    """
    bullet = F.when(F.col("kind") == "goal", F.col("text")).otherwise(F.concat(F.lit("- "), F.col("text")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", bullet.alias("t")))), lambda x: x["t"]), "\n")
    parts = facts.where(F.col("kind").isin(*SECTION_ORDER)).groupBy("doc_id", "kind").agg(lines.alias("body"))
    place = F.array_position(F.array(*map(F.lit, SECTION_ORDER)), F.col("kind")).cast("int")
    return rendered(parts.select("doc_id", place.alias("ord"), "kind", canonical_heading(F.col("kind")).alias("heading"), "body"))


# ---------------------------------------------------------------- verification


def _gap(rows: DataFrame, kind: str | Column, detail: Column, penalty: int | Column) -> DataFrame:
    return rows.select(
        "doc_id",
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        detail.alias("detail"),
        (F.lit(penalty) if isinstance(penalty, int) else penalty).cast("int").alias("penalty"),
    )


def missing_sections(summaries: DataFrame, parts: DataFrame) -> DataFrame:
    """V1."""
    needed = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("penalty")) for k, p in REQUIRED])).alias("r")
    wanted = summaries.select("doc_id", needed).select("doc_id", "r.kind", "r.penalty")
    return _gap(wanted.join(parts, ["doc_id", "kind"], "left_anti"), "missing-section", F.col("kind"), F.col("penalty"))


def listed_paths(parts: DataFrame) -> DataFrame:
    """Paths that the file sections list: bullets stripped, JSON strings decoded."""
    rows = parts.where(F.col("kind").isin(*PATH_SECTIONS)).select("doc_id", "kind", F.explode(F.split("body", "\n")).alias("line"))
    raw = _stripped(F.regexp_replace("line", r"\A\s*(?:[-*+]|\d+[.)])\s+", ""))
    bare = F.regexp_replace(F.regexp_replace(raw, r"\A`(.*)`\z", "$1"), r"(?i)\A\[[ x]\]\s+", "")
    decoded = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
    path = F.when(raw.startswith('"'), F.coalesce(decoded, raw)).otherwise(bare)
    return rows.select("doc_id", "kind", path.alias("path")).where("path <> ''").distinct()


def missing_paths(parts: DataFrame, required: DataFrame) -> DataFrame:
    """Required paths (doc_id, kind, path) that their section does not list.

    A path counts as listed in its normal form too, where no other required path has that.
    """
    listed = listed_paths(parts)
    owners = required.select("doc_id", "path", normal_path(F.col("path")).alias("low")).distinct().groupBy("doc_id", "low").agg(F.count(F.lit(1)).alias("owners"))
    need = required.withColumn("low", normal_path(F.col("path"))).join(owners, ["doc_id", "low"])
    exact = need.join(listed, ["doc_id", "kind", "path"], "left_anti")
    lows = listed.select("doc_id", "kind", normal_path(F.col("path")).alias("l")).distinct()
    same = (exact["doc_id"] == lows["doc_id"]) & (exact["kind"] == lows["kind"]) & (F.col("low") == F.col("l")) & (F.col("owners") == 1)
    left = exact.join(lows, same, "left_anti")
    names = F.create_map(*[F.lit(x) for pair in PATH_SECTIONS.items() for x in pair])
    return _gap(left, F.element_at(names, F.col("kind")), F.col("path"), 5)


def missing_errors(summaries: DataFrame, errors: DataFrame) -> DataFrame:
    """V3: errors (doc_id, message, resolved) whose first words the summary does not hold."""
    words = F.regexp_replace(F.lower(evidence_line(F.col("message"), SNIPPET)), r"\\", "/")
    met = errors.withColumn("words", words).where(F.length("words") > 5).join(summaries, "doc_id")
    gone = met.where(~F.contains(F.regexp_replace(F.lower("summary"), r"\\", "/"), F.col("words")))
    kind = F.when(F.col("resolved"), "missing-resolved-error").otherwise("missing-error")
    return _gap(gone, kind, F.col("message"), F.when(F.col("resolved"), 2).otherwise(5))


def fabricated_files(summaries: DataFrame, known: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """File references that no known path (doc_id, path) ends with or lies under, and
    that the messages do not hold either (``said``: doc_id, low, see ``records.grounded``).

    Known paths are spelled out into their suffixes, so the test is an equi-join.
    """
    refs = summaries.select("doc_id", F.explode(F.array_distinct(file_refs(F.col("summary")))).alias("ref"))
    refs = refs.withColumn("low", F.regexp_replace(normal_path(F.col("ref")), r"\A/+", "")).where("low <> ''")
    parts = F.split(F.regexp_replace(normal_path(F.col("path")), r"\A/+", ""), "/")
    n = F.size(parts)
    spans = F.flatten(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "/")))
    )
    # Whole suffixes name the file; inner spans with a slash name one of its directories.
    owned = known.select("doc_id", F.explode(F.array_distinct(spans)).alias("low"), F.regexp_replace(normal_path(F.col("path")), r"\A/+", "").alias("full"))
    good = owned.where(F.endswith(F.col("full"), F.col("low")) | F.contains(F.col("low"), F.lit("/"))).select("doc_id", "low").distinct()
    unknown = refs.join(good, ["doc_id", "low"], "left_anti")
    if said is not None:
        unknown = unknown.join(said.select("doc_id", "low").distinct(), ["doc_id", "low"], "left_anti")
    return _gap(unknown, "fabricated-file", F.col("ref"), 4)


def blocked_none(parts: DataFrame, unresolved: DataFrame) -> DataFrame:
    """V6: a Blocked part that says none although errors (doc_id) are unresolved."""
    blocked = F.regexp_extract("body", r"(?is)###\s*Blocked[^\n]*\n(.*?)(?=###|\z)", 1)
    lines = F.filter(F.transform(F.split(blocked, "\n"), _stripped), lambda x: x != "")
    single = (F.size(lines) == 1) & F.get(lines, F.lit(0)).rlike(r"(?i)\A(?:none|no blockers?|yok)\s*(?:recorded|known)?[.!]?\z")
    says = F.exists(lines, lambda x: x.rlike(NONE_LINE)) | F.coalesce(single, F.lit(False))
    rows = parts.where("kind = 'progress'").where(says).join(unresolved.select("doc_id").distinct(), "doc_id", "left_semi")
    return _gap(rows, "inconsistency", F.lit("blocked-none"), PENALTY["blocked-none"])


def missing_open_loops(summaries: DataFrame, parts: DataFrame, loops: DataFrame) -> DataFrame:
    """V7: open loops (doc_id) that neither a section nor the word tells of."""
    counted = loops.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    silent = summaries.join(counted, "doc_id").where(~F.contains(F.lower("summary"), F.lit("unresolved")))
    told = parts.where("kind = 'open-loops'")
    return _gap(silent.join(told, "doc_id", "left_anti"), "missing-open-loops", F.col("n").cast("string"), 5)


def outcome_claims(summaries: DataFrame) -> DataFrame:
    """The first dozen distinct lines that claim an outcome, with their category."""
    rows = summaries.select("doc_id", F.posexplode(F.split("summary", r"\r?\n")).alias("pos", "raw"))
    bare = _stripped(F.regexp_replace(F.regexp_replace("raw", r"\A\s*(?:[-*+]|\d+[.)])\s+", ""), r"(?i)\A\[[ x]\]\s+", ""))
    lines = rows.withColumn("claim", bare).where((F.col("claim") != "") & ~F.col("claim").startswith("#") & F.col("claim").rlike(OUTCOME))
    sound = lines.where(F.col("claim").rlike(r"(?i)\bno\s+(?:errors?|failures?)\b") | ~F.col("claim").rlike(NEGATED_OUTCOME))
    first = sound.groupBy("doc_id", "claim").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    category = F.lit("generic")
    for name, pattern in reversed(CLAIM_KINDS):
        category = F.when(F.lower("claim").rlike(pattern), name).otherwise(category)
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= CLAIMS).select("doc_id", "claim", category.alias("category"))


def unsupported_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """V7, R15, R16 by category: claims that no successful tool result (doc_id, tool, operation,
    result) of the right sort bears out. What needs the sense of the words is left out."""
    said = F.lower("result")
    sort = (
        F.when(F.col("category") == "test", F.col("tool").rlike(CLAIM_TOOLS["test"]) & said.rlike(r"\b\d+\s+(?:tests?\s+)?pass(?:ed)?\b")
               & ~said.rlike(r"\b(?:fail(?:ed|ures?)?|errors?)\s*[:=]?\s*[1-9]\d*\b"))
        .when(F.col("category") == "build", F.col("tool").rlike(CLAIM_TOOLS["build"]) & said.rlike(r"\b(?:succeeded|successful|passed|exit(?:ed)?\s+(?:code\s+)?0)\b"))
        .when(F.col("category") == "release", F.col("tool").rlike(CLAIM_TOOLS["release"]) & said.rlike(r"\b(?:succeeded|successful|completed|published|deployed|released)\b"))
        .when(F.col("category") == "file", F.col("operation").isin("mutate", "delete"))
        .otherwise(F.col("operation").isin("execute", "mutate", "delete") & F.contains(said, F.lower("claim")))
    )
    borne = claims.join(evidence, "doc_id").where(sort).select("doc_id", "claim").distinct()
    return _gap(claims.join(borne, ["doc_id", "claim"], "left_anti"), "unsupported-claim", F.col("claim"), PENALTY["unsupported-claim"])


def scores(summaries: DataFrame, gaps: DataFrame) -> DataFrame:
    """100 less the penalties; verified without gaps and at 85 or more."""
    sums = gaps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("gaps"), F.sum("penalty").alias("penalty"))
    score = F.greatest(F.lit(0), 100 - F.coalesce("penalty", F.lit(0)))
    n = F.coalesce("gaps", F.lit(0))
    return summaries.select("doc_id").join(sums, "doc_id", "left").select(
        "doc_id", n.cast("long").alias("gaps"), score.cast("long").alias("score"), ((n == 0) & (score >= VERIFIED_SCORE)).alias("ok")
    )


def gap_text(kind: Column, detail: Column) -> Column:
    """C45."""
    return F.concat_ws(": ", F.regexp_replace(kind, "-", " "), detail)


def failure_message(gaps: DataFrame, most: int = 3) -> DataFrame:
    """The first gaps of each document by penalty, as one line."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("penalty"), "kind", "detail")
    top = gaps.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    lines = F.array_sort(F.collect_list(F.struct("n", gap_text(F.col("kind"), F.col("detail")).alias("t"))))
    return top.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["t"]), "; ").alias("message"))


#: Where a gap is put right, F22.
REPAIRS = {
    "missing-file": "files-modified", "missing-read-file": "files-read", "missing-deleted-file": "files-deleted",
    "missing-error": "critical-context", "missing-resolved-error": "critical-context", "missing-open-loops": "open-loops",
}


def repaired(summaries: DataFrame, parts: DataFrame, gaps: DataFrame) -> DataFrame:
    """Gaps that facts put right become bullets in their sections; missing sections are
    added; lines with unsupported claims go (C47)."""
    sections_of = F.create_map(*[F.lit(x) for pair in REPAIRS.items() for x in pair])
    where = F.when(F.col("kind") == "missing-section", F.col("detail")).otherwise(F.element_at(sections_of, F.col("kind")))
    said = F.when(F.col("kind") == "missing-section", "- None recorded").when(
        F.col("kind") == "missing-open-loops", F.concat(F.lit("- "), F.col("detail"), F.lit(" unresolved items"))
    ).otherwise(F.concat(F.lit("- "), F.regexp_replace("detail", r"\s*\n\s*", " ")))
    lines = gaps.withColumns({"section": where, "line": said}).where("section IS NOT NULL")
    bodies = lines.groupBy("doc_id", F.col("section").alias("kind")).agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("text"))
    claims = gaps.where("kind = 'unsupported-claim'").groupBy("doc_id").agg(F.collect_set("detail").alias("claims"))
    patched = upserted(parts, bodies, append=True).join(claims, "doc_id", "left")
    kept = F.filter(F.split("body", "\n"), lambda x: ~F.exists(F.coalesce("claims", F.array().cast("array<string>")), lambda c: F.endswith(_stripped(x), c)))
    return rendered(patched.withColumn("body", F.array_join(kept, "\n")).drop("claims"))


def patchable(kind: Column, detail: Column) -> Column:
    """whether a gap can be put right from the facts: all but contradictions."""
    return (kind != "inconsistency") | detail.startswith("blocked-none")


def semantic_gaps(parts: DataFrame, facts: DataFrame) -> DataFrame:
    """V4: facts (doc_id, kind, text, section) that their section does not bear out, or contradicts.

    Kinds are constraint, goal and decision; a constraint may stand in the critical context
    too. One row per fact and section is judged, in Arrow batches.
    """
    told = parts.select("doc_id", F.col("kind").alias("section"), "body")
    also = parts.where("kind = 'critical-context'").select("doc_id", F.col("body").alias("context"))
    met = facts.join(told, ["doc_id", "section"], "left").join(also, "doc_id", "left")
    context = F.when(F.col("kind") == "constraint", F.coalesce("context", F.lit(""))).otherwise("")
    target = F.concat_ws("\n", F.coalesce("body", F.lit("")), context)
    seen = met.withColumn("j", judged(F.col("text"), target))
    goal = F.col("kind") == "goal"
    missing = _gap(seen.where("NOT j.evidence"), F.concat(F.lit("missing-"), "kind"), F.col("text"), F.when(goal, 12).otherwise(8))
    against = _gap(seen.where("j.contradiction"), "inconsistency", F.concat(F.col("kind"), F.lit(" contradicted: "), F.substring("text", 1, 80)), 20)
    return missing.unionByName(against)


# ---------------------------------------------------------------- lines and paths in sections


def next_actions(parts: DataFrame, most: int = 15) -> DataFrame:
    """The bullets of the next steps, in order."""
    return _bullets(parts, "next-steps", most)


def critical_context(parts: DataFrame, most: int = 20) -> DataFrame:
    """C52."""
    return _bullets(parts, "critical-context", most)


def _bullets(parts: DataFrame, kind: str, most: int) -> DataFrame:
    rows = parts.where(F.col("kind") == kind).select("doc_id", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    bare = _stripped(F.regexp_replace("line", r"\A\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?", ""))
    said = rows.withColumn("text", bare).where((F.col("text") != "") & ~F.lower("text").isin("none", "none recorded"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    return said.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("doc_id", "place", "text")


def path_line(path: Column, most: int) -> Column:
    """A path as one JSON string; a long one as its end and a digest of all of it."""
    quoted = F.regexp_extract(F.to_json(F.array(path)), r"(?s)\A\[(.*)\]\z", 1)
    digest = F.substring(F.sha2(path, 256), 1, 8)
    short = F.to_json(F.array(F.concat(F.lit("…"), F.right(path, F.lit(max(1, most - 13))), F.lit("#"), digest)))
    return F.when(F.length(quoted) <= most, quoted).otherwise(F.regexp_extract(short, r"(?s)\A\[(.*)\]\z", 1))


def path_evidence(paths: DataFrame, budget_chars: int) -> DataFrame:
    """Paths (doc_id, path) as lines; whole while the document's budget allows, else short.

    Whether all fit whole is one sum per document, so the choice is a window, not a loop.
    """
    whole = F.sum(F.length(path_line(F.col("path"), 1 << 20)) + 3).over(Window.partitionBy("doc_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    share = F.greatest(F.lit(24), F.floor(F.lit(budget_chars) / n).cast("int"))
    digest = F.substring(F.sha2("path", 256), 1, 8)
    short = F.concat(F.lit('"…'), F.expr("right(path, greatest(1, share - 13))"), F.lit("#"), digest, F.lit('"'))
    line = F.when((F.col("whole") <= budget_chars) | (F.length(path_line(F.col("path"), 1 << 20)) <= F.col("share")), path_line(F.col("path"), 1 << 20)).otherwise(short)
    return paths.withColumns({"whole": whole, "share": share}).select("doc_id", "path", F.concat(F.lit("- "), line).alias("line"))


def delta_section(changes: DataFrame) -> DataFrame:
    """Changes (doc_id, kind, text, change) as the body of the section that tells of them."""
    label = F.concat(F.initcap("change"), F.lit(" "), F.col("kind"), F.lit(": "), F.regexp_replace("text", r"\s+", " "))
    told = changes.where("change <> 'persistent'")
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- "), label)))
    return told.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text")).select("doc_id", F.lit("changes").alias("kind"), "text")


def with_delta(parts: DataFrame, changes: DataFrame) -> DataFrame:
    """The section of changes put in, or put anew."""
    return upserted(parts, delta_section(changes))


def with_open_loops(parts: DataFrame, loops: DataFrame) -> DataFrame:
    """Unresolved loops (doc_id, text, priority) as the open-loops section."""
    line = F.concat(F.lit("- ["), "priority", F.lit("] "), F.regexp_replace("text", r"\s+", " "))
    bodies = loops.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return upserted(parts, bodies.select("doc_id", F.lit("open-loops").alias("kind"), "text"))


def with_pinned_paths(parts: DataFrame, pinned: DataFrame) -> DataFrame:
    """Pinned paths (doc_id, path) that the files section does not list yet."""
    listed = listed_paths(parts).where("kind = 'files-modified'").select("doc_id", "path")
    new = pinned.distinct().join(listed, ["doc_id", "path"], "left_anti")
    bodies = new.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "path"))), "\n").alias("text"))
    return upserted(parts, bodies.select("doc_id", F.lit("files-modified").alias("kind"), "text"), append=True)


def recall_text(results: DataFrame, most: int = 4000) -> DataFrame:
    """Results (doc_id, place, kind, title, content) as one bounded text; tags are disarmed."""
    line = F.regexp_replace(F.concat(F.lit("- ["), "kind", F.lit("] "), "title", F.lit(": "), "content"), r"<(/?[A-Za-z])", "‹$1")
    order = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sized = results.withColumn("line", line).withColumn("upto", F.sum(F.length("line") + 1).over(order)).where(F.col("upto") <= most)
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return sized.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def section_identity(kind: Column, heading: Column) -> Column:
    """E31."""
    return F.when(kind == "unknown", F.concat(F.lit("unknown:"), F.lower(F.trim(F.regexp_replace(heading, r"\A#+\s*", ""))))).otherwise(kind)
