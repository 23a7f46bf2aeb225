"""Versioned continuity state as item tables: merges, deltas, overrides, lineage lookups.

A state is rows (session_id, kind, ord, text, ...). Items are the same when their fact keys
are equal. Every operation is an aggregate, a window or a join by session and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import evidence_line, fact_key, project_hash

# The most items of a kind that a state keeps.
CAPS = {
    "decision": 30, "constraint": 30, "unresolved": 15, "resolved": 20, "loop": 25, "modified": 100, "read": 100,
    "deleted": 50, "topic": 30, "action": 15, "context": 20, "override": 50,
}
PRIORITY = {"critical": 0, "high": 1, "normal": 2, "low": 3}
PREFIX_LENGTH = 16  # a shorter loop summary is not taken for the start of an error
PREVIOUS_GOAL = "Previous goal: "
ID_PREFIX = {"decision": "decision-", "constraint": "constraint-", "unresolved": "error-", "loop": "loop-"}


def _cap(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in CAPS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(2**31 - 1))


def recent_unique(items: DataFrame, limit: int, *keys: str, item: str = "text", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The most recent distinct items of each key, and how many were dropped."""
    last = items.groupBy(*keys, item).agg(F.max(order).alias(order))
    back = Window.partitionBy(*keys).orderBy(F.desc(order), item)
    numbered = last.withColumn("n", F.row_number().over(back))
    dropped = numbered.groupBy(*keys).agg(F.greatest(F.lit(0), F.max("n") - limit).cast("long").alias("dropped"))
    return numbered.where(F.col("n") <= limit).drop("n"), dropped


def merged(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current items first, then previous ones; each key once, up to the kind's cap.

    A previous unresolved error goes when its key is now among the resolved ones.
    """
    sides = current.withColumn("side", F.lit(0)).unionByName(previous.withColumn("side", F.lit(1)))
    keyed = sides.withColumn("key", fact_key(F.col("text"))).where("key <> ''")
    settled = keyed.where("side = 0 AND kind = 'resolved'").select(F.col("session_id").alias("s"), F.col("key").alias("k")).distinct()
    retired = (F.col("kind") == "unresolved") & (F.col("side") == 1) & (F.col("session_id") == F.col("s")) & (F.col("key") == F.col("k"))
    alive = keyed.join(settled, retired, "left_anti")
    first = Window.partitionBy("session_id", "kind", "key").orderBy("side", "ord")
    distinct = alive.withColumn("n", F.row_number().over(first)).where("n = 1")
    place = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy("side", "ord", "key"))
    numbered = distinct.withColumn("place", place).where(F.col("place") <= _cap(F.col("kind")))
    prefixes = F.create_map(*[F.lit(x) for pair in ID_PREFIX.items() for x in pair])
    prefix = F.coalesce(F.element_at(prefixes, F.col("kind")), F.concat("kind", F.lit("-")))
    return numbered.select("session_id", "kind", "place", F.concat(prefix, F.col("place").cast("string")).alias("id"), "text", "side")


def merged_loops(current: DataFrame, previous: DataFrame) -> DataFrame:
    """T4: open loops before resolved ones, by priority, then as they came; ids anew."""
    sides = current.withColumn("side", F.lit(0)).unionByName(previous.withColumn("side", F.lit(1)))
    keyed = sides.withColumn("key", fact_key(F.col("text"))).where("key <> ''")
    first = Window.partitionBy("session_id", "key").orderBy("side", "ord")
    distinct = keyed.withColumn("n", F.row_number().over(first)).where("n = 1")
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.col("priority"))
    order = Window.partitionBy("session_id").orderBy((F.col("status") == "resolved").cast("int"), rank, "side", "ord", "key")
    numbered = distinct.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CAPS["loop"])
    return numbered.select(
        "session_id", "place", F.concat(F.lit(ID_PREFIX["loop"]), F.col("place").cast("string")).alias("id"), "text", "status", "priority"
    )


def retired_loops(loops: DataFrame, resolved: DataFrame) -> DataFrame:
    """T5's rule: an open bug-fix loop is resolved when a resolved error's key equals its key or
    extends it, and its key is long enough to be told by its start.

    The join is by the first letters that both must share, so it stays an equi-join.
    """
    head = F.substring("key", 1, PREFIX_LENGTH)
    keyed = loops.withColumn("key", fact_key(F.col("text"))).withColumn("head", head)
    errors = resolved.select(F.col("session_id").alias("s"), fact_key(F.col("text")).alias("error")).withColumn("h", F.substring("error", 1, PREFIX_LENGTH))
    open_bug = (F.col("type") == "bugfix") & (F.col("status") == "open") & (F.length("key") >= PREFIX_LENGTH)
    starts = (F.col("session_id") == F.col("s")) & (F.col("head") == F.col("h")) & F.startswith(F.col("error"), F.col("key"))
    done = keyed.where(open_bug).join(errors, starts, "left_semi").select("session_id", "key").distinct().withColumn("done", F.lit(True))
    status = F.when(F.col("done") & open_bug, "resolved").otherwise(F.col("status"))
    return keyed.join(done, ["session_id", "key"], "left").withColumn("status", status).drop("done", "head", "key")


def file_sets(current: DataFrame, previous: DataFrame) -> DataFrame:
    """T5's files: a file deleted now leaves the earlier modified and read sets; one present now
    leaves the earlier deleted set. Rows (session_id, kind, text, ord)."""
    key = fact_key(F.col("text"))
    now = current.withColumn("key", key)
    present = now.where("kind IN ('modified', 'read')").select(F.col("session_id").alias("s"), F.col("key").alias("k"), F.lit("deleted").alias("gone"))
    deleted = now.where("kind = 'deleted'").select(F.col("session_id").alias("s"), F.col("key").alias("k"), F.explode(F.array(F.lit("modified"), F.lit("read"))).alias("gone"))
    against = present.unionByName(deleted).distinct()
    same = (F.col("session_id") == F.col("s")) & (F.col("key") == F.col("k")) & (F.col("kind") == F.col("gone"))
    kept = previous.withColumn("key", key).join(against, same, "left_anti")
    return merged(now.drop("key"), kept.drop("key")).select("session_id", "kind", "text", F.col("place").alias("ord"))


def delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Per session, kind and key whether it is new, persistent or gone; ``resolved`` where
    a previous unresolved error is among the current resolved ones."""
    key = fact_key(F.col("text"))
    sides = [
        x.where("kind <> 'resolved'").withColumn("key", key).groupBy("session_id", "kind", "key").agg(F.min_by("text", "ord").alias(name))
        for x, name in ((previous, "before"), (current, "now"))
    ]
    both = sides[0].join(sides[1], ["session_id", "kind", "key"], "full")
    done = current.where("kind = 'resolved'").select("session_id", key.alias("key")).distinct().withColumn("done", F.lit(True))
    met = both.join(done, ["session_id", "key"], "left")
    change = (
        F.when(F.col("before").isNull(), "new")
        .when((F.col("kind") == "unresolved") & F.col("done"), "resolved")
        .when(F.col("now").isNotNull(), "persistent")
        .otherwise("gone")
    )
    return met.select("session_id", "kind", F.coalesce("now", "before").alias("text"), change.alias("change"))


def delta_summary(changes: DataFrame) -> DataFrame:
    """How many changes of each sort, and whether there is any worth telling."""
    counts = {c: F.count(F.when(F.col("change") == c, 1)) for c in ("new", "resolved", "persistent", "gone")}
    told = changes.groupBy("session_id").agg(*[v.alias(k) for k, v in counts.items()])
    return told.withColumn("changed", (F.col("new") > 0) | (F.col("resolved") > 0))


def latest_overrides(overrides: DataFrame, *keys: str) -> DataFrame:
    """The last override of each key; ids and keys of the first stay."""
    return overrides.groupBy(*keys).agg(F.max_by(F.struct("status", "replacement", "pinned"), "ord").alias("o")).select(*keys, "o.*")


def with_loop_overrides(loops: DataFrame, overrides: DataFrame) -> DataFrame:
    """The override's status wins; pinned loops come first, the rest as they were."""
    last = latest_overrides(overrides.where("kind = 'loop'"), "session_id", "key")
    keyed = loops.withColumn("key", fact_key(F.col("text")))
    met = keyed.join(last.withColumnRenamed("status", "new_status"), ["session_id", "key"], "left")
    order = Window.partitionBy("session_id").orderBy(F.desc(F.coalesce("pinned", F.lit(False))), "ord")
    return met.select(
        "session_id", F.row_number().over(order).alias("place"), "text", F.coalesce("new_status", "status").alias("status"), F.coalesce("pinned", F.lit(False)).alias("pinned")
    )


def without_overridden(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """Items whose key has an override that is not active go; replacements are told as
    context, before the context there was."""
    last = latest_overrides(overrides, "session_id", "kind", "key")
    off = last.where("status <> 'active'").select("session_id", "kind", "key")
    kept = items.withColumn("key", fact_key(F.col("text"))).join(off, ["session_id", "kind", "key"], "left_anti")
    told = last.where("status = 'superseded' AND replacement IS NOT NULL").select(
        "session_id", F.lit("context").alias("kind"), F.lit(-1).cast("long").alias("ord"),
        F.concat(F.lit("Superseded "), "kind", F.lit(": "), "replacement").alias("text"),
    )
    return kept.select("session_id", "kind", "ord", "text").unionByName(told)


# ---------------------------------------------------------------- lineage


def as_of_snapshot(lineage: DataFrame) -> DataFrame:
    """For each branch entry the nearest ancestor, itself first, that has a snapshot.

    The ancestry is a chain by rank, so the answer is a running last value.
    """
    upto = Window.partitionBy("session_id").orderBy("lineage_rank").rowsBetween(Window.unboundedPreceding, 0)
    return lineage.select(
        "session_id", "branch_id", F.last(F.when(F.col("has_snapshot"), F.col("branch_id")), ignorenulls=True).over(upto).alias("snapshot_id")
    )


def latest_facts(facts: DataFrame) -> DataFrame:
    """The latest version of each fact on a lineage; tombstones count as versions."""
    keyed = facts.withColumn("key", fact_key(F.col("text")))
    version = F.struct("lineage_rank", "updated_at", "branch_id")
    return keyed.groupBy("session_id", "kind", "key").agg(
        F.max_by("status", version).alias("status"), F.max_by("branch_id", version).alias("branch_id"), F.count(F.lit(1)).alias("versions")
    )


def bounded_lineage(entries: DataFrame, most: int) -> DataFrame:
    """The last quarter of the bound from structural entries, the rest from the tail."""
    quarter = max(1, most // 4)
    back = Window.partitionBy("session_id").orderBy(F.desc("lineage_rank"))
    structural = entries.where("has_snapshot").withColumn("n", F.row_number().over(back)).where(F.col("n") <= quarter)
    tail = entries.withColumn("n", F.row_number().over(back)).where(F.col("n") <= most)
    both = structural.select("session_id", "branch_id", "lineage_rank").unionByName(tail.select("session_id", "branch_id", "lineage_rank")).distinct()
    special = structural.select("session_id", "branch_id", F.lit(1).alias("s"))
    marked = both.join(special, ["session_id", "branch_id"], "left")
    order = Window.partitionBy("session_id").orderBy(F.desc(F.coalesce("s", F.lit(0))), F.desc("lineage_rank"))
    return marked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("session_id", "branch_id", "lineage_rank")


def fresh(rows: DataFrame, stamp: str, now: Column, days: int) -> DataFrame:
    """Rows no older than so many days."""
    return rows.where(F.col(stamp) >= now - F.make_interval(days=F.lit(days)))


def retained(rows: DataFrame, most: int, *keys: str, order: Column) -> DataFrame:
    """The newest rows of each key."""
    back = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("__n__", F.row_number().over(back)).where(F.col("__n__") <= most).drop("__n__")


def within_bytes(rows: DataFrame, cap: int, *keys: str, order: str, size: str) -> DataFrame:
    """K3, K4, K5: the newest whole lines that together stay within a byte cap."""
    back = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__b__", F.sum(size).over(back)).where(F.col("__b__") <= cap).drop("__b__")


# ---------------------------------------------------------------- project fingerprint

# Languages by file extension, frameworks by path pattern (the first that fits).
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "py": "python", "go": "go", "java": "java",
    "rb": "ruby", "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "swift": "swift", "kt": "kotlin", "php": "php",
}
FRAMEWORKS = (
    ("nextjs", "next\\.config"), ("nuxt", "nuxt\\.config"), ("vite", "vite\\.config"), ("astro", "astro\\.config"), ("tailwind", "tailwind\\.config"),
    ("django", "django"), ("flask", "flask"), ("cargo", "cargo\\.toml"), ("go-modules", "go\\.mod"), ("bundler", "Gemfile"), ("node", "package\\.json"),
)
FOREIGN_PATH = r"(?:node_modules|[/\\]\.cache|[/\\]\.npm|[/\\]\.bun|[/\\]\.git[/\\])"
CAPSULE_CHARS, CAPSULE_LINE, CAPSULE_HEAD = 4000, 300, "## Continuity Ledger"
PREVIOUS_SUMMARY_CHARS = 12_000


def main_language(paths: DataFrame, *keys: str) -> DataFrame:
    """The language of most paths; of equal counts the one seen first."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    counted = paths.withColumn("language", F.element_at(names, extension)).where("language IS NOT NULL")
    sums = counted.groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("files"), F.min("ord").alias("seen"))
    return sums.groupBy(*keys).agg(F.max_by("language", F.struct("files", -F.col("seen"))).alias("language"), F.max("files").alias("files"))


def key_directories(paths: DataFrame, *keys: str, most: int = 8) -> DataFrame:
    """The directories of most paths."""
    folder = F.regexp_extract("path", r"\A(.*)/[^/]+\z", 1)
    counted = paths.withColumn("dir", folder).where("dir <> ''").groupBy(*keys, "dir").agg(F.count(F.lit(1)).alias("files"))
    top = Window.partitionBy(*keys).orderBy(F.desc("files"), "dir")
    return counted.withColumn("place", F.row_number().over(top)).where(F.col("place") <= most)


def project_root(paths: DataFrame, *keys: str, depth: int = 3, share: float = 0.5) -> DataFrame:
    """The deepest prefix of some depth that covers at least half of the absolute paths."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    split = paths.select(*keys, parts.alias("parts")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    long = split.where(F.size("parts") > depth)
    at = long.select(*keys, "n", "parts", F.explode(F.sequence(F.lit(depth), F.size("parts") - 1)).alias("depth"))
    prefixes = at.groupBy(*keys, "depth", F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).alias("root")).agg(
        F.count(F.lit(1)).alias("held"), F.max("n").alias("n")
    )
    good = prefixes.where(F.col("held") >= F.col("n") * share)
    return good.groupBy(*keys).agg(F.max_by("root", F.struct("depth", "held", "root")).alias("root"))


# ---------------------------------------------------------------- incremental extraction


def merged_file_states(base: DataFrame, later: DataFrame, offset: Column) -> DataFrame:
    """T6 for files: states (session_id, path, modified_count, last_modified, last_read,
    deleted_at) of a prefix and of what follows it, whose positions start at ``offset``.

    A path deleted later is deleted; one touched later is present; counts add up.
    """
    b, d = base.alias("b"), later.alias("d")
    met = b.join(d, (F.col("b.session_id") == F.col("d.session_id")) & (F.col("b.path") == F.col("d.path")), "full")
    gone = F.col("d.deleted_at").isNotNull()
    touched = F.col("d.path").isNotNull() & ~gone

    def last(name: str) -> Column:
        return F.when(~gone, F.coalesce(F.col(f"d.{name}") + offset, F.col(f"b.{name}"))).alias(name)

    count = F.coalesce("b.modified_count", F.lit(0)) + F.coalesce("d.modified_count", F.lit(0))
    return met.select(
        F.coalesce("b.session_id", "d.session_id").alias("session_id"),
        F.coalesce("b.path", "d.path").alias("path"),
        F.when(gone, 0).otherwise(count).cast("long").alias("modified_count"),
        last("last_modified"),
        last("last_read"),
        F.when(gone, F.col("d.deleted_at") + offset).when(touched, F.lit(None)).otherwise(F.col("b.deleted_at")).alias("deleted_at"),
    )


def merged_rows(base: DataFrame, later: DataFrame, offset: Column, cap: int, *keys: str) -> DataFrame:
    """T6 for lists of facts: the later rows moved by the offset, and the newest of each session
    up to the cap; of rows with equal ``keys`` the first stays."""
    both = base.unionByName(later.withColumn("idx", F.col("idx") + offset))
    first = Window.partitionBy("session_id", *keys).orderBy("idx")
    back = Window.partitionBy("session_id").orderBy(F.desc("idx"), *keys)
    once = both.withColumn("__n__", F.row_number().over(first)).where("__n__ = 1")
    return once.withColumn("__b__", F.row_number().over(back)).where(F.col("__b__") <= cap).drop("__n__", "__b__")


def project_paths(paths: DataFrame) -> DataFrame:
    """paths that can tell a project: not those of dependencies and caches."""
    return paths.where(~F.col("path").rlike(FOREIGN_PATH))


def framework(paths: DataFrame, *keys: str) -> DataFrame:
    """The first framework in the list of which any path shows a sign."""
    sign = F.coalesce(*[F.when(F.col("path").rlike(f"(?i){p}"), F.lit(i)) for i, (_, p) in enumerate(FRAMEWORKS)])
    names = F.array(*[F.lit(n) for n, _ in FRAMEWORKS])
    first = paths.groupBy(*keys).agg(F.min(sign).alias("i"))
    return first.select(*keys, F.get(names, F.col("i")).alias("framework"))


def relative_project(paths: DataFrame, *keys: str, most: int = 8) -> DataFrame:
    """A project id from the first parts of relative paths and their commonest two-part folders."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    split = paths.withColumn("parts", parts).where(F.size("parts") > 0)
    tops = split.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(F.get("parts", F.lit(0)))), ",").alias("tops"))
    folders = split.where(F.size("parts") >= 2).groupBy(*keys, F.array_join(F.slice("parts", 1, 2), "/").alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "dir")
    best = folders.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    dirs = best.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("dir")), ",").alias("dirs"))
    seed = F.concat("tops", F.lit("|"), F.coalesce("dirs", F.lit("")))
    return tops.join(dirs, list(keys), "left").select(*keys, project_hash(seed).alias("project_id"))


def fingerprint(paths: DataFrame, *keys: str, files: int = 50, dirs: int = 20) -> DataFrame:
    """What is kept of a project: its last files and folders, and how many sessions it had."""
    folder = F.regexp_extract("path", r"\A(.*)/[^/]+\z", 1)
    last_files, _ = recent_unique(paths, files, *keys, item="path")
    last_dirs, _ = recent_unique(paths.withColumn("dir", folder).where("dir <> ''"), dirs, *keys, item="dir")
    sessions = paths.groupBy(*keys).agg(F.count_distinct("session_id").alias("sessions"))
    told = last_files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))
    held = last_dirs.groupBy(*keys).agg(F.count(F.lit(1)).alias("dirs"))
    return sessions.join(told, list(keys), "left").join(held, list(keys), "left")


def project_context(rows: DataFrame) -> DataFrame:
    """A fingerprint (project_id, sessions, language, framework, dirs) in words."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("## Project Context (learned from "), F.col("sessions").cast("string"), F.lit(" session(s))")),
        F.concat(F.lit("Language: "), F.coalesce("language", F.lit("unknown"))),
        F.concat(F.lit("Framework: "), "framework"),
        F.concat(F.lit("Key dirs: "), F.nullif("dirs", F.lit(""))),
    )
    return rows.select("project_id", lines.alias("text"))


def previous_context(branch: DataFrame) -> DataFrame:
    """What the latest compaction of a branch says; of equal stamps the later entry."""
    last = branch.where("type = 'compaction'").groupBy("session_id").agg(
        F.max_by(F.struct("method", "topics", "summary"), F.struct(F.coalesce(F.try_to_timestamp("stamp"), F.lit(0).cast("timestamp")), "ord")).alias("c")
    )
    topics = F.coalesce(F.nullif(F.array_join("c.topics", ", "), F.lit("")), F.lit("unknown"))
    head = F.concat(
        F.lit("[IMPORTANT: Previous compaction exists ("), F.coalesce("c.method", F.lit("unknown")), F.lit("). Already summarized topics: "), topics,
        F.lit(". Build upon this, don't drop still-relevant facts.]"),
    )
    body = F.concat(F.lit("Previous verified summary:\n"), F.nullif(F.substring("c.summary", 1, PREVIOUS_SUMMARY_CHARS), F.lit("")))
    return last.select("session_id", F.concat_ws("\n\n", head, body).alias("text"))


def continuity_capsule(items: DataFrame, existing: DataFrame, most: int = CAPSULE_CHARS) -> DataFrame:
    """Facts (session_id, ord, label, text) as lines under a head, in order, while they fit;
    facts that the text at hand holds already are left out.

    A line that does not fit is passed over, and later ones may fit: a fold over one
    session's lines.
    """
    at_hand = existing.select("session_id", fact_key(F.col("text")).alias("held"))
    said = items.withColumn("said", evidence_line(F.col("text"), CAPSULE_LINE)).where("said <> ''").join(at_hand, "session_id", "left")
    new = said.where(F.col("held").isNull() | ~F.contains(F.col("held"), fact_key(F.col("said"))))
    line = F.concat(F.lit("- "), "label", F.lit(": "), "said")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])
    text = F.aggregate(
        ordered, F.lit(CAPSULE_HEAD), lambda a, x: F.when(F.length(a) + F.length(x) + 1 <= most, F.concat(a, F.lit("\n"), x)).otherwise(a)
    )
    return new.groupBy("session_id").agg(F.nullif(text, F.lit(CAPSULE_HEAD)).alias("text"))


def deduped_text(items: DataFrame, *keys: str) -> DataFrame:
    """Items in order of first sight, each once, with how often it came."""
    once = items.groupBy(*keys, fact_key(F.col("text")).alias("key")).agg(F.min_by("text", "ord").alias("text"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    told = F.concat("text", F.when(F.col("n") > 1, F.concat(F.lit(" ×"), F.col("n").cast("string"))).otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("ord", told.alias("t"))))
    return once.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "; ").alias("text"))


def preprocessed(summaries: DataFrame) -> DataFrame:
    """Chunk summaries (session_id, ord, decisions, files) put together: decisions once, as
    first seen; files once, sorted."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "decisions", "files")))
    merged = summaries.groupBy("session_id").agg(ordered.alias("s"))
    return merged.select(
        "session_id",
        F.array_distinct(F.flatten(F.transform("s", lambda x: x["decisions"]))).alias("decisions"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: x["files"])))).alias("files"),
    )
