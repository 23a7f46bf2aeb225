"""Messages with JSON content blocks as relations: text, tool calls, results, media.

``content`` is JSON: a string, or an array of strings and blocks. Everything is done with
JSON functions and array functions in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.tools import TRUNCATED

# Fixed values.
ROLES = ("user", "assistant", "toolResult")
PARALLEL = "multi_tool_use.parallel"
MEDIA_RULES = (
    ("image", "image|input_image|image_url"), ("audio", "audio"), ("video", "video"), ("file", "file|document|pdf|attachment"),
)
_BLOCK = (
    "struct<type:string,text:string,id:string,name:string,arguments:string,mimeType:string,mime_type:string,mediaType:string,media_type:string,"
    "filename:string,title:string,sizeBytes:double,size_bytes:double,size:double,url:string,path:string,data:string,base64:string>"
)
_USES = "struct<tool_uses:array<struct<recipient_name:string,id:string,parameters:string>>>"


def blocks(content: Column) -> Column:
    """The content as raw JSON items; a bare string is one item."""
    items = F.from_json(content, "array<string>")
    return F.when(content.startswith("["), items).otherwise(F.array().cast("array<string>"))


def flat_text(content: Column) -> Column:
    """String items and text blocks put together without a separator; else empty."""
    def part(item: Column) -> Column:
        block = F.from_json(item, "struct<type:string,text:string>")
        return F.when(~item.startswith("{"), item).when(block["type"] == "text", F.coalesce(block["text"], F.lit(""))).otherwise("")

    joined = F.array_join(F.transform(blocks(content), part), "")
    bare = F.get(F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(content.startswith("["), joined).when(content.startswith('"'), F.coalesce(bare, F.lit(""))).otherwise("")


def normalised(log: DataFrame) -> DataFrame:
    """S3: log rows of known roles; the stamp parsed, or null if it is none."""
    return log.where(F.col("role").isin(*ROLES)).withColumn("ts", F.try_to_timestamp("ts"))


def wanted(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The first row of each wanted id, even if it then normalises to nothing."""
    first = Window.partitionBy("session_id", "entry_id").orderBy("line")
    picked = log.join(ids, ["session_id", "entry_id"], "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return normalised(picked)


def recovered(branch: DataFrame, log: DataFrame) -> DataFrame:
    """Truncated messages get their text from the log if that has it whole."""
    cut = F.col("text").rlike(TRUNCATED)
    cuts = branch.withColumn("cut", cut)
    whole = log.select("session_id", "entry_id", F.col("text").alias("logged")).where(~F.col("logged").rlike(TRUNCATED))
    met = cuts.join(whole.dropDuplicates(["session_id", "entry_id"]), ["session_id", "entry_id"], "left")
    some = F.max("cut").over(Window.partitionBy("session_id"))
    text = F.when(some & F.col("cut"), F.coalesce("logged", "text")).otherwise(F.col("text"))
    return met.select("session_id", "idx", "entry_id", "role", text.alias("text"), (F.col("cut") & F.col("logged").isNotNull()).alias("recovered"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """The calls of assistant messages, parallel wrappers expanded; last write of an id wins."""
    rows = messages.where("role = 'assistant'").select("session_id", "idx", F.posexplode(blocks(F.col("content"))).alias("place", "item"))
    read = rows.withColumn("b", F.from_json("item", _BLOCK)).where("b.type = 'toolCall' AND b.name IS NOT NULL")
    uses = F.from_json("b.arguments", _USES)["tool_uses"]
    nested = F.transform(
        uses,
        lambda u, i: F.struct(
            F.regexp_replace(F.coalesce(u["recipient_name"], F.lit("")), r"\Afunctions\.", "").alias("name"),
            F.coalesce(
                u["id"],
                F.concat(F.col("b.id"), F.lit("_"), i.cast("string")),
                F.concat(F.lit("mtu_"), F.col("idx").cast("string"), F.lit("_"), i.cast("string")),
            ).alias("call_id"),
            F.coalesce(u["parameters"], F.lit("{}")).alias("args"),
        ),
    )
    single = F.array(F.struct(F.col("b.name").alias("name"), F.col("b.id").alias("call_id"), F.coalesce("b.arguments", F.lit("{}")).alias("args")))
    calls = F.when((F.col("b.name") == PARALLEL) & uses.isNotNull(), nested).otherwise(single)
    flat = read.select("session_id", "idx", "place", F.posexplode(calls).alias("n", "c")).select("session_id", "idx", "place", "n", "c.*")
    last = Window.partitionBy("session_id", "call_id").orderBy(F.desc("idx"), F.desc("place"), F.desc("n"))
    numbered = flat.where("call_id IS NOT NULL").withColumn("k", F.row_number().over(last)).where("k = 1")
    return numbered.select("session_id", "idx", "call_id", "name", "args")


def media_kind(kind: Column, mime: Column) -> Column:
    """P10."""
    text = F.lower(F.concat_ws(" ", kind, mime))
    found = F.lit("unknown")
    for name, pattern in reversed(MEDIA_RULES):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def media(messages: DataFrame) -> DataFrame:
    """Attachments by their descriptions, never their bytes."""
    rows = messages.select("session_id", "idx", F.explode(blocks(F.col("content"))).alias("item")).where(F.col("item").startswith("{"))
    read = rows.withColumn("b", F.from_json("item", _BLOCK)).where("coalesce(b.type, '') NOT IN ('text', 'toolCall', 'tool_use')")
    mime = F.coalesce("b.mimeType", "b.mime_type", "b.mediaType", "b.media_type")
    name = F.coalesce("b.name", "b.filename", F.get_json_object("item", "$.fileName"), "b.title")
    source = F.when(F.col("b.url").isNotNull(), "url").when(F.col("b.path").isNotNull(), "path").when(F.coalesce("b.data", "b.base64").isNotNull(), "inline")
    kind = media_kind(F.coalesce("b.type", F.lit("")), mime)
    found = read.select(
        "session_id", "idx", kind.alias("kind"), mime.alias("mime"), name.alias("name"),
        F.coalesce("b.sizeBytes", "b.size_bytes", "b.size").cast("long").alias("bytes"), source.alias("source"),
    )
    return found.where("kind <> 'unknown' OR source IS NOT NULL OR mime IS NOT NULL OR name IS NOT NULL")


def rendered(messages: DataFrame, calls: DataFrame, most: int = 500) -> DataFrame:
    """One line per message, its text and its calls each cut."""
    own = calls.groupBy("session_id", "idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_id", "name", "args"))), lambda c: F.concat(c["name"], F.lit(" "), c["args"])), "; ").alias("calls")
    )
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.substring("text", 1, most))
    both = F.when(F.col("calls").isNotNull(), F.concat(line, F.lit("\n[tool_calls] "), F.substring("calls", 1, most))).otherwise(line)
    return messages.join(own, ["session_id", "idx"], "left").select("session_id", "idx", both.alias("line"))


# ---------------------------------------------------------------- exploration (table functions)


def message_range(messages: DataFrame, start: int, end: int, preview: int = 150) -> DataFrame:
    """The half-open range of positions, with a preview."""
    return messages.where((F.col("idx") >= start) & (F.col("idx") < end)).select("session_id", "idx", "role", F.substring("text", 1, preview).alias("preview"))


def search(messages: DataFrame, needle: str, most: int = 10) -> DataFrame:
    """The first messages of each session that hold the needle in any case."""
    found = messages.where(F.contains(F.lower("text"), F.lit(needle.lower())))
    order = Window.partitionBy("session_id").orderBy("idx")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("session_id", "idx", "role")


def recent_user_messages(messages: DataFrame, n: int = 5) -> DataFrame:
    """The last 1 to 50 user messages of each session."""
    back = Window.partitionBy("session_id").orderBy(F.desc("idx"))
    users = messages.where("role = 'user'").withColumn("n", F.row_number().over(back))
    return users.where(F.col("n") <= max(1, min(50, n))).select("session_id", "idx", "text")


def around(messages: DataFrame, centres: DataFrame, radius: int = 8, most: int = 25, chars: int = 300) -> DataFrame:
    """The messages around each centre (session_id, centre) of a session."""
    reach = max(0, min(most, radius))
    met = messages.join(centres, "session_id").where(F.col("idx").between(F.col("centre") - reach, F.col("centre") + reach))
    return met.select("session_id", "centre", "idx", "role", F.substring("text", 1, chars).alias("text"))


def file_changes(steps: DataFrame, target: str, most: int = 15) -> DataFrame:
    """Mutating calls whose path holds the target, the first of each session."""
    found = steps.where((F.col("operation") == "mutate") & F.contains(F.lower("path"), F.lit(target.lower())))
    order = Window.partitionBy("session_id").orderBy("idx")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("session_id", "idx", "path")


# ---------------------------------------------------------------- damage after compaction

COMPLAINTS = (
    r"(?iu)(?:I already (?:told|said|mentioned|explained) you|(?:we|I) (?:already|just) (?:discussed|went over|covered) this|you forgot|you lost|"
    "nerede kaldı|hatırlamıyor|unuttun)",
    r"(?iu)(?:that'?s? not (?:what I|right)|that'?s? wrong|yanlış|hayır değil|no that'|that doesn'?t match)",
)
SEVERITY = {"high": 25, "medium": 10, "low": 0}


def damage_signals(after: DataFrame, steps: DataFrame, compacted: DataFrame, topics: DataFrame) -> DataFrame:
    """Signs that a compaction lost something; each type and detail once.

    ``after`` (session_id, idx, role, text) are messages after the compaction, ``steps`` the
    calls among them, ``compacted`` (session_id, path) and ``topics`` (session_id, topic,
    words) what was compacted.
    """
    files = compacted.select("session_id", F.lower("path").alias("low")).distinct()
    reads = steps.where(F.col("operation").isin("read", "search", "list") & F.col("path").isNotNull()).withColumn("low", F.lower("path"))
    again = reads.join(files, ["session_id", "low"], "left_semi").groupBy("session_id", "low").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("path", "idx").alias("path")
    )
    reread = again.where("n >= 2").select("session_id", F.lit("re-read").alias("type"), F.lit("medium").alias("severity"), F.col("path").alias("detail"))
    users = after.where("role = 'user'").withColumn("low", F.lower("text"))
    complaint = users.where(F.col("low").rlike(COMPLAINTS[0]) | F.col("low").rlike(COMPLAINTS[1])).select(
        "session_id", F.lit("user-complaint").alias("type"), F.lit("high").alias("severity"), F.substring("low", 1, 100).alias("detail")
    )
    asked = users.join(topics, "session_id").where(F.exists("words", lambda w: F.contains(F.col("low"), F.lower(w))))
    question = asked.select("session_id", F.lit("re-question").alias("type"), F.lit("low").alias("severity"), F.substring("topic", 1, 80).alias("detail"))
    return reread.unionByName(complaint).unionByName(question).distinct()


def damage_scores(signals: DataFrame) -> DataFrame:
    """25 for each high, 10 for each medium signal, at most 100."""
    points = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), F.col("severity"))
    return signals.groupBy("session_id").agg(
        F.least(F.lit(100), F.sum(points)).cast("long").alias("score"),
        F.count(F.when(F.col("type") == "re-read", 1)).alias("re_reads"),
        F.count(F.when(F.col("type") == "user-complaint", 1)).alias("complaints"),
    )
