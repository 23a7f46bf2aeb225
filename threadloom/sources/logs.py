"""Logs and snapshots: JSONL scans, discovery, tails, expiry; appends, snapshots, reports.

Files are read and written by Spark, so paths can be in any store that it knows.
"""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import escape_html, scrub

LOG_SCHEMA = (
    "id string, type string, timestamp string, cwd string, message struct<role:string,content:string,toolCallId:string,toolName:string,isError:boolean>"
)
BACKUP_MAGIC = "# Conversation Backup"
BACKUPS_LISTED, BACKUPS_KEPT, BACKUP_DAYS = 20, 20, 14


def read_jsonl(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Rows of JSON lines with their place; empty and malformed lines are skipped.

    ``line`` (place of the split in the file, place in the split) orders the rows of one file
    without a pass over it.
    """
    lines = spark.read.text(path).withColumns(
        {"file": F.col("_metadata.file_name"), "block": F.col("_metadata.file_block_start"), "n": F.monotonically_increasing_id()}
    )
    read = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    valid = F.col("value").rlike(r"\A\s*\{") & F.try_parse_json("value").isNotNull()
    return read.where(valid).select("file", F.struct("block", "n").alias("line"), "r.*")


def find_log(spark: SparkSession, root: str, session_id: str, cwd_dir: str | None = None) -> DataFrame:
    """The log file of a session: its own name, else a name ending with it; the directory of
    the working folder first, then every other."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{session_id}.jsonl").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    named = files.select("path", name.alias("name"), folder.alias("folder")).where(
        (F.col("name") == f"{session_id}.jsonl") | F.col("name").endswith(f"_{session_id}.jsonl")
    )
    elsewhere = F.col("folder") != F.lit(cwd_dir or "")
    longer = F.col("name") != f"{session_id}.jsonl"
    return named.orderBy(elsewhere, longer, "path").limit(1).select("path")


def tail(rows: DataFrame, limit: int, order: str) -> DataFrame:
    """The last rows, oldest first; a top-k, not a sort of the log."""
    return rows.orderBy(F.desc(order)).limit(limit).orderBy(order)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON snapshot; a corrupt one gives a row of nulls that callers drop."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines; each writer's file is committed whole."""
    rows.write.mode("append").json(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """Replace a snapshot; readers see the old or the new one."""
    rows.write.mode("overwrite").json(path)


def remediation_hints(paths: DataFrame, *keys: str) -> DataFrame:
    """Distinct trimmed paths that are not empty."""
    return paths.withColumn("path", F.trim("path")).where("path <> ''").select(*keys, "path").distinct()


# ---------------------------------------------------------------- backups


def backup_name(session: Column, stamp: Column, text: Column) -> Column:
    """Safe session, stamp and eight digits of the text's hash."""
    safe = F.regexp_replace(session, "[^A-Za-z0-9_-]", "_")
    return F.concat_ws("-", safe, F.date_format(stamp, "yyyyMMdd'T'HHmmss"), F.substring(F.sha2(text, 256), 1, 8))


def backup_text(session: Column, stamp: Column, body: Column, redact: bool = True) -> Column:
    """Header and body, redacted."""
    told = scrub(body)[0] if redact else body
    return F.concat(
        F.lit(f"{BACKUP_MAGIC}\nDate: "), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\nSession: "), session, F.lit("\n\n"), told
    )


def list_backups(spark: SparkSession, path: str, limit: int = BACKUPS_LISTED) -> DataFrame:
    """Owned backups, newest first."""
    files = spark.read.text(path, wholetext=True).where(F.col("value").startswith(BACKUP_MAGIC))
    read = files.select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_extract("value", r"(?m)^Date: (.+)$", 1).alias("date"),
        F.regexp_extract("value", r"(?m)^Session: (.+)$", 1).alias("session"),
        F.col("value"),
    )
    return read.orderBy(F.desc("date"), "path").limit(limit)


def backup_body(text: Column) -> Column:
    """What follows the header."""
    return F.regexp_replace(text, r"(?s)\A# Conversation Backup\n(?:[A-Z][a-z]+: [^\n]*\n)*\n", "")


def expired_backups(backups: DataFrame, now: Column, keep: int = BACKUPS_KEPT, days: int = BACKUP_DAYS) -> DataFrame:
    """Beyond the newest ones, or too old."""
    n = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("stamp"), "path"))
    return backups.withColumn("n", n).where((F.col("n") > keep) | (F.col("stamp") < now - F.make_interval(days=F.lit(days)))).drop("n")


# ---------------------------------------------------------------- reports


def text_report(title: str, rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One line per row, as a table that a text sink can write."""
    names = list(columns)
    line = F.concat_ws(" | ", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("—"))) for c in names])
    return rows.select(F.concat(F.lit(f"{title}: "), line).alias("value"))


def html_rows(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Table rows of a dashboard, escaped; the page's frame comes from :func:`html_page`."""
    cells = [F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def html_page(title: str, columns: Iterable[str], lines: list[str]) -> str:
    """The page around a bounded list of rows (a top-k report)."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<!doctype html><title>{html.escape(title)}</title><table><tr>{head}</tr>{''.join(lines)}</table>"
