"""The queries opN_<name> over the driver's tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import block_naming_dedup
from .mixing import mix_sources
from .packing import best_fit_packing
from .pii import personal_data
from .quality_classifier import quality_scores
from .quality_rules import STOP, THRESHOLDS, Threshold, quality_rules
from .shared import load, shared_path
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .warc import ARCHIVE_ROWS, archived, copy_warc, fixity, write_warc


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming_dedup(load(spark, sf_dir, "documents")).drop("identity")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(load(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents")).drop("copies")


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC, a replica in which one record of 53 is damaged, and its audit.

    The damage is planted by rule (the replica's page says ``<!DOCTYPE`` in lower case, which
    leaves the length as it is), so that the answer is known.
    """
    first, second = shared_path(spark, "warc-a"), shared_path(spark, "warc-b")
    pages = load(spark, sf_dir, "pages")
    write_warc(archived(pages), first, archives=pages.count() // ARCHIVE_ROWS + 1)
    page = F.regexp_extract("record", r"<urn:page:(-?\d+)>", 1).cast("long")
    damaged = F.when(page % 53 == 7, F.regexp_replace("record", "<!DOCTYPE", "<!doctype"))
    copy_warc(spark, first, second, F.coalesce(damaged, F.col("record")))
    found, bad = fixity(spark, first, second)
    bad = bad.where("here").select("archive", "seq", F.lit(True).alias("damaged"))
    return found.join(bad, ["archive", "seq"], "left").select(
        F.regexp_extract("record_id", r"page:(-?\d+)", 1).cast("long").alias("page_id"),
        "archive",
        "seq",
        "offset",
        "length",
        F.col("sha256").alias("record_sha256"),
        "payload_ok",
        F.col("damaged").isNull().alias("intact"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(load(spark, sf_dir, "documents"), mask=False)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents")).drop("kept_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_personal_data": op9_personal_data,
    "op10_substring_dedup": op10_substring_dedup,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM normal WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""


def _bounds(t: Threshold) -> str:
    sides = [f"{t.value} {op} {bound}" for op, bound in ((">=", t.least), ("<=", t.most)) if bound is not None]
    return " AND ".join(sides)


OP5_SQL = rf"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
counted AS (
  SELECT *, CAST(len(words) AS BIGINT) AS n_words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM split),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM counted WHERE n_words >= 5),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS t FROM starts),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest(range(0, 5)) AS o FROM twice WHERE n > 1) GROUP BY doc_id),
measured AS (
  SELECT c.doc_id, n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(regexp_extract_all(text, '\p{{Lu}}')) AS BIGINT) AS n_upper,
    CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_exclaim,
    CAST(len(list_filter(words, lambda w: regexp_full_match(lower(w), '({STOP})[.,;:!?]*'))) AS BIGINT) AS n_stop,
    CAST(coalesce(list_max(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS longest_word
  FROM counted c LEFT JOIN covered v ON c.doc_id = v.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT *, CASE WHEN base_failed THEN false ELSE {" AND ".join(_bounds(t) for t in THRESHOLDS)} END AS kept FROM judged
"""

OP10_SQL = rf"""
WITH split AS (SELECT doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split WHERE len(words) >= 13),
windows AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(words[i:i + 12], ' ')) AS least FROM starts),
gone AS (
  SELECT doc_id, list(DISTINCT i + o) AS places
  FROM (SELECT doc_id, i, unnest(range(0, 13)) AS o FROM windows WHERE least < doc_id) GROUP BY doc_id),
kept AS (
  SELECT s.doc_id, words, CASE WHEN places IS NULL THEN words ELSE
    list_transform(list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(places, p)), lambda p: words[p]) END AS rest
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(rest) AS BIGINT) AS n_removed,
       sha256(array_to_string(rest, ' ')) AS kept_sha256
FROM kept
"""

OP8_SQL = r"""
WITH records AS (
  SELECT page_id, 'part-' || lpad(CAST(page_id // 2000 AS VARCHAR), 12, '0') AS archive, coalesce(html, '') AS body,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id
    || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: '
    || regexp_replace(coalesce(url, ''), '[\x00-\x20\x7f]', '_', 'g') || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:'
    || sha256(coalesce(html, '')) || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
placed AS (
  SELECT *, octet_length(encode(record)) AS n, row_number() OVER w - 1 AS seq,
         coalesce(sum(octet_length(encode(record))) OVER (PARTITION BY archive ORDER BY page_id, record
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM records WINDOW w AS (PARTITION BY archive ORDER BY page_id, record))
SELECT page_id, archive, CAST(seq AS BIGINT) AS seq, CAST(before AS BIGINT) AS "offset", CAST(n AS BIGINT) AS length,
       sha256(record) AS record_sha256, true AS payload_ok,
       NOT (page_id % 53 = 7 AND contains(body, '<!DOCTYPE')) AS intact
FROM placed
"""

ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op5_quality_rules": OP5_SQL,
    "op8_warc_fixity": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
}
