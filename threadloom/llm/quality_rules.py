"""Quality rules: a threshold table compiled into one Spark projection (no user functions)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, documents

# Characters that count as symbols, and common words of four languages.
SYMBOLS = r"[#*$%&|<>]"
STOP_WORDS = (
    "the and of to in is that it for was with as on be at by this are from or an not "
    "der die das und ist nicht mit ein eine zu den von im auf für sich dem des "
    "le la les et de des un une du est que en pour dans au par sur "
    "el los las y que un una del se con por para su al es"
).split()
STOP = "|".join(sorted(set(STOP_WORDS)))


@dataclass(frozen=True)
class Threshold:
    """A document fails where ``value`` (SQL over the measures) is below ``least`` or above ``most``."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None


#: The method's table. Each ratio is over words, characters in words, or lines.
THRESHOLDS = (
    Threshold("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    Threshold("longest_word", "longest_word", most=1000.0),
    Threshold("symbols_per_word", "n_symbols / n_words", most=0.3),
    Threshold("upper_share", "n_upper / word_chars", most=0.5),
    Threshold("exclamations_per_word", "n_exclaim / n_words", most=0.4),
    Threshold("stop_word_share", "n_stop / n_words", least=0.005),
    Threshold("duplicate_line_share", "n_dup_lines / greatest(n_lines, 1)", most=0.5),
    Threshold("repeated_word_share", "n_repeat_words / n_words", most=0.2),
)


def compiled(thresholds: tuple[Threshold, ...]) -> Column:
    """One boolean column from the table: true where no threshold is broken."""
    passed = F.lit(True)
    for t in thresholds:
        value = F.expr(t.value)
        if t.least is not None:
            passed = passed & (value >= t.least)
        if t.most is not None:
            passed = passed & (value <= t.most)
    return passed


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    thresholds: tuple[Threshold, ...] = THRESHOLDS,
) -> DataFrame:
    """One row per input row with its measures, base_failed, kept.

    A window of five words is compared by hash first; only in the texts where two hashes
    agree are the windows' own words compared, so the count is exact.

    Defined cases: null or empty text has no words, counts zero everywhere and fails the
    base rule. Repeated rows are judged each by itself. Any doc_id, null too, passes
    through. An empty table gives no rows. Other columns are ignored.
    """
    k = 5
    at = ", ".join(f"words[i + {j}]" if j else "words[i]" for j in range(k))
    measured = (
        documents(docs, id_col, text_col)
        .withColumn("words", F.expr(rf"filter(split(text, '[{SPACE}]+'), w -> w <> '')".replace("\\", "\\\\")))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("hashes", F.expr(f"if(n_words < {k}, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - {k}), i -> xxhash64({at})))"))
        .withColumn("repeats", F.expr("size(array_distinct(hashes)) < size(hashes)"))
        .withColumn("lines", F.expr(rf"filter(split(text, '\n'), l -> l rlike '[^{SPACE}]')".replace("\\", "\\\\")))
        .select(
            "doc_id",
            "n_words",
            F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
            F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("repeats"), _covered(k)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaim"),
            F.regexp_count(F.lower("text"), F.lit(rf"(?<![^{SPACE}])(?:{STOP})[.,;:!?]*+(?![^{SPACE}])")).cast("long").alias("n_stop"),
            F.expr("coalesce(array_max(transform(words, w -> length(w))), 0)").cast("long").alias("longest_word"),
        )
    )
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(compiled(thresholds))
    )


def _covered(k: int) -> Column:
    """Words of ``words`` in windows of k whose words occur twice or more in the text."""
    # Starts whose hash is not alone, then among these the starts whose words are not alone.
    by_hash = "array_sort(transform(hashes, (h, i) -> struct(h AS h, i AS i)))"
    suspects = (
        f"transform(array({by_hash}), s -> filter(s, (x, i) -> (i + 1 < size(s) AND get(s, i + 1).h = x.h)"
        " OR (i > 0 AND get(s, i - 1).h = x.h)))[0]"
    )
    texts = f"array_sort(transform({suspects}, x -> struct(array_join(slice(words, x.i + 1, {k}), ' ') AS t, x.i AS i)))"
    starts = (
        f"transform(array({texts}), s -> array_sort(transform(filter(s, (x, i) -> (i + 1 < size(s) AND get(s, i + 1).t = x.t)"
        " OR (i > 0 AND get(s, i - 1).t = x.t)), x -> x.i)))[0]"
    )
    covered = f"aggregate({starts}, struct(0 AS n, -{k} AS last), (a, i) -> struct(a.n + least({k}, i - a.last) AS n, i AS last), a -> a.n)"
    return F.expr(covered)
