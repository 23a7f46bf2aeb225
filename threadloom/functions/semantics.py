"""Whether one text bears out or contradicts another, by stems, polarity and conditions.

Polarity depends on what stands next to what, so this is Python over two string columns in
Arrow batches; the texts are single facts and sections, never conversations.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of negation and condition, verbs that turn polarity round, words
# without weight, and suffixes in the order in which they are tried.
NEGATIONS = frozenset("no not never without avoid forbidden prohibit değil asla olmadan yasak hayır".split())
CONDITIONS = frozenset("only after before with requir until sadece sonra önce gerekli gerektirir".split())
GUARDS = frozenset("skip skipp forget forgett omit omitt neglect fail avoid".split())
WEIGHTLESS = frozenset(
    "the and that this with from into must should only after before without never not does have için ile sonra önce sadece asla değil olmadan".split()
)
SUFFIXES = (
    "ları leri ının inin unun ünün ında inde unda ünde mış miş muş müş lar ler ını ini unu ünü ına ine una üne dan den tan ten "
    "dır dir dur dür tır tir tur tür yor mak mek da de ta te dı di du dü tı ti tu tü ın in un ün sa se"
).split()
ENGLISH = (("ing", 7), ("ed", 6), ("es", 6), ("s", 5))  # (ending, least length of the word)
SHARE = 0.6  # of the concepts that must be met

_TOKEN = re.compile(r"[\w-]+")


def stem(token: str) -> str:
    """C24."""
    word = token.lower()
    for suffix in SUFFIXES:
        if len(word) >= 4 + len(suffix) and word.endswith(suffix):
            return word[: -len(suffix)]
    for ending, least in ENGLISH:
        if len(word) >= least and word.endswith(ending):
            return word[: -len(ending)]
    return word


def tokens(text: str) -> list[str]:
    """C25."""
    found = (stem(t) for t in _TOKEN.findall(unicodedata.normalize("NFKC", text)))
    return [t for t in found if len(t) > 2]


def fragments(text: str) -> tuple[tuple[str, ...], ...]:
    """The stems of each line, and of each clause of it, once."""
    parts: dict[str, None] = {}
    for line in re.split(r"\r?\n", text):
        for part in (line, *re.split("[.;]", line)):
            bare = re.sub(r"^\s*[-*\d.)]+\s*", "", part).strip()
            if bare:
                parts[bare] = None
    return tuple(tuple(tokens(p)) for p in parts)


@dataclass(frozen=True)
class Shape:
    """What a fact says: its concepts, the one that polarity turns on, and its marks."""

    words: tuple[str, ...]
    concepts: tuple[str, ...]
    anchor: str
    negative: bool
    conditional: bool

    @property
    def needed(self) -> int:
        return min(len(self.concepts), max(1, math.ceil(len(self.concepts) * SHARE)))


def _near(words: tuple[str, ...], at: int, reach: int = 2) -> range:
    return range(max(0, at - reach), min(len(words), at + reach + 1))


def shape(text: str) -> Shape:
    words = tuple(tokens(text))
    light = WEIGHTLESS | NEGATIONS | CONDITIONS
    concepts = tuple(dict.fromkeys(w for w in words if not w.isdigit() and w not in light))
    # The first concept with a negation beside it is what the negation is about.
    negated = [c for c in concepts if any(words[j] in NEGATIONS for i, w in enumerate(words) if w == c for j in _near(words, i))]
    anchor = (negated or list(concepts) or [""])[0]
    return Shape(words, concepts, anchor, any(w in NEGATIONS for w in words), any(w in CONDITIONS for w in words))


def negates(words: tuple[str, ...], anchor: str) -> bool:
    """Whether a fragment denies its anchor; "never forget to" asserts it.

    A negation directly before a guard verb cancels it; what else denies still counts.
    """
    for at in (i for i, w in enumerate(words) if w == anchor):
        before = range(max(0, at - 3), at)
        marks = {j for j in _near(words, at) if words[j] in NEGATIONS} | {j for j in before if words[j] in GUARDS}
        pair = next((j for j in before if words[j] in NEGATIONS and j + 1 < at and words[j + 1] in GUARDS), None)
        if pair is None:
            if marks:
                return True
            continue
        inner = any(words[j] in NEGATIONS or words[j] in GUARDS for j in range(pair + 2, at))
        if inner or marks - {pair, pair + 1}:
            return True
    return False


def _restated(fact: Shape, words: tuple[str, ...], met: int) -> bool:
    """ "Not without x" said as "only with x"."""
    return "without" in fact.words and any(w in CONDITIONS for w in words) and met >= min(2, len(fact.concepts))


def _judged(source: str, target: str, known: dict | None = None) -> tuple[bool, bool]:
    """(borne out, contradicted) by any fragment of the target; ``known`` remembers targets."""
    fact = shape(source)
    if not fact.concepts:
        return True, False
    parts = fragments(target) if known is None else known.get(target)
    if parts is None:
        parts = known[target] = fragments(target)
    borne = against = False
    for words in parts:
        have = set(words)
        met = sum(c in have for c in fact.concepts)
        if met < fact.needed:
            continue
        denied = negates(words, fact.anchor)
        if fact.negative and not denied:
            agrees = _restated(fact, words, met)
        elif denied and not fact.negative:
            agrees = False
        else:
            agrees = fact.negative or not fact.conditional or any(w in CONDITIONS for w in words)
        borne = borne or agrees
        against = against or (not agrees and fact.anchor in have)
    return borne, against


def _pairs(source: pd.Series, target: pd.Series) -> pd.DataFrame:
    known: dict = {}
    rows = [_judged(s or "", t or "", known) for s, t in zip(source, target, strict=True)]
    return pd.DataFrame(rows, columns=["evidence", "contradiction"], dtype=bool)


def judged(source: Column, target: Column) -> Column:
    """Struct of evidence and contradiction."""
    return F.pandas_udf(_pairs, "evidence boolean, contradiction boolean")(source, target)


def _stemmed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: tokens(t or ""))


def stems(text: Column) -> Column:
    """C25 as a column."""
    return F.pandas_udf(_stemmed, "array<string>")(text)
