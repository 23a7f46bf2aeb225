"""JSON values of any depth: canonical form, bounds, redaction by key, repair.

Depth is what array functions cannot follow, so these are Python in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import SECRET_KEY_PARTS, SECRET_KEYS, SECRETS

# Bounds of tool arguments and of exploration reports.
ARGUMENT_BOUNDS = {"chars": 300, "items": 8, "keys": 12, "depth": 2}
REPORT_BOUNDS = {"chars": 500, "items": 50, "keys": 16, "depth": 3}
SECRET_LENGTH = 8
EXPLORER_CHARS = 12_000


def _parsed(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _dumped(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _mapped(work: Callable, text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else work(t))

    return F.pandas_udf(run, "string")(text)


def canonical(text: Column) -> Column:
    """Keys in order of code points at every depth; broken JSON is null."""

    def work(t: str) -> str | None:
        value = _parsed(t)
        return None if value is None and t.strip() != "null" else json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)

    return _mapped(work, text)


def bound(value, chars: int, items: int, keys: int, depth: int):
    """A value cut to so many characters, items and keys, down to a depth."""
    if isinstance(value, str):
        return value if len(value) <= chars else value[:chars] + "…"
    if depth <= 0 or not isinstance(value, (list, dict)):
        return value
    if isinstance(value, list):
        return [bound(v, chars, items, keys, depth - 1) for v in value[:items]]
    return {k: bound(v, chars, items, keys, depth - 1) for k, v in list(value.items())[:keys]}


def bounded(text: Column, bounds: dict[str, int] = ARGUMENT_BOUNDS) -> Column:
    """P12, P13."""
    return _mapped(lambda t: _dumped(bound(_parsed(t), **bounds)), text)


_PYTHON_SECRETS = [(re.compile(p.replace(r"\z", r"\Z")), r.replace("$1", r"\1").replace("$2", r"\2") if r else f"[REDACTED:{k}]") for k, p, r in SECRETS]


def _scrubbed_text(text: str) -> str:
    for pattern, replacement in _PYTHON_SECRETS:
        text = pattern.sub(replacement, text)
    return text


def _secret_key(key: str) -> bool:
    name = re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key).lower()).strip("_")
    return name in SECRET_KEYS or bool(re.search(f"(?:^|_)(?:{SECRET_KEY_PARTS})(?:_|$)", name))


def scrub_value(value, key: str = ""):
    """Strings redacted at every depth; whole values under keys that bear secrets."""
    if isinstance(value, str):
        if _secret_key(key) and len(value) >= SECRET_LENGTH:
            return "[REDACTED:credential]"
        return _scrubbed_text(value)
    if isinstance(value, list):
        return [scrub_value(v, key) for v in value]
    if isinstance(value, dict):
        return {k: scrub_value(v, k) for k, v in value.items()}
    return value


def scrubbed(text: Column) -> Column:
    """C56, E26 on JSON text."""
    return _mapped(lambda t: _dumped(scrub_value(_parsed(t))), text)


def repair(text: str):
    """The object in a model's answer: fences, prose, comments and trailing commas aside;
    an answer cut off in its list of boundaries keeps those that are whole."""
    body = re.sub(r"\A\s*```[a-zA-Z]*\s*|\s*```\s*\Z", "", text)
    start = body.find("{")
    if start < 0:
        return None
    end = body.rfind("}")
    tries = [body[start : end + 1]] if end > start else []
    tries += [re.sub(r",\s*([}\]])", r"\1", re.sub(r"(?m)^\s*//[^\n]*$|/\*.*?\*/", "", t, flags=re.DOTALL)) for t in tries]
    for t in tries:
        try:
            found = json.loads(t)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    listed = re.search(r'"boundaries"\s*:\s*\[(.*)', body, re.DOTALL)
    whole = [_parsed(m) for m in re.findall(r"\{[^{}]*\}", listed[1])] if listed else []
    whole = [m for m in whole if m is not None]
    return {"boundaries": whole} if whole else None


PRIORITIES, SESSION_TYPES = ("critical", "high", "normal", "low"), ("implementation", "debugging", "review", "discussion")


def coerced(report: dict | None, length: int) -> dict:
    """A report with known enums and boundaries within the conversation, once each."""
    report = report or {}
    kind = report.get("sessionType")
    found: dict[int, dict] = {}
    for item in report.get("boundaries") or []:
        if not isinstance(item, dict) or not isinstance(item.get("afterIndex"), (int, float)) or isinstance(item["afterIndex"], bool):
            continue
        at = max(0, min(int(item["afterIndex"]), max(0, length - 2)))
        priority = item.get("priority")
        found.setdefault(at, {"afterIndex": at, "topic": str(item.get("topic") or ""), "priority": priority if priority in PRIORITIES else "normal"})
    return {"sessionType": kind if kind in SESSION_TYPES else "implementation", "boundaries": [found[k] for k in sorted(found)]}


def report(text: Column, length: Column) -> Column:
    """M26, M27 on columns: the repaired report as JSON."""

    def run(texts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([_dumped(coerced(repair(t or ""), int(n))) for t, n in zip(texts, lengths, strict=True)])

    return F.pandas_udf(run, "string")(text, length)


def head_and_tail(text: Column, most: int = EXPLORER_CHARS) -> Column:
    """A result within the bound: its start and its end."""
    mark = "\n…\n"
    half = (most - len(mark)) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(mark), F.right(text, F.lit(half))))
