"""Files that a shell command writes or removes, where the command names them literally.

Quoting makes the command's words a matter of state from character to character, so this
is Python, in Arrow batches, and only for commands.
"""

from __future__ import annotations

import re
import shlex
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What commands do to their operands.
WRAPPERS = frozenset({"env", "sudo", "command", "nohup"})
REMOVE, WRITE, WRITE_LAST = {"rm", "unlink"}, {"touch", "tee"}, {"cp", "install"}
_ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")
_NOT_LITERAL = re.compile(r"[\x00$*?\[\]{}()<>|;&]|\A\d+\Z|\A-|\A/dev/null\Z|\A\Z")


def words(command: str) -> list[str]:
    """Words, and runs of ``;``, ``|``, ``&``, ``>`` and line ends as words of their own.

    A command whose quotes do not close has no words.
    """
    lexer = shlex.shlex(command, posix=True, punctuation_chars=";|&>\n")
    lexer.whitespace, lexer.whitespace_split, lexer.commenters = " \t\r", True, ""
    try:
        return list(lexer)
    except ValueError:
        return []


def _simple(command: list[str]) -> list[tuple[str, str]]:
    """(path, op) of one simple command."""
    rest = command
    while rest and _ASSIGNMENT.match(rest[0]):
        rest = rest[1:]
    while rest and rest[0].rsplit("/", 1)[-1].lower() in WRAPPERS:
        rest = rest[1:]
        while rest and rest[0].startswith("-"):
            rest = rest[1:]
    if not rest:
        return []
    name, tail = rest[0].rsplit("/", 1)[-1].lower(), rest[1:]
    marker = tail.index("--") if "--" in tail else len(tail)
    options = [w for w in tail[:marker] if w.startswith("-")]
    operands = [w for w in tail[:marker] if not w.startswith("-")] + tail[marker + 1 :]
    paths = [w for w in operands if not _NOT_LITERAL.search(w)]
    if not paths:
        return []
    if name in REMOVE:
        return [(p, "delete") for p in paths]
    if name in WRITE:
        return [(p, "mutate") for p in paths]
    if name in WRITE_LAST or name == "sed" and any(o.startswith(("-i", "--in-place")) for o in options):
        return [(paths[-1], "mutate")]
    if name == "mv":
        return [(p, "delete") for p in paths[:-1]] + [(paths[-1], "mutate")]
    return []


def operations(command: str) -> list[tuple[str, str]]:
    """(path, op) of a command line, each once; a path that is written is not removed."""
    found: list[tuple[str, str]] = []
    for separator, group in groupby(words(command), lambda w: bool(re.fullmatch(r"[;|\n]+|&&[\n]*", w))):
        if separator:
            continue
        simple, parts = [], list(group)
        while parts:
            word = parts.pop(0)
            if word in (">", ">>") and parts:
                target = parts.pop(0)
                if not _NOT_LITERAL.search(target):
                    found.append((target, "mutate"))
            elif not word.startswith(">"):
                simple.append(word)
        found += _simple(simple)
    written = {p for p, op in found if op == "mutate"}
    return list(dict.fromkeys((p, op) for p, op in found if op == "mutate" or p not in written))


def _operations_of(commands: pd.Series) -> pd.Series:
    return commands.map(lambda c: [{"path": p, "op": op} for p, op in operations(c)] if c else [])


def file_operations(command: Column) -> Column:
    """C11–C14: the files that a command writes (mutate) or removes (delete)."""
    return F.pandas_udf(_operations_of, "array<struct<path:string,op:string>>")(command)
