"""Tool calls: what an operation does, told from its arguments and name; its identity.

Arguments are JSON text, parsed once into a struct of the keys that count (:func:`parsed`);
the functions take that struct. Names only settle what the arguments leave open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Argument keys and name words, in the order in which they count.
PATH_KEYS = ("path", "file_path", "filePath", "filename", "file", "target_file", "file_uri", "absolute_path")
PAYLOAD_KEYS = (
    "content", "newText", "oldText", "new_str", "old_str", "new_string", "old_string", "edits", "patch", "replacement",
)
COMMAND_KEYS = ("command", "cmd", "script")
QUERY_KEYS = ("pattern", "query", "glob")
WRITE_WORDS = ("write", "edit", "patch", "replace", "append", "create", "update", "insert")
DELETE_WORDS = ("delete", "remove", "unlink")
SEARCH_WORDS = ("grep", "search", "find", "glob", "rg")
LIST_WORDS = ("list", "ls", "tree")
RETRY_FLAGS = r"(?i)\A--?(?:retry|force|runInBand|no-cache|verbose|silent)(?:=|\z)"
ACCESSES = ("read", "search", "list")
NO_OP = r"(?i)applied:\s*0|no changes applied|nothing to (?:do|change)|0 edits? applied"
TRUNCATED = r"…✂\d+\z"
LIKELY_ERROR = (
    r"(?i)(?:command not found|no such file|permission denied|syntax error|cannot find|module not found|compilation error|"
    r"build failed|test failed|^FAIL\b|ERROR:)"
)
FIRST_LINE_ERROR = r"(?i)\A(?:npm\s+error|fatal:|traceback\b)"
EVIDENCE = (
    r"(?im)(?:command not found|no such file|permission denied|syntax error|cannot find|module not found|compilation error|"
    r"build failed|test failed|^FAIL\b|ERROR:|FATAL\b|Traceback\b|(?:failed|failure)\b)"
)


ARGUMENTS = ", ".join(f"{k} string" for k in (*PATH_KEYS, *PAYLOAD_KEYS, *COMMAND_KEYS, *QUERY_KEYS, "text", "question", "prompt"))


def parsed(args: Column) -> Column:
    """The arguments that count, as text; broken JSON has none."""
    return F.from_json(args, ARGUMENTS)


def _get(args: Column, key: str) -> Column:
    return args[key]


def present(args: Column, keys: tuple[str, ...]) -> Column:
    """Whether any key has a value; an empty one counts."""
    return F.coalesce(*[_get(args, k) for k in keys]).isNotNull()


def first_text(args: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[_get(args, k) for k in keys])


def tool_path(args: Column) -> Column:
    """The first non-empty path argument."""
    return F.coalesce(*[F.nullif(_get(args, k), F.lit("")) for k in PATH_KEYS])


def tool_name(name: Column) -> Column:
    """Snake case without the provider's wrapper."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\Afunctions[.:/_-]+", "")
    spaced = F.lower(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(F.regexp_replace(spaced, "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")


def name_has(name: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is a part of the normalised name."""
    return F.arrays_overlap(F.split(name, "_"), F.array(*map(F.lit, words)))


def operation(args: Column, name: Column) -> Column:
    """mutate, execute, delete, search, list, read or unknown."""
    said, has_path = tool_name(name), tool_path(args).isNotNull()
    return (
        F.when(has_path & present(args, PAYLOAD_KEYS), "mutate")
        .when(present(args, COMMAND_KEYS), "execute")
        .when(has_path & present(args, ("text",)) & name_has(said, WRITE_WORDS), "mutate")
        .when(has_path & name_has(said, DELETE_WORDS), "delete")
        .when(present(args, QUERY_KEYS) | name_has(said, SEARCH_WORDS), "search")
        .when(name_has(said, LIST_WORDS), "list")
        .when(has_path | name_has(said, ("read",)), "read")
        .otherwise("unknown")
    )


def broad_class(args: Column) -> Column:
    """the class that arguments alone tell."""
    has_path = tool_path(args).isNotNull()
    return (
        F.when(has_path & present(args, PAYLOAD_KEYS), "mutates")
        .when(present(args, COMMAND_KEYS), "executes")
        .when(has_path, "accesses")
        .otherwise("other")
    )


def command_identity(args: Column) -> Column:
    """The command without flags that only say how to run it."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(first_text(args, COMMAND_KEYS), F.lit("")), r"\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "--") & ~w.rlike(RETRY_FLAGS)), " ")


def signature(args: Column, text: Column, name: Column, does: Column) -> Column:
    """Equal for two calls of which the later can be a retry of the earlier.

    Calls with neither command, path nor query are told apart by their flat arguments
    (``text`` is their JSON) in order of key.
    """
    path = F.regexp_replace(tool_path(args), r"\\", "/")
    flat = F.array_sort(F.map_entries(F.from_json(text, "map<string,string>")))
    rest = F.array_join(F.transform(flat, lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    target = (
        F.when(does == "execute", command_identity(args))
        .when(path.isNotNull(), path)
        .when(does == "search", F.coalesce(first_text(args, QUERY_KEYS), F.lit("")))
        .otherwise(F.coalesce(rest, F.lit("")))
    )
    return F.concat_ws("\u0000", does, tool_name(name), target)


def truncated(text: Column) -> Column:
    """F3."""
    return text.rlike(TRUNCATED)


def no_op(text: Column) -> Column:
    """A result that says that nothing was changed; a truncated one may hide a change."""
    return ~truncated(text) & text.rlike(NO_OP)


def command_failed(text: Column) -> Column:
    """a non-zero exit at the end, or a first line that looks like an error."""
    first = F.trim(F.get(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(0)))
    return F.coalesce(
        text.rlike(r"(?i)Command exited with code [1-9]\d*\s*\z") | first.rlike(LIKELY_ERROR) | first.rlike(FIRST_LINE_ERROR), F.lit(False)
    )


def benign_search(args: Column, result: Column) -> Column:
    """a chain of searches that found nothing, or something."""
    command = F.coalesce(_get(args, "command"), _get(args, "cmd"), F.lit(""))
    parts = F.filter(F.transform(F.split(command, "&&"), lambda p: F.trim(p)), lambda p: p != "")
    only = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"\A(?:rg|grep)\b")) & ~command.rlike(r"[;\n]|\|\|")
    code = F.nullif(F.regexp_extract(result, r"(?i)Command exited with code (\d+)\s*\z", 1), F.lit(""))
    return only & ~result.rlike(r"(?:^|\n)(?:rg|grep):") & (code.isNull() | (code == "1"))


def transient(text: Column) -> Column:
    """diagnostics that say nothing about the work."""
    t = F.trim(text)
    return (
        t.rlike(r"(?i)\bBrave Search API error\s*\(429\)")
        | (t.rlike(r"(?i)\bnpm error code ENOLOCK\b") & t.rlike("(?i)(?:audit|existing lockfile|loadVirtual)"))
        | t.rlike(r"(?i)\AFound \d+ occurrences? of edits\[\d+\](?![A-Za-z0-9_])")
        | (t.rlike(r"(?i)\AUnknown JSON field:") & t.rlike("(?i)Available fields:"))
    )


def failure_evidence(text: Column, most: int) -> Column:
    """A long failure as the part around its first cue and its end."""
    head, tail = max(1, int(most * 0.7)), max(0, most - max(1, int(most * 0.7)))
    at = F.regexp_instr(text, F.lit(EVIDENCE))
    anchor = F.when(at > 0, at - 1).otherwise(F.greatest(F.lit(0), F.length(text) - head))
    part = F.substring(text, F.greatest(F.lit(0), anchor - head // 4) + 1, F.lit(head))
    end = F.right(text, F.lit(tail))
    both = F.when(part.endswith(end), part).otherwise(F.concat(part, F.lit("\n...\n"), end))
    return F.when(F.length(text) <= most, text).otherwise(both)
