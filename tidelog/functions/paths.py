"""Paths, scopes and exclusions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directories whose contents are never captured (the last one is this library's own store).
EXCLUDED_DIRS = (".git", "node_modules", "__pycache__", "target", ".cache", ".tidelog")
#: Fixed value: part of the name of a file that is being restored.
TEMPORARY = ".tt_tmp_"
#: Names of files that are never captured. Two that are the tool's own files are left out on purpose.
EXCLUDED_NAMES = (
    "*.o", "*.obj", "*.pyc", "*.pyo", "*.swp", "*.swo", "*~",
    "*.tmp", "*.part", "*.download", "*.ttd",
    ".DS_Store", "Thumbs.db",
    ".goutputstream-*", ".~lock.*", ".#*", "#*#",
    "*.bak", "*.orig", "*.rej", ".nfs*",
)


def in_scope(path: Column, scope: str) -> Column:
    """the path itself, or what lies under it."""
    return (path == scope) | path.startswith(scope + "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def sanitized(name: Column) -> Column:
    """What a name becomes as a directory of an export."""
    out = F.regexp_replace(name, r"[^A-Za-z0-9.\- ]", " ")
    return F.when(F.length(out) == 0, "root").otherwise(out)


def normalized_prefix(prefix: Column) -> Column:
    """Without leading ``/`` and ``./`` and without trailing ``/``."""
    return F.regexp_replace(F.regexp_replace(prefix, r"^(?:\./|/)+", ""), "/+$", "")


def relative(path: Column, scope: str) -> Column:
    """F16: without the scope and the slash after it."""
    return F.when(path == scope, F.lit("")).when(path.startswith(scope + "/"), F.substring(path, len(scope) + 2, 1 << 30)).otherwise(path) if scope else path


def common_directory(paths: Column) -> Column:
    """Of an array of paths."""
    parts = F.transform(paths, lambda p: F.split(dirname(p), "/"))
    first = F.get(parts, 0)
    shared = F.filter(F.sequence(F.lit(1), F.size(first)), lambda n: F.forall(parts, lambda p: F.slice(p, 1, n) == F.slice(first, 1, n)))
    return F.array_join(F.slice(first, 1, F.coalesce(F.array_max(shared), F.lit(0))), "/")


def glob_regex(glob: str, *, hidden: bool = False) -> str:
    """Of the whole name. ``*`` and ``?`` cross slashes; with ``hidden``, a leading full
    stop has to be matched literally."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return "^" + (r"(?!\.)" if hidden and glob[:1] in "*?[" else "") + "(?s:" + out + ")$"


def is_unexpanded_glob(arg: Column) -> Column:
    """X29."""
    return arg.rlike(r"[*?\[]")


def excluded_builtin(path: Column) -> Column:
    """F5-F7."""
    dirs = "|".join(map(re.escape, EXCLUDED_DIRS))
    name = basename(path)
    out = path.rlike(f"(^|/)({dirs})(/|$)") | path.contains(TEMPORARY)
    for glob in EXCLUDED_NAMES:
        out = out | name.rlike(glob_regex(glob, hidden=True))
    return out


def excluded_by(path: Column, pattern: str) -> Column:
    """F8: equal, beneath, a run of components at any depth, or a glob of the path or its last part."""
    inside = F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{pattern}/")
    regex = glob_regex(pattern)
    return (path == pattern) | path.startswith(pattern + "/") | inside | path.rlike(regex) | basename(path).rlike(regex)


def without_excluded(rows: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """Patterns come from a short list of the user's, so they become expressions
    and no join is needed. One that ends with a slash matches nothing."""
    out = F.lit(False)
    for p in patterns:
        if p and not p.endswith("/"):
            out = out | excluded_by(F.col(path), p)
    return rows.where(~(out | excluded_builtin(F.col(path))))
