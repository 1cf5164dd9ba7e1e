"""Path globs: to regular expressions, to LIKE patterns, and as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clean(glob: str) -> str:
    g = re.sub("/{2,}", "/", glob.strip().replace("\\", "/"))
    if not g:
        raise ValueError("an empty glob matches nothing")
    return g


def glob_body(glob: str) -> str:
    """`**/*` spans folders and names, `**` anything, `*` and `?` stay within a name."""
    out, rest = "", _clean(glob)
    for token, made in re.findall(r"(\*\*/\*|\*\*|\*|\?)|([^*?]+)", rest):
        out += {"**/*": "(?:.*/)*[^/]*", "**": ".*", "*": "[^/]*", "?": "[^/]"}[token] if token else re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", made)
    return out


def globs_regex(globs: list[str]) -> str:
    if not globs:
        raise ValueError("no globs")
    return "^(?:" + "|".join(glob_body(g) for g in globs) + ")$"


def glob_like(glob: str) -> str:
    """LIKE pattern, with a backslash as its escape character."""
    return re.sub(r"\*+", "%", re.sub(r"([%_\\])", r"\\\1", _clean(glob))).replace("?", "_")


def path_matches(path: Column, globs: list[str]) -> Column:
    """Any-of, whatever the case, with either slash."""
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike("(?i)" + globs_regex(globs))


def under_folder(path: Column, folders: list[str]) -> Column:
    """In one of the folders; an empty name means all."""
    hit = F.lit(not folders)
    for f in folders:
        f = f.strip("/")
        hit = hit | (F.lit(True) if not f else (path == f) | path.startswith(f + "/"))
    return hit


def excluded(path: Column, folders: list[str]) -> Column:
    hit = F.lit(False)
    for f in (x.strip("/") for x in folders):
        if f:
            hit = hit | (path == f) | path.startswith(f + "/")
    return hit
