"""Exclude patterns of a directory scan, as regular expressions and column predicates."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(pattern: str) -> str:
    """Slashes forward, no leading ``./`` or ``/``, a trailing ``/`` meaning everything below."""
    p = pattern.strip().replace("\\", "/")
    p = re.sub(r"^(?:\./|/)+", "", p)
    return p + "**" if p.endswith("/") else p


def to_regex(pattern: str) -> str:
    """``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name; the rest is literal."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def matches(path: str, patterns: list[str]) -> bool:
    """Whether a relative path is excluded; a pattern without ``/`` is held against the file name."""
    path = posixpath.normpath(path.replace("\\", "/"))
    for raw in patterns:
        p = normalise(raw)
        if p and re.match(to_regex(p), path if "/" in p else path.rsplit("/", 1)[-1]):
            return True
    return False


def matches_directory(path: str, patterns: list[str]) -> bool:
    """Whether a folder need not be entered: it matches, or a pattern excludes all below it."""
    path = path.replace("\\", "/")
    for raw in patterns:
        p = normalise(raw)
        if p.endswith("/**") and re.match(to_regex(p[:-3]), path):
            return True
    return matches(path, patterns)


def excluded(path: Column, patterns: list[str]) -> Column:
    """``matches`` as a column predicate."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for raw in patterns:
        p = normalise(raw)
        if p:
            out = out | (path if "/" in p else name).rlike(to_regex(p))
    return out
