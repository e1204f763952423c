"""Text functions as column expressions: slugs, paths, globs, ids, clipping, versions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Trimmed, lower-cased last path segment with separators as single hyphens."""
    last = F.element_at(F.split(F.lower(F.trim(c)), "/"), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(last, r"[\s_.:]+", "-"), "-+", "-"), F.lit("-"))


def squash(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def html_slug(c: Column, default: str) -> Column:
    """Runs of other characters become one hyphen, none at the ends; ``default`` where nothing is left."""
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.when(s != "", s), F.lit(default))


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by U+241F, nulls as empty."""
    return F.substring(F.sha2(F.concat_ws("␟", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256), 1, 16)


def clip(c: Column, limit: int, tail: str = "…") -> Column:
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(limit - len(tail))), F.lit(tail))).otherwise(s)


def normal_path(c: Column) -> Column:
    """Forward slashes, no drive, no leading ``./`` or ``/``, no empty segments, no trailing slash."""
    p = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "^[A-Za-z]:", "")
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"^(?:\./)+", "")
    return F.trim(F.regexp_replace(p, r"^/(?:\./)*", ""), F.lit("/"))


def glob_regex(glob: str) -> str:
    """An anchored regular expression, valid in Java and RE2, of a path glob: ``*`` and ``?`` stay within a segment, ``**/`` is
    any directories, ``/**`` a directory and all below; a glob without a slash matches a name at any depth."""
    g = re.sub(r"^(?:\./)+", "", glob.replace("\\", "/")).strip("/")
    if g in ("**", ""):
        return "^.*$"
    if "/" not in g:
        g = f"**/{g}"
    out, i = "", 0
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif g[i:] == "/**":
            out, i = out + "(?:/.*)?", len(g)
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := g.find("]", i + 2)) > 0:
            inner = g[i + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out, i = out + "[" + inner.replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def glob_word(glob: str) -> str:
    """The longest text that every path holds which a glob matches; empty where it has none, or classes of characters."""
    return "" if "[" in glob else max(re.split(r"[*?/]+", re.sub(r"^(?:\./)+", "", glob.replace("\\", "/"))), key=len)


def matches(path: Column, glob: str) -> Column:
    """Most paths lack a glob's word, which is told far sooner than by the expression."""
    word, hit = glob_word(glob), path.rlike(glob_regex(glob))
    return path.contains(word) & hit if word else hit


def version_parts(c: Column) -> Column:
    """Numeric parts of a version, four at least; text after the first other character is dropped."""
    core = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)*)", 1)
    parts = F.transform(F.filter(F.split(core, r"\."), lambda x: x != ""), lambda x: x.cast("bigint"))
    return F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(4) - F.size(parts), F.lit(0))))


def version_below(c: Column, floor: Column) -> Column:
    """Whether version ``c`` is below ``floor``; null if either has no number."""
    some = c.rlike("[0-9]") & floor.rlike("[0-9]")
    return F.when(some, version_parts(c) < version_parts(floor))
