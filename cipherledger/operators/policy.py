"""Policy rules over paths: data class, criticality, protection and migration years, the worst place of an asset."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X


def last_match(path: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """The value of the last rule whose glob matches. The driver knows the rules, so they are one CASE from the last to the
    first: no join, no aggregate, and evaluation stops at the first hit."""
    out = F
    for glob, value in reversed(rules):
        if X.glob_regex(glob) == "^.*$":
            return out.otherwise(value) if out is not F else F.lit(value)
        out = out.when(X.matches(path, glob), value)
    return out.otherwise(default)


def _shell(glob: str) -> str:
    """A whole-path regular expression of a shell pattern, whose ``*`` and ``?`` also take slashes."""
    i, out = 0, ""
    while i < len(glob):
        c, i = glob[i], i + 1
        end = glob.find("]", i + 1) if c == "[" else -1
        if c == "[" and end > 0:
            inner = glob[i:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
    return f"(?s)^{out}$"


def most_specific(path: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """The value of the longest glob that matches, of equals the one with fewer stars, then the first. A path also counts as
    its bare name and with a slash before it, and ``**/`` also as ``*``. The driver sorts the rules, so they are one CASE."""
    names = [path, F.ltrim(path, F.lit("./")), F.element_at(F.split(path, "/"), -1), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))]
    out = F
    for glob, value in sorted(rules, key=lambda r: (-len(r[0]), r[0].count("*"))):
        forms = dict.fromkeys(_shell(g) for g in (glob, glob.replace("**/", "*").replace("/**", "/*")))
        hit = F.lit(False)
        for f in forms:
            for n in names:
                hit = hit | n.rlike(f)
        out = out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default)) if out is not F else F.lit(default)


def matched_rules(path: Column, globs: list[str]) -> Column:
    """The globs of the rules that match a path, in their order: where its class and weight come from."""
    return F.array_compact(F.array(*(F.when(X.matches(path, g), F.lit(g)) for g in globs)))


def kept(paths: DataFrame, ignore: list[str], path: str = "file") -> DataFrame:
    """``paths`` without those that an ignore glob names."""
    return paths.where(~ignored(F.col(path), ignore)) if ignore else paths


def lookup(c: Column, table: dict, default) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, v)
    return out.otherwise(default)


def placed(paths: DataFrame, path: str = "file", classes=None, criticality=None, years=None, default: int = 10) -> DataFrame:
    """``paths`` with ``data_class, x_years, weight``."""
    p = F.col(path)
    c = last_match(p, classes or T.CLASS_RULES, "default")
    return paths.withColumn("data_class", c).withColumn("x_years", lookup(F.col("data_class"), years or T.CLASS_YEARS, default).cast("int")).withColumn("weight", last_match(p, criticality or T.CRITICALITY_RULES, 0.3).cast("double"))


def migration_years(family: Column, table: dict | None = None, default: int = T.DEFAULT_YEARS) -> Column:
    return lookup(F.upper(family), {k.upper(): v for k, v in (table or T.FAMILY_YEARS).items()}, default).cast("int")


def worst(places: DataFrame, by: list[str]) -> DataFrame:
    """The place of each asset with the longest protection, then the highest weight, then the first in order."""
    w = F.min(F.struct((-F.col("x_years")).alias("nx"), (-F.col("weight")).alias("nw"), "file", "line", "data_class", "x_years", "weight"))
    return places.groupBy(*by).agg(w.alias("w"), F.count("*").alias("n_occ"), F.countDistinct("file").alias("n_files")).select(*by, "n_occ", "n_files", F.col("w.file").alias("file"), F.col("w.line").alias("line"), "w.data_class", "w.x_years", "w.weight")


def ignored(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | X.matches(path, g) | X.matches(path, g.rstrip("/") + "/**")
    return out
