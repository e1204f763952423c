"""The flat scanner: lines against a rule table, tiers, urgency by path, top findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables as T


#: All whole words and all parts of words, each as one pattern whose bounds take no characters.
WORDS = "(?<![a-z0-9_])(?:" + "|".join(w for w, _ in T.FLAT_WORDS.values()) + ")(?![a-z0-9_])"
PARTS = "|".join(p for _, p in T.FLAT_WORDS.values() if p)
HINT = f"{WORDS}|{PARTS}"


def mentioning(files: DataFrame) -> DataFrame:
    """The files whose text holds a match, before they are split into lines."""
    return files.where(F.lower("text").rlike(HINT))


def findings(lines: DataFrame) -> DataFrame:
    """``path, line, rule, algorithm, tier, recommendation, confidence``: one row for each rule that a line matches. A line is
    read by one pattern that decides for most, then by one for words and one for parts of words; the rules look at what these found, not
    at the line. No join is planned."""
    lines = lines.withColumn("low", F.lower("text")).where(F.col("low").rlike(HINT))
    found = lines.select("path", "line", "text", *(F.array_distinct(F.regexp_extract_all("low", F.lit(p), F.lit(0))).alias(n) for n, p in (("words", WORDS), ("parts", PARTS))))
    some = lambda c, p: F.exists(c, lambda w: w.rlike(f"^(?:{p})$")) if p else F.lit(False)
    told = {r: F.struct(F.lit(r).alias("rule"), F.lit(a).alias("algorithm"), F.lit(t).alias("tier"), F.lit(c).alias("recommendation")) for r, _, a, t, c in T.FLAT_RULES}
    rules = F.array(*[F.when(some("words", w) | some("parts", p), told[r]) for r, (w, p) in T.FLAT_WORDS.items()])
    hit = found.select("path", "line", "text", F.explode(F.array_compact(rules)).alias("r"))
    comment = F.col("text").rlike(r"^\s*(?:#|//|\*|/\*)")
    api = F.col("text").rlike(r"[.(\[]|import |require\(|new [A-Z]|=\s*\w")
    return hit.select("path", "line", "r.*", F.when(comment, "low").when(api, "high").otherwise("low").alias("confidence"))


def horizon(path: Column) -> Column:
    """Years that the data behind a path must stay secret."""
    p = F.lower(path)
    return F.when(p.rlike("auth|identity|session|key|secret|login|token"), 25).when(p.rlike("payment|bank|pii|user"), 10).otherwise(5)


def judged(found: DataFrame, y: int = 3, z: int = 10) -> DataFrame:
    x = horizon(F.col("path"))
    late = (x + y) > z
    return found.withColumn("mosca_x", x).withColumn("urgent", late & F.col("tier").isin("BROKEN_Q", "WEAK") & (F.col("confidence") == "high"))


def distinct_mentions(found: DataFrame) -> DataFrame:
    return found.dropDuplicates(["path", "line", "algorithm"])


def tier_counts(found: DataFrame) -> DataFrame:
    return distinct_mentions(found).groupBy("algorithm", "tier").agg(F.count("*").alias("n"), F.count_if("urgent").alias("n_urgent"), F.countDistinct("path").alias("n_files"))


def top(found: DataFrame, n: int = 80) -> DataFrame:
    """The first findings of the dashboard: tiers in order, urgent ones first, then by place."""
    order = F.array_position(F.array(*map(F.lit, T.TIERS)), F.col("tier"))
    return distinct_mentions(found).orderBy(order, F.desc("urgent"), "path", "line", "algorithm").limit(n)


def command_line(found: DataFrame, n: int = 12) -> DataFrame:
    """What the command line shows: matches of high confidence, broken ones first, urgent ones first, then by place."""
    order = F.array_position(F.array(*map(F.lit, T.TIERS)), F.col("tier"))
    return found.where("confidence = 'high'").orderBy(order, F.desc("urgent"), "path", "line", "rule").limit(n)


def components(found: DataFrame) -> DataFrame:
    """Distinct assets of the flat bill of materials, low confidence left out."""
    return found.where("confidence <> 'low'").select("algorithm", "tier", "recommendation").distinct()
