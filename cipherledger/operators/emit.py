"""Sinks: CycloneDX components, SARIF results and rules, summaries, the Markdown report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# SARIF levels and security severities, dashboard tiers, primitives by category.
LEVELS = {"critical": ("error", "9.5"), "high": ("error", "8.0"), "medium": ("warning", "5.5"), "low": ("note", "3.0"), "none": ("none", "0.0")}
TIER_OF = {"shor_broken": "BROKEN_Q", "legacy_broken": "WEAK", "grover_weakened": "SAFE", "quantum_safe": "SAFE", "unknown": "SAFE", "pqc": "PQC"}
PRIMITIVES = {"hash": "hash", "symmetric": "block-cipher", "mac": "mac", "kdf": "kdf", "asymmetric": "pke", "prng": "drbg", "protocol": "other"}
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cplusplus"}


def _pick(c, table: dict, default, at=lambda v: v):
    out = F
    for k, v in table.items():
        out = out.when(c == k, at(v))
    return out.otherwise(default)


def cbom_components(assets: DataFrame) -> DataFrame:
    """``asset_key, bom_ref, component``: a CycloneDX 1.6 cryptographic asset as JSON each; empty properties are left out."""
    ref = F.concat(F.lit("crypto/"), X.html_slug(F.col("name"), "asset"), F.lit("/"), X.stable_id(F.col("asset_key")))
    pair = lambda n, v: F.when(v.isNotNull() & (v != ""), F.struct(F.lit(f"crypto:{n}").alias("name"), v.alias("value")))
    props = F.array_compact(F.array(*[pair(n, F.col(n).cast("string")) for n in ("threat", "severity", "score", "act_now", "shortfall", "deadline_year", "data_class", "rule_id")]))
    algo = F.struct(_pick(F.col("category"), PRIMITIVES, "unknown").alias("primitive"), F.col("key_size").cast("string").alias("parameterSetIdentifier"), F.lower("mode").alias("mode"))
    places = F.transform(F.filter("occurrences", lambda o: o["line"] > 0), lambda o: F.struct(o["file"].alias("location"), o["line"].alias("line")))
    body = F.struct(F.lit("cryptographic-asset").alias("type"), ref.alias("bom-ref"), F.col("name"), F.struct(F.lit("algorithm").alias("assetType"), algo.alias("algorithmProperties")).alias("cryptoProperties"), props.alias("properties"), F.struct(places.alias("occurrences")).alias("evidence"))
    return assets.select("asset_key", ref.alias("bom_ref"), F.to_json(body).alias("component"))


def cbom(assets: DataFrame, target: str, version: str = "0.1.0") -> str:
    """The whole CycloneDX document; components in risk order. For documents of a report's size."""
    rows = cbom_components(assets).join(assets.select("asset_key", "severity_rank", "score"), "asset_key").orderBy(F.desc("severity_rank"), F.desc("score"), "bom_ref").toLocalIterator()
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.6", "version": 1, "metadata": {"tools": [{"name": "cipherledger", "version": version}], "component": {"type": "application", "name": target}}, "components": [json.loads(r.component) for r in rows]}, indent=2)


def sarif_results(assets: DataFrame, places: DataFrame) -> DataFrame:
    """One row an occurrence: rule, level, place and a fingerprint that survives moved lines of other findings."""
    o = places.select("asset_key", "file", "line").join(assets.select("asset_key", "family", "severity"), "asset_key")
    return o.select(F.concat(F.lit("crypto/"), X.html_slug(F.col("family"), "unknown")).alias("rule"), _pick(F.col("severity"), LEVELS, "note", lambda v: v[0]).alias("level"), F.col("file").alias("uri"), F.greatest("line", F.lit(1)).alias("start_line"), X.stable_id(F.col("asset_key"), F.col("file"), F.col("line")).alias("fingerprint"))


def sarif_rules(assets: DataFrame) -> DataFrame:
    """One row a family; its worst member decides the level."""
    worst = F.max(F.struct("severity_rank", "score", "severity"))
    g = assets.groupBy("family").agg(worst.alias("w"), F.count("*").alias("n_assets"), F.sum("n_occ").alias("n_results"))
    return g.select("family", F.concat(F.lit("crypto/"), X.html_slug(F.col("family"), "unknown")).alias("rule"), _pick(F.col("w.severity"), LEVELS, "note", lambda v: v[0]).alias("level"), _pick(F.col("w.severity"), LEVELS, "3.0", lambda v: v[1]).alias("security_severity"), "n_assets", "n_results")


ADVICE, REASONS = 8, 5


def sarif_help(assets: DataFrame) -> DataFrame:
    """``family, recommendations, rationales`` of each family's rule: the first different ones in the order of its assets, worst first.
    An asset's text counts once, at its best place, so a family brings no more rows together than it has different texts, and of
    these only the first are kept before they become an array."""
    order = F.struct((-F.col("severity_rank")).alias("s"), (-F.col("score")).alias("p"), F.col("name"), F.col("asset_key"))

    def listed(text: str, n: int, name: str) -> DataFrame:
        some = assets.where(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy("family", F.trim(text).alias("t")).agg(F.min(order).alias("o"))
        first = some.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy("o"))).where(F.col("r") <= n)
        rows = first.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("r", "t"))).alias("x"))
        return rows.select("family", F.col("x.t").alias(name))

    every = assets.select("family").distinct()
    out = every.join(listed("recommendation", ADVICE, "recommendations"), "family", "left").join(listed("rationale", REASONS, "rationales"), "family", "left")
    none = F.array().cast("array<string>")
    return out.select("family", F.coalesce("recommendations", none).alias("recommendations"), F.coalesce("rationales", none).alias("rationales"))


def sarif_artifacts(assets: DataFrame, places: DataFrame) -> DataFrame:
    f = places.join(assets.select("asset_key"), "asset_key", "left_semi").select(F.col("file").alias("uri")).distinct()
    return f.withColumn("language", _pick(F.lower(F.regexp_extract("uri", r"\.([A-Za-z]+)$", 1)), LANGUAGES, None))


def sarif(assets: DataFrame, places: DataFrame) -> str:
    """The SARIF 2.1.0 log."""
    rules = [{"id": r.rule, "properties": {"security-severity": r.security_severity}, "defaultConfiguration": {"level": r.level}} for r in sarif_rules(assets).orderBy("rule").collect()]
    at = {r["id"]: i for i, r in enumerate(rules)}
    results = [{"ruleId": r.rule, "ruleIndex": at[r.rule], "level": r.level, "message": {"text": r.rule}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.uri}, "region": {"startLine": r.start_line}}}], "partialFingerprints": {"asset/v1": r.fingerprint}} for r in sarif_results(assets, places).orderBy("rule", "uri", "start_line").toLocalIterator()]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "cipherledger", "rules": rules}}, "results": results}]}, indent=2)


def tiers(assets: DataFrame) -> DataFrame:
    """The dashboard's counts by tier, of occurrences."""
    t = _pick(F.col("threat"), TIER_OF, "SAFE")
    n = assets.groupBy(t.alias("tier")).agg(F.sum("n_occ").alias("n"), F.sum(F.when(F.col("act_now"), F.col("n_occ")).otherwise(0)).alias("n_urgent"))
    total = F.sum("n").over(Window.partitionBy())  # four rows
    return n.withColumn("pct", F.round(100 * F.col("n") / total, 1))


def report(assets: DataFrame, target: str, errors: list[str] = (), top: int = 20) -> str:
    """The Markdown report: verdict, counts, the first assets, errors (50 at most)."""
    from . import risk

    s = risk.summary(assets).first()
    counts = risk.severity_counts(assets).orderBy(F.desc("severity_rank")).collect()
    rows = assets.orderBy(F.desc("severity_rank"), F.desc("score"), "name").limit(top).collect()
    cell = lambda x: str(x if x is not None else "-").replace("|", "\\|").replace("\n", " ")
    out = [f"# Cryptographic inventory of {target}", "", f"{s.n_assets} assets, {s.n_vulnerable} vulnerable, {s.n_act_now} overdue; highest score {s.max_score}.", "", "| severity | assets |", "|---|---|"]
    out += [f"| {c.severity} | {c.n} |" for c in counts]
    out += ["", "| # | asset | severity | score | occurrences | first seen | advice |", "|---|---|---|---|---|---|---|"]
    out += [f"| {i} | {cell(r.name)} | {r.severity} | {r.score} | {r.n_occ} | {cell(r.file)}:{r.line} | {cell(r.recommendation)} |" for i, r in enumerate(rows, 1)]
    if errors:
        out += ["", "## Errors", "", *(f"- {cell(e)}" for e in list(errors)[:50])]
    return "\n".join(out) + "\n"
