"""The whole inventory as one plan: findings to distinct, classified, placed, scored and advised assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables as T
from ..operators import classify, merge, policy, recommend, risk, usage
from .policy_file import Policy

KEYS = ["family", "name", "kind", "key_size", "curve", "mode", "padding"]


def completed(found: DataFrame) -> DataFrame:
    """Findings with every column of the identity; curve spelling is lower-cased so that detectors agree."""
    have = set(found.columns)
    types = {"key_size": "int"}
    out = found
    for c in KEYS:
        if c not in have:
            out = out.withColumn(c, F.col("family") if c == "name" else F.lit("algorithm") if c == "kind" else F.lit(None).cast(types.get(c, "string")))
    return out.withColumn("curve", F.lower("curve"))


def identity():
    return F.concat_ws("|", merge.key(F.col("family"), F.col("key_size"), F.col("curve"), F.col("mode")), "name", "kind")


def own(found: DataFrame) -> DataFrame:
    """Findings with every column of the identity, vendored files left out, missing digest sizes read from the names."""
    mine = completed(found).where(~merge.vendored(F.col("file"), T.IGNORED_DIRS))
    return mine.withColumn("key_size", merge.inferred_size(F.col("family"), F.col("name"), F.col("key_size")).cast("int"))


def compatible(found: DataFrame) -> DataFrame:
    """Findings under the asset that each is of: those with fewer parameters join the more specific ones they don't contradict."""
    return merge.compatible(own(found))


def places(found: DataFrame) -> DataFrame:
    """One row an asset and place."""
    return merge.occurrences(own(found), KEYS).withColumn("asset_key", identity())


def facts(found: DataFrame) -> DataFrame:
    """``asset_key, extra, alg, groups, iterations`` of findings with an ``extra`` map: every value that was seen, and what verdicts read:
    the algorithm if there is but one, all groups, the least iterations."""
    e = merge.extras(own(found).withColumn("asset_key", identity()))
    x = F.col("extra")
    one = lambda k: F.when(F.size(x[k]) == 1, F.get(x[k], F.lit(0)))
    groups = F.concat_ws(" ", *(F.array_join(x[k], " ") for k in ("groups", "group", "kex", "ciphersuite")))
    return e.select("asset_key", "extra", F.coalesce(one("alg"), one("algorithm")).alias("alg"), groups.alias("groups"), F.array_min(F.transform(x["iterations"], lambda v: F.try_to_number(v, F.lit("999999999")).cast("int"))).alias("iterations"))


def assets(found: DataFrame, now: int = risk.NOW, z: int | None = None, rules: Policy | None = None) -> DataFrame:
    """Distinct assets with counts, verdict, worst place, Mosca years, score, severity and advice. The findings are shuffled
    once, by identity and place; an asset's state is a few numbers and its worst place, however often it occurs. Its
    places stay a table of their own (``places``), joined by ``asset_key``."""
    rules = rules or Policy()
    at = policy.placed(places(found), classes=rules.class_rules, criticality=rules.criticality_rules, years=rules.classes, default=rules.default_x)
    by = [*KEYS, "asset_key"]
    w = F.min(F.struct((-F.col("x_years")).alias("nx"), (-F.col("weight")).alias("nw"), "file", "line", "data_class", "x_years", "weight")).alias("w")
    g = at.groupBy(*by).agg(w, F.count("*").alias("n_occ"), F.countDistinct("file").alias("n_files"), F.max(merge.confidence_rank(F.col("confidence"))).alias("best_confidence"))
    if "extra" in found.columns:
        g = g.join(facts(found), "asset_key", "left")
    if "evidence" in found.columns:
        g = g.join(usage.used(own(found).withColumn("asset_key", identity())), "asset_key", "left")
    more = [c for c in ("extra", "alg", "groups", "iterations", "usage") if c in g.columns]
    flat = g.select(*by, *more, "n_occ", "n_files", "best_confidence", "w.file", "w.line", "w.data_class", "w.x_years", "w.weight")
    return recommend.advised(risk.scored(classify.classified(merge.without_noise(flat)), now, z or rules.quantum_year, rules.y_by_family, rules.default_y))


def with_occurrences(assets: DataFrame, places: DataFrame) -> DataFrame:
    """``assets`` with their places as an ordered array, for documents that list them (a bill of materials)."""
    o = F.sort_array(F.collect_list(F.struct("file", "line", "detector", "confidence"))).alias("occurrences")
    return assets.join(places.groupBy("asset_key").agg(o), "asset_key")
