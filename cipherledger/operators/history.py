"""Scan history: append-only scans, lookups, and the difference of two scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk_math as M
from ..sources.versions import Versioned

TRACKED = ["threat", "severity", "score", "act_now", "n_occ", "rule_id"]


def save(assets: DataFrame, path: str, scan_id: str, target: str, finished: str) -> None:
    """Adds one scan, with the decoded row of each asset as ``data``; readers see the whole scan or nothing of it."""
    stamped = assets.withColumn("scan_id", F.lit(scan_id)).withColumn("target", F.lit(target)).withColumn("finished", F.lit(finished))
    Versioned(assets.sparkSession, path).add(stamped.withColumn("data", snapshot(assets)), str(scan_id), {"target": target, "finished": finished})


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The scans of the newest version, or of a given one; None where there are none."""
    return Versioned(spark, path).read(version)


def delete(spark: SparkSession, path: str, scan_id: str) -> bool:
    """Removes a scan and its rows; whether it was there. Readers that began before keep their version until the next one."""
    store = Versioned(spark, path)
    there = str(scan_id) in store.parts()
    if there:
        store.change(lambda parts: {k: v for k, v in parts.items() if k != str(scan_id)})
        store.vacuum(keep=2)
    return there


def snapshot(assets: DataFrame) -> Column:
    """All columns of an asset as one JSON text."""
    return F.to_json(F.struct(*(F.col(c) for c in assets.columns)))


def decoded(rows: DataFrame, data: str, fields: str) -> DataFrame:
    """``rows`` with ``fields`` (a schema) read from the JSON text ``data``: text that can't be read, or isn't there, is an empty object.
    A missing ``asset_key`` is made from family, size, curve and mode."""
    read = F.coalesce(F.from_json(data, fields, {"mode": "PERMISSIVE"}), F.from_json(F.lit("{}"), fields))
    out = rows.withColumn("decoded", read)
    names = [f.split(" ")[0] for f in fields.split(", ")]
    part = lambda n: F.coalesce(F.col(f"decoded.{n}").cast("string"), F.lit("None")) if n in names else F.lit("None")
    plain = [F.col(f"decoded.{n}").alias(n) for n in names if n != "asset_key"]
    key = F.coalesce(F.col("decoded.asset_key") if "asset_key" in names else F.lit(None), F.concat_ws("|", *map(part, ("family", "key_size", "curve", "mode"))))
    return out.select(*(c for c in rows.columns if c not in names), key.alias("asset_key"), *plain)


def scans(history: DataFrame) -> DataFrame:
    """One row a scan with its counts."""
    sev = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "high", "medium", "low", "none")]
    return history.groupBy("scan_id").agg(F.count("*").alias("n_assets"), *sev, F.sum("n_occ").alias("n_occurrences"), F.count_if("act_now").alias("n_act_now"), F.sum(M.rank(F.col("severity"), 0)).cast("long").alias("weighted_risk"))


def latest(history: DataFrame, n: int = 2) -> DataFrame:
    """The newest scans, oldest first."""
    return history.select("scan_id").distinct().orderBy(F.desc("scan_id")).limit(n).orderBy("scan_id")


def scan(history: DataFrame, scan_id) -> DataFrame:
    """The assets of one scan with their ``place`` in its order: severity, score, name."""
    from pyspark.sql import Window

    name = F.lower("name") if "name" in history.columns else F.col("asset_key")
    w = Window.orderBy(M.rank(F.col("severity")).desc(), F.desc("score"), name, "asset_key")
    return history.where(F.col("scan_id") == scan_id).withColumn("place", F.row_number().over(w))


def indexed(history: DataFrame, scan: Column) -> DataFrame:
    """One row an identity: the highest severity, then the highest score."""
    have = [c for c in TRACKED if c in history.columns]
    pick = F.max(F.struct(M.rank(F.col("severity")).alias("r"), *have))
    return history.where(scan).groupBy("asset_key").agg(pick.alias("p")).select("asset_key", "p.*")


def diff(history: DataFrame, a, b) -> DataFrame:
    """``asset_key, status, direction, changed`` between scans a and b: added, removed, changed or unchanged."""
    have = [c for c in TRACKED if c in history.columns]
    side = lambda scan, s: indexed(history, F.col("scan_id") == scan).select("asset_key", *(F.col(c).alias(f"{s}_{c}") for c in ("r", *have)))
    j = side(a, "a").join(side(b, "b"), "asset_key", "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in have]))
    status = F.when(F.col("a_r").isNull(), "added").when(F.col("b_r").isNull(), "removed").when(F.size(differs) > 0, "changed").otherwise("unchanged")
    direction = F.when(F.col("a_r").isNull() | F.col("b_r").isNull(), None).when(F.col("b_r") > F.col("a_r"), "worse").when(F.col("b_r") < F.col("a_r"), "better").otherwise("same")
    changed = F.when(status == "changed", F.array_join(F.array_sort(differs), ",")).otherwise("")
    return j.select("asset_key", status.alias("status"), direction.alias("direction"), changed.alias("changed"), F.col("a_r").alias("rank_a"), F.col("b_r").alias("rank_b"))


def posture(history: DataFrame, a, b) -> DataFrame:
    """One row: the weighted risk of both scans and whether the posture improved."""
    s = scans(history.where(F.col("scan_id").isin(a, b)))
    of = lambda scan, c: F.coalesce(F.max(F.when(F.col("scan_id") == scan, F.col(c))), F.lit(0))
    out = s.agg(of(a, "weighted_risk").alias("risk_a"), of(b, "weighted_risk").alias("risk_b"), of(a, "n_act_now").alias("act_now_a"), of(b, "n_act_now").alias("act_now_b"), (of(b, "n_assets") - of(a, "n_assets")).alias("total_delta"))
    return out.withColumn("posture", F.when(F.col("risk_b") < F.col("risk_a"), "improved").when(F.col("risk_b") > F.col("risk_a"), "regressed").otherwise("unchanged"))
