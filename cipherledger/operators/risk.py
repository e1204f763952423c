"""Risk of assets: Mosca arithmetic, score, severity, summaries and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import risk_math as M
from ..runtime import stored
from . import policy as P

NOW = 2026


def escalated(label: Column, kind: Column) -> Column:
    """The criticality label, one step higher for keys and certificates."""
    up = [n for n, _ in T.LABELS]
    higher = dict(zip(up[1:], up))
    return F.when(F.lower(kind).isin("key", "certificate"), M.looked_up(label, higher, up[0])).otherwise(label)


def scored(assets: DataFrame, now: int = NOW, z: int = T.QUANTUM_YEAR, years: dict | None = None, default: int = T.DEFAULT_YEARS, escalate: bool = False) -> DataFrame:
    """``assets (family, threat, x_years, weight, ...)`` with years, verdict, score and severity; ``escalate`` raises the criticality of
    key material by a step."""
    broken = F.col("threat").isin("shor_broken", "legacy_broken")
    a = assets.withColumn("y_years", P.migration_years(F.col("family"), years, default)).withColumn("z_year", F.lit(z))
    a = a.withColumn("shortfall", M.shortfall(F.col("x_years"), F.col("y_years"), F.col("z_year"), now)).withColumn("act_now", broken & M.act_now(F.col("shortfall")))
    a = a.withColumn("deadline_year", F.when(broken, M.deadline(F.col("x_years"), F.col("y_years"), F.col("z_year"))))
    a = a.withColumn("criticality", escalated(M.label(F.col("weight")), F.col("kind")) if escalate else M.label(F.col("weight"))).withColumn("severity", M.severity(F.col("threat"), F.col("act_now")))
    s = M.score(F.col("threat"), F.col("x_years"), F.col("y_years"), F.when(F.col("act_now"), F.col("shortfall")).otherwise(0), M.label_weight(F.col("criticality")), F.col("severity"))
    return a.withColumn("score", s).withColumn("severity_rank", M.rank(F.col("severity")))


def severity_counts(assets: DataFrame) -> DataFrame:
    """Assets of every severity, zeros included."""
    dim = assets.sparkSession.createDataFrame(list(T.SEVERITIES.items()), "severity string, severity_rank int")
    return dim.join(assets.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", "severity_rank", F.coalesce("n", F.lit(0)).alias("n"))


def summary(assets: DataFrame) -> DataFrame:
    of = lambda t: F.count_if(F.col("threat") == t).alias(f"n_{t}")
    vulnerable = F.count_if(F.col("threat").isin("shor_broken", "legacy_broken", "grover_weakened"))
    return assets.agg(F.count("*").alias("n_assets"), *map(of, ("shor_broken", "legacy_broken", "grover_weakened", "quantum_safe", "pqc", "unknown")), vulnerable.alias("n_vulnerable"), F.count_if("act_now").alias("n_act_now"), F.max("score").alias("max_score"), F.round(F.avg("score"), 4).alias("mean_score"), F.sum("n_occ").alias("n_occurrences"))


def ranked(assets: DataFrame, name: str = "name") -> DataFrame:
    """Assets with their rank: severity, score, occurrences, name. Ranges of the order are ranked side by side, each from the number
    of rows in the ranges before it; that table has a row a range."""
    order = [F.desc("severity_rank"), F.desc("score"), F.desc("n_occ"), F.asc("rank_name"), F.asc("asset_key")]
    dealt = assets.withColumn("rank_name", F.lower(name)).repartitionByRange(*order)
    dealt = stored(dealt.withColumn("rank_range", F.spark_partition_id()), "ranked")
    before = Window.orderBy("rank_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("rank_range").agg(F.count("*").alias("k")).withColumn("rank_offset", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    w = Window.partitionBy("rank_range").orderBy(*order)
    out = dealt.withColumn("rank_own", F.row_number().over(w)).join(F.broadcast(sizes), "rank_range")
    return out.withColumn("rank", (F.col("rank_own") + F.col("rank_offset")).cast("int")).select(*assets.columns, "rank")
