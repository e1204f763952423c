from pyspark.sql import functions as F

from cipherledger.functions import validity
from cipherledger.operators import emit, policy, risk


def test_validity(spark):
    rows = [("2024-01-01 00:00:00", "2024-06-01 11:00:00"), ("2024-01-01 00:00:00", "2024-06-01 12:00:00"), ("2020-01-01 00:00:00", "2024-08-30 12:00:00"), ("2024-05-01 00:00:00", "2025-01-01 00:00:00"), (None, "2024-06-02 13:00:00"), ("2020-01-01 00:00:00", None)]
    d = spark.createDataFrame(rows, "a string, b string").select(F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    got = [(r.n, r.f) for r in d.select(validity.days(now, F.col("b")).alias("n"), validity.flags(F.col("a"), F.col("b"), now).alias("f")).collect()]
    assert got == [(-1, "EXPIRED 1d ago"), (0, "EXPIRES IN 0d"), (90, "EXPIRES IN 90d, long-lived (1703d validity)"), (213, ""), (1, "EXPIRES IN 1d"), (None, "")]


def test_escalation(spark):
    d = spark.createDataFrame([("low", "key"), ("critical", "Certificate"), ("none", "key"), ("high", "algorithm"), ("high", None)], "c string, k string")
    assert [r.x for r in d.select(risk.escalated(F.col("c"), F.col("k")).alias("x")).collect()] == ["medium", "critical", "low", "high", "high"]


def test_help_lists_each_text_once_and_the_worst_first(spark):
    rows = [("RSA", f"k{i}", f"n{i}", i % 3, float(i), f"do {i % 10}" if i % 5 else None, " why ") for i in range(30)] + [("AES", "x", "x", 0, 0.0, " ", None)]
    a = spark.createDataFrame(rows, "family string, asset_key string, name string, severity_rank int, score double, recommendation string, rationale string")
    got = {r.family: r for r in emit.sarif_help(a).collect()}
    order = sorted((x for x in rows[:30] if x[5]), key=lambda x: (-x[3], -x[4], x[2]))
    assert got["RSA"].recommendations == list(dict.fromkeys(x[5] for x in order))[:8] and got["RSA"].rationales == ["why"]
    assert got["AES"].recommendations == [] and got["AES"].rationales == []


def test_matched_rules_and_kept_paths(spark):
    d = spark.createDataFrame([("a/b.py",), ("docs/x",), (None,)], "file string")
    got = {r.file: r.m for r in d.select("file", policy.matched_rules(F.col("file"), ["*.py", "**", "c/**"]).alias("m")).collect()}
    assert got["a/b.py"] == ["*.py", "**"] and got["docs/x"] == ["**"]
    assert [r.file for r in policy.kept(d.where("file is not null"), ["docs"]).collect()] == ["a/b.py"] and policy.kept(d, []).count() == 3


def test_ranks_over_ranges(spark):
    rows = [(f"k{i}", f"N{i % 7}", i % 5, float(i % 11), i % 3) for i in range(300)]
    a = spark.createDataFrame(rows, "asset_key string, name string, severity_rank int, score double, n_occ int").repartition(6)
    got = {r.asset_key: r["rank"] for r in risk.ranked(a).collect()}
    want = sorted(rows, key=lambda r: (-r[2], -r[3], -r[4], r[1].lower(), r[0]))
    assert got == {r[0]: i for i, r in enumerate(want, 1)}
    assert risk.ranked(a.limit(0)).count() == 0
