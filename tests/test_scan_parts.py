"""Parts of a scan that grow with its files: tasks of filtered files, path rules told by a word first."""

import re

from cipherledger import tables
from cipherledger.functions import text as X
from cipherledger.sources import code, corpus
from pyspark.sql import functions as F


def test_filters_on_texts_stay_behind_the_deal(spark, tmp_path):
    n = 3 * corpus.TASK_ROWS
    spark.range(n).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    some = code.files(spark, str(tmp_path), "js", code.orders(spark, str(tmp_path))).where(F.col("text").contains("crypto"))
    assert "Exchange" not in some._jdf.queryExecution().executedPlan().toString()  # a filter was moved below it, into one task
    sizes = some.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == n and max(sizes) < n / 2


def test_a_globs_word_never_decides_alone(spark):
    globs = ["**/auth/**", "auth/**", "a*th", "./auth", "**", "*", "f?.py", "docs/[!a-e]*", "x/[auth]/y", "*.java", "a\\b", "", "src/*/*", *(g for g, _ in [*tables.CLASS_RULES, *tables.CRITICALITY_RULES])]
    paths = ["auth", "auth/x", "x/auth/y", "xauth/y", "authx", "src/auth/a.java", "f1.py", "docs/f", "docs/a", "x/a/y", "a/b", "", "src/1/2", "payments/x", "a/payments/b/c.py", "tests/x", None, "auth\n", "x/auth\n"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    for g in dict.fromkeys(globs):
        got = [tuple(r) for r in rows.select(X.matches(F.col("p"), g), F.col("p").rlike(X.glob_regex(g))).collect()]
        assert all(a == b for a, b in got), (g, got)
    assert X.glob_word("**/auth/**") == "auth" and X.glob_word("*") == "" and X.glob_word("docs/[!a-e]*") == ""
    # told by the word in front of the expression
    assert re.search("contains", str(X.matches(F.col("p"), "**/auth/**")), re.I)
