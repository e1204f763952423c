"""Compact tables are dealt to many tasks before parsers read the texts made of them."""

import time

from cipherledger.operators.detect import masking, source
from cipherledger.sources import code, corpus


def test_one_row_group_is_many_tasks(spark, tmp_path):
    n = 3 * corpus.TASK_ROWS
    spark.range(n).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(n).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for files in (code.call_files(spark, str(tmp_path), "java"), code.files(spark, str(tmp_path), "js")):
        sizes = files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes) == 3 and sum(sizes) == n and max(sizes) < n / 2
        assert files.select("path").distinct().count() == n


def test_an_empty_table_has_no_files(spark, tmp_path):
    spark.range(0).selectExpr("id AS p_partkey", "CAST(0 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert code.call_files(spark, str(tmp_path), "c").count() == 0


def test_evidence_is_one_line_of_a_long_file():
    text = "c.createHash('md5');\n" * 20_000
    began = time.process_time()
    found, error = source.detect("js", text)
    assert error is None and len(found) == 20_000 and time.process_time() - began < 10  # each finding copied the rest of the file
    assert (found[-1]["line"], found[-1]["evidence"]) == (20_000, "c.createHash('md5');")


def test_masked_text_keeps_its_length_and_lines():
    text = "a = 'x\\'y'; /* one\ntwo */ b(\"//no\"); // c\n`d\ne`"
    hidden, live = masking.masked(text, "js")
    assert hidden == "a = '    '; /*".replace("/*", "  ") + "    \n" + "       b(\"    \");     \n" + "` \n `"
    assert live == text.replace("/* one", "      ").replace("two */", "      ").replace("// c", "    ")


def test_findings_stay_where_they_are_when_merged(spark):
    from cipherledger.operators import merge

    found = spark.range(1000).selectExpr("'AES' AS family", "'algorithm' AS kind", "'AES' AS name", "CAST(IF(id % 2 = 0, 256, NULL) AS INT) AS key_size", "CAST(NULL AS STRING) AS curve", "CAST(NULL AS STRING) AS mode", "CAST(NULL AS STRING) AS padding", "'high' AS confidence")
    done = merge.compatible(found)
    assert [(r.key_size, r["count"]) for r in done.groupBy("key_size").count().collect()] == [(256, 1000)]
    assert "SortMergeJoin" not in done._jdf.queryExecution().executedPlan().toString()


def test_files_that_are_no_source_are_told_without_a_join(spark):
    files = spark.createDataFrame([("a.py", b"x", 1), ("b.bin", b"\x00", 1), ("c.js", b"x" * 8001, 8001), ("d.go", b"a\0b", 3)], "path string, content binary, length long")
    texts, skipped = corpus.sources(files)
    assert [r.path for r in texts.collect()] == ["a.py"] and sorted(r.message for r in skipped.collect()) == ["c.js: minified", "d.go: binary"]
    told = {r.path: (r.lang, r.why) for r in corpus.judged(files).collect()}
    assert told == {"a.py": ("python", None), "b.bin": (None, None), "c.js": ("js", "minified"), "d.go": ("go", "binary")}
