"""Topics are fitted on every row: rows beyond any fixed number of texts change the centres."""

import numpy as np

from cipherledger.llm import source_mixing as M


def _docs(spark, n, parts=4):
    return spark.range(0, n, 1, parts).selectExpr("id AS doc_id", "concat(CASE id % 3 WHEN 0 THEN 'aaa bbb ccc ' WHEN 1 THEN 'xyz uvw rst ' ELSE '123 456 789 ' END, id) AS text")


def test_sums_are_those_of_all_rows(spark):
    docs = _docs(spark, 3000)
    ((n, v),) = M._summed(docs, "text").values()
    own = sum(M.trigram_vector(r.text) for r in docs.collect())
    assert n == 3000 and np.abs(v - own).max() < 1e-3
    mean, planes = v / n, np.random.default_rng(5).choice([-1.0, 1.0], (M.PLANES, M.DIMS))
    cells = M._summed(docs, "text", (mean, planes))
    assert sum(m for m, _ in cells.values()) == 3000 and np.abs(sum(x for _, x in cells.values()) - v).max() < 1e-6


def test_every_row_counts_and_partitions_do_not_matter(spark):
    # 2,500 texts of three kinds and 2,500 of a fourth: a sample of either 2,000 would miss how many there are
    more = spark.range(2500).selectExpr("id + 5000 AS doc_id", "'##### @@@@@ !!!!!' AS text")
    docs = _docs(spark, 2500).unionByName(more)
    a, b = M.fit_topics(docs, 4), M.fit_topics(docs.repartition(7), 4)
    assert np.array_equal(a, b)
    near = M.with_topic(docs, a).groupBy("topic").count().collect()
    assert sorted(r["count"] for r in near) == [833, 833, 834, 2500]


def test_no_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "doc_id long, text string")
    assert M.fit_topics(docs).shape == (0, M.DIMS)
