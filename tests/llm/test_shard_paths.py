from pyspark.sql import functions as F

from cipherledger.llm import tiered_shards as T
from cipherledger.llm.common import fresh_dir


def test_shards_of_one_base_name(spark):
    path = fresh_dir(spark, "a store+é%")
    s = T.Store(spark, path)
    m = s.append(spark.range(100).withColumn("arrival", (F.col("id") % 4)).coalesce(1), "arrival")
    assert len(m["shards"]) == 4 and len({x["path"].rsplit("/", 1)[-1] for x in m["shards"]}) == 1
    rows = s.read().collect()
    assert len(rows) == 100 and len({r.shard for r in rows}) == 4
    assert {r.shard: r.shard_rows for r in rows} == {x: sum(r.shard == x for r in rows) for x in {r.shard for r in rows}}
