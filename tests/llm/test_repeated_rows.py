import duckdb
import numpy as np

from cipherledger.llm import pivot_topk as P


def test_repeated_rows_agree_with_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i % 30 * 10, rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(60)]
    rows += [rows[0]] * 7 + [rows[5]] * 2 + [(50, rows[0][1]), (1, rows[0][1]), (None, [1.0, 1.0, 1.0]), (100, None)]
    path = str(tmp_path / "e.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    (tmp_path / "embeddings.parquet").symlink_to(path)
    got = P.op2_pivot_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(P.ORACLE).fetchall())
    assert sum(r.query_id == 0 and r.rank == 1 for r in got) == 9
