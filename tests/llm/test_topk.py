import numpy as np
import pytest

from cipherledger.llm import pivot_topk as P


def brute(rows, k=5, step=10):
    v = {i: np.floor(256 * np.array(x)).astype(np.int64) for i, x in rows}
    out = []
    for i in sorted(v):
        if i % step == 0:
            best = sorted((-int(v[i] @ v[j]), j) for j in v if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("how", [{}, {"block": 16, "chunk": 4, "pivots": 8}])
def test_brute_force(spark, how):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(80, 6))
    rows = [(i, base[rng.integers(80)].tolist() if i % 3 else base[7].tolist()) for i in range(400)]
    df = P.quantised(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    got = sorted(tuple(r) for r in P.top_k(df.where("id % 10 = 0"), df, **how).collect())
    assert got == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (10, None), (20, [None, 1.0]), (30, [nan, 1.0]), (40, [inf, 1.0]), (1, [0.5]), (2, []), (None, [1.0, 1.0]), (3, [1.0, 0.5])]
    df = P.quantised(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    got = [tuple(r) for r in P.top_k(df.where("id % 10 = 0"), df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 256 * 256 + 128 * 128), (0, 2, 1, 256 * 128), (0, 3, 2, 0)]
    assert P.top_k(df.limit(0), df).count() == 0 and P.top_k(df, df.limit(0)).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(i + 1) * 1e7, 3.0]) for i in range(12)]
    df = P.quantised(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    assert sorted(tuple(r) for r in P.top_k(df.where("id % 10 = 0"), df).collect()) == brute(rows)
