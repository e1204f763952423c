import numpy as np
import pytest
import xxhash

from cipherledger.llm import simhash_vptree as S
from cipherledger.llm.common import components


def _find(up, x):
    while up[x] != x:
        x = up[x]
    return x


def brute(values, radius=3):
    up = {v: v for v in values}
    vs = sorted(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = _find(up, a), _find(up, b)
                up[max(x, y)] = min(x, y)
    return {v: _find(up, v) for v in vs}


def test_fingerprint():
    w = "ab cd EF gh".lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 2)
    assert S.fingerprint("ab\tcd \n EF gh") == want
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0
    assert S.fingerprint("One") == xxhash.xxh64_intdigest(b"one", 42)


@pytest.mark.parametrize("how", [{}, {"shard": 40, "max_shards": 16}, {"shard": 100, "max_shards": 4, "block": 50}])
def test_links(spark, how):
    rng = np.random.default_rng(1)
    values = set()
    for b in rng.integers(0, 2**63, 60, dtype=np.uint64).tolist():
        for _ in range(6):
            x = b
            for j in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(j)
            values.add(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.component for r in components(S.links(df, **how)).collect()}
    assert {v: got.get(v, v) for v in values} == brute(values)


def test_dense_group(spark):
    values = [(1 << a) | (1 << b) for a in range(24) for b in range(a)]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    e = S.links(df).collect()
    assert len(e) < 3 * len(values)
    assert len({r.component for r in components(S.links(df)).collect()}) == 1


def test_frames(odd, empty):
    got = S.near_groups(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == {("0" * 16, 2)} and {c for _, c in by[7]} == {1}
    assert S.near_groups(empty).count() == 0
    kept = S.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str)
    assert ids.count(1) == 1 and 7 not in ids and 3 not in ids and None in ids
    assert S.deduplicated(empty).count() == 0
