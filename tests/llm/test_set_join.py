import itertools
import random

from pyspark.sql import functions as F

from cipherledger.llm import set_join as J
from cipherledger.llm import simhash_vptree as S


def brute(sets, t):
    up = {s: s for s in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= t * len(x | y) - 1e-9:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {s: root(s) for s in sets}


def test_classes(spark):
    rng = random.Random(4)
    sets = {0: set()}
    for k in range(40):
        base = set(rng.sample(range(400), rng.randint(1, 60)))
        for _ in range(8):  # chains of edits and a hot key
            sets[len(sets)] = base | {-1}
            base = (base - set(rng.sample(sorted(base), len(base) // 12))) | {rng.randrange(400)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "sid long, sigs array<bigint>")
    df = df.withColumn("sigs", F.transform("sigs", lambda x: F.xxhash64(x)))
    for t in (0.8, 0.6):
        distinct = {k: v for k, v in sets.items() if v not in [sets[j] for j in range(k)]}
        got = {r.sid: r.label for r in J.classes(df.where(F.col("sid").isin(list(distinct))), t).collect()}
        assert got == brute(distinct, t)
        assert len(set(got.values())) < len(got)


def test_classes_beyond_the_broadcast_bounds(spark, monkeypatch):
    monkeypatch.setattr(J, "GROUPS", 0)
    monkeypatch.setattr(J, "HEAVY", 5)
    rng = random.Random(6)
    sets = {k: {-1, -2, *rng.sample(range(30), 8)} for k in range(60)}
    sets = {k: v for k, v in sets.items() if v not in [sets[j] for j in range(k)]}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "sid long, sigs array<bigint>")
    assert {r.sid: r.label for r in J.classes(df, 0.6).collect()} == brute(sets, 0.6)


def test_stage_catches_edited_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(20):
        w = [word() for _ in range(200)]
        e = list(w)
        e[60] = e[120] = e[180] = word()
        texts += [" ".join(w), " ".join(e)]  # 15 of 196 shingles differ: a likeness of 0.86
    w = ["same"] * 400 + [word() for _ in range(40)]
    texts += [" ".join(w), " ".join(w[:420] + [word() for _ in range(20)])]  # repeated shingles, different sets
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in S.stage(spark, docs, "").collect()}
    assert kept == {*range(0, 40, 2), 40, 41}


def test_parities_drop_no_pair_that_is_alike():
    import numpy as np

    from cipherledger.llm.simhash_vptree import set_parities

    rng = np.random.default_rng(5)
    for n in (1, 5, 60, 400, 3000):
        base = np.unique(rng.integers(-(2**62), 2**62, n))
        for edits in {0, 1, n // 20, n // 9, n // 8}:
            other = np.unique(np.concatenate([base[edits:], rng.integers(-(2**62), 2**62, edits)]))
            both = len(np.intersect1d(base, other))
            apart = int(np.bitwise_count((set_parities(base) ^ set_parities(other)).view(np.uint64)).sum())
            assert apart <= len(base) + len(other) - 2 * both
            if both / (len(base) + len(other) - both) >= 0.8:
                assert apart <= (len(base) + len(other)) * 0.2 / 1.8 + 1e-9
