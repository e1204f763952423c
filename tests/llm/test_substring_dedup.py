import hashlib
import random
import re
from collections import Counter

import pytest

from cipherledger.llm import substring_dedup as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    """(doc_id, words, kept words) by comparing all windows of all rows."""
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def random_rows(seed, n, letters, window):
    r = random.Random(seed)
    passages = [[r.choice(letters) for _ in range(r.randint(window - 2, 3 * window))] for _ in range(6)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choice(passages)[r.randint(0, 3) :] if r.random() < 0.6 else [r.choice(letters) for _ in range(r.randint(0, window))]
        rows.append((k, r.choice([" ", "\n", "\t \r"]).join(words)))
    return rows


@pytest.mark.parametrize("window", [1, 4, 12, 22, 35, 60])
def test_random_passages_as_brute_force(spark, window):
    assert S.period_of(35) == 21 and S.period_of(1) == 1
    rows = random_rows(window, 60, "abcdefgh", window) + random_rows(window + 1, 20, "ab", window)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, S.deduplicated(docs, window=window).collect()))
    want = sorted(brute(rows, window))
    assert got == want and any(x[2] for x in want)


def test_covers_meet_every_pair_of_places():
    for v, cover in S.COVERS.items():
        for i in range(v):
            for j in range(v):
                assert any((i + s) % v in cover and (j + s) % v in cover for s in range(v))


def test_repeats_within_one_text_and_overlapping(spark):
    rows = [(1, " ".join(["x"] * 40)), (2, "y " * 34), (3, " ".join(map(str, range(70))) + " " + " ".join(map(str, range(70))))]
    got = {r.doc_id: r for r in S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (40, 0, 140)


def test_odd_rows_and_empty_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for w in (5, 35):
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(map(tuple, S.deduplicated(odd, window=w).collect()), key=key) == sorted(brute(rows, w), key=key)
    assert S.deduplicated(empty).count() == 0


def test_hot_row_many_times(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(7, text)] * 500 + [(8, "other words " + text)] + [(None, text)] * 3
    got = S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    assert sorted(((r.doc_id or 0), r.n_words, r.n_removed, r.kept, r["count"]) for r in got) == [(0, 50, 50, "", 3), (7, 50, 50, "", 500), (8, 52, 50, "other words", 1)]


def test_both_ways_back_to_the_texts(spark, monkeypatch):
    rows = random_rows(3, 80, "abcdefgh", 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "BROADCAST", 1)
    assert sorted(map(tuple, S.deduplicated(docs, window=12).collect())) == sorted(brute(rows, 12))


def test_query_digests(spark):
    df = S.op12_substring_dedup(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {(k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in brute(rows, 35)}
    assert {tuple(r) for r in df.collect()} == want
