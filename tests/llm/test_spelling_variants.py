import random
import re
import zlib
from collections import Counter

import pytest

from cipherledger.llm import spelling_variants as V

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, shortest=5, least=3, delete=97):
    n = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % delete == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= least}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, dominance=2):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= dominance * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def random_words(seed, count, letters, longest):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(count)}
    for w in list(words)[: count // 2]:  # chains of edits, runs of equal letters among them
        for _ in range(3):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]]) or "a"
            words.add(w)
    return {w: r.choice([3, 4, 6, 8, 20, 50, 100]) for w in words}


@pytest.mark.parametrize("letters,longest", [("ab", 7), ("aéÿz÷", 5), ("a", 12), ("abcdefghij", 4)])
def test_random_words_as_brute_force(spark, letters, longest):
    n = random_words(longest, 250, letters, longest)
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    assert sorted(map(tuple, V.variants(words).collect()), key=str) == brute(n)


def test_each_pair_is_found_once(spark):
    n = random_words(1, 300, "abc", 6)
    words = spark.createDataFrame([(k, w) for k, w in enumerate(n)], "id long, word string")
    got = [frozenset(r) for r in V.near(words).collect()]
    assert Counter(got) == Counter(frozenset((a, b)) for a in n for b in n if a < b and one_apart(a, b))


def test_light_nodes_are_few(spark):
    n = random_words(2, 400, "abc", 9)
    words = spark.createDataFrame([(k, w) for k, w in enumerate(n)], "id long, word string")
    most = V.lights(words).groupBy("id").count().agg({"count": "max"}).first()[0]
    assert 2**most <= len(n)


def test_texts_as_brute_force(spark):
    r = random.Random(5)
    stems = ["colour", "Color", "Zähler", "zahler", "müller", "MÜLLER", "mueller", "abcde", "xx"]
    rows = [(r.choice([None, r.randint(-5, 500)]), " ".join(r.choice(stems) + r.choice(["", "", "s", "é"]) + r.choice([",", "9", "_", ""]) for _ in range(80))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in V.vocabulary(docs).collect()} == brute_words(rows)
    assert {r.word: r.n for r in V.vocabulary(docs, delete=2).collect()} == brute_words(rows, delete=2)


def test_chains_end_in_roots_and_ties_go_by_code_points(spark):
    n = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "zzzzz": 3, "zzzzy": 6, "zzzzx": 6, "qqqqq": 5, "qqqqr": 9}
    out = {r.word: r for r in V.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert [out[w].root for w in ("aaaaa", "aabbb", "zzzzz", "qqqqq")] == ["aabbb", "aabbb", "zzzzx", "qqqqq"]
    assert (out["zzzzz"].form, out["zzzzz"].n_near, out["qqqqq"].form) == ("zzzzx", 2, None)


def test_odd_rows_long_words_and_empty_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, V.variants(V.vocabulary(odd)).collect()), key=str) == brute(brute_words(rows))
    assert V.variants(V.vocabulary(empty)).count() == 0
    long = "ab" * 50_000
    n = {long: 3, long[:-1]: 9, long[:-1] + "c": 30, "abcde": 3}
    got = V.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {(len(r.word), r.n, r.n_near, r.form_n) for r in got} == {(100000, 3, 2, 30), (99999, 9, 2, 30), (100000, 30, 2, None), (5, 3, 0, None)}


def test_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(map(tuple, V.op13_spelling_variants(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(brute_words(rows))
