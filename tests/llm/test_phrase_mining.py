import random
import re
from collections import Counter, defaultdict

import pytest

from cipherledger.llm import phrase_mining as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, top=2000, within=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cand.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        got = []
        for p, a in cand.items():
            if inside[p] and 100 * inside[p] >= within * a:
                continue
            score, _, l, r = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p), l, r))
        got.sort(key=lambda x: (x[0], x[1], x[2].encode()))
        out += [(lang, i + 1, p, -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(got[:top])]
    return sorted(out)


def random_rows(seed, n, letters):
    r = random.Random(seed)
    return [(r.choice(["en", "de", None, "a\nb c"]), "".join(r.choice(letters) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randint(0, 60)))) for _ in range(n)]


def got(spark, rows, parts=5, **k):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(parts)
    return sorted(map(tuple, P.collocations(df, **k).collect()))


@pytest.mark.parametrize("longest,least", [(3, 10), (4, 3), (2, 1)])
def test_random_texts_as_brute_force(spark, longest, least):
    rows = random_rows(longest, 200, ["A", "b", "Éa", "é", "\x01", "x1", "the", "of"])
    assert got(spark, rows, longest=longest, least=least) == brute(rows, longest, least)


def test_parts_batches_and_hot_prefixes(spark, monkeypatch):
    """Executors import the module anew, so the functions of a task are called here."""
    import pyarrow as pa

    rows = [(a or "und", b) for a, b in random_rows(9, 120, ["a", "b", "c", "the"])]
    monkeypatch.setattr(P, "PLACES", 7)
    monkeypatch.setattr(P, "TEXT", 500)
    batches = [pa.RecordBatch.from_pylist([{"lang": a, "text": b} for a, b in rows[i : i + 11]]) for i in range(0, len(rows), 11)]
    for hot in ({}, {"en": ["the", "the a", "b"], "de": ["a"]}):
        table = pa.Table.from_batches(P.projected(batches, 3, hot))
        table = table.sort_by([("lang", "ascending"), ("phrase", "ascending")])
        for size in (1, 3, 1000):
            out = pa.Table.from_batches(P.grown(table.to_batches(size), 3, 1)).to_pylist()
            want = Counter()
            for lang, text in rows:
                for piece in re.split("[.,;:!?\x0a-\x0d]", text):
                    w = piece.split()
                    want.update((lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
            assert {(r["lang"], r["phrase"]): r["n"] for r in out} == want and len(out) == len(want)


def test_hot_prefixes_are_grown_before_they_are_dealt(spark):
    rows = [("en", "the same words " * 400 + "the other")] * 30 + random_rows(2, 100, ["the", "same", "b"])
    assert got(spark, rows, 7) == brute(rows)


def test_covered_phrases_go_and_ties_go_by_phrase(spark):
    rows = [("en", "new york city. " * 10 + "new york. " * 10 + "b a. a b. " * 15)]
    out = got(spark, rows)
    assert out == brute(rows)
    assert [r[2] for r in out] == ["new york city", "a b", "b a"]


def test_top_of_each_language(spark):
    rows = random_rows(4, 300, [chr(97 + k) for k in range(12)])
    assert got(spark, rows, top=7, least=2) == brute(rows, top=7, least=2)


def test_odd_rows_and_empty_tables(spark, odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(map(tuple, P.collocations(odd).collect())) == brute(rows)
    assert P.collocations(empty).count() == 0
