"""The packed models against plain dictionaries."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cipherledger.llm import kn_toxicity as K
from cipherledger.llm import language_id as L

TEXTS = ["the house of the man", "you vile grumpf of a man", "a dog in the town", "vile vile grumpfz", "the towns of men", "grim old house"]
TOXIC = [0, 1, 0, 1, 0, 1]


def kneser_ney(counts, g, d=K.DISCOUNT):
    """The log ratio of the n-gram g by recursion over the orders; counts[c] are the n-grams of class c."""
    levels = [set(counts[0]) | set(counts[1])]
    low = []
    for _ in range(len(g) - 1):
        cont = Counter(x[1:] for x in levels[-1])
        low.append(cont)
        levels.append(set(cont))
    by = {len(next(iter(c))): c for c in low}
    alphabet = max(2, len(by[1]) + 1)

    def shared(s):
        below = shared(s[1:]) if len(s) > 1 else 1 / alphabet
        after = [n for x, n in by[len(s)].items() if x[:-1] == s[:-1]]
        return (max(by[len(s)][s] - d, 0) + d * len(after) * below) / sum(after) if after else below

    def p(c):
        after = [n for x, n in counts[c].items() if x[:-1] == g[:-1]]
        return (max(counts[c][g] - d, 0) + d * len(after) * shared(g[1:])) / sum(after) if after else shared(g[1:])

    return math.log(p(1) / p(0))


def test_kneser_ney(spark):
    rows = spark.createDataFrame([(t, y, 0) for t, y in zip(TEXTS, TOXIC)], "text string, toxic int, fold int")
    tables = K.packed(K.ratios(K.spellings(rows)))
    model = K._model(tables.cache(), 2, K.ORDER)
    counts = Counter(), Counter()
    for t, y in zip(TEXTS, TOXIC):
        for w in set(K.words(t)):
            counts[y].update(K.grams(w))
    for w in ["vile", "grumpf", "grumpfzz", "house", "towns", "men", "zebra", "a", "vilehouse", "grimtown" * 30]:
        want = sum(kneser_ney(counts, g) for g in K.grams(w))
        assert model.weight(w) == pytest.approx(want, abs=1e-4), w


def test_word_first_backoff():
    counts = {w: dict(by) for w, by in {"haus": {"de": 3}, "house": {"en": 2}, "the": {"en": 5, "de": 1}, "und": {"de": 4}, "hund": {"de": 1}}.items()}
    m = L.Model(["de", "en"], counts, {w: 2 for w in counts} | {"hund": 1})
    gram, word = [defaultdict(lambda: [0, 0]) for _ in range(6)], {}
    for w, by in counts.items():
        v = [by.get("de", 0), by.get("en", 0)]
        if w != "hund":
            word[w] = v
        for n in range(1, 6):
            s = f"^{w}$"
            for i in range(len(s) - n + 1):
                gram[n][s[i : i + n]] = [a + b for a, b in zip(gram[n][s[i : i + n]], v)]
    def logs(d):
        total = [sum(v[j] + L.ALPHA for v in d.values()) for j in (0, 1)]
        return {k: [math.log((v[j] + L.ALPHA) / total[j]) for j in (0, 1)] for k, v in d.items()}

    gram, word = [logs(g) if g else {} for g in gram], logs(word)

    def parts(g):
        if g in gram[len(g)]:
            return [gram[len(g)][g]]
        return [] if len(g) == 1 else parts(g[:-1]) + parts(g[1:])

    for w in ["haus", "hund", "houses", "x", "ab", "undthe", "q" * 50 + "haus"]:
        s = f"^{w}$"
        n = min(5, len(s))
        got = [word[w]] if w in word else [x for i in range(len(s) - n + 1) for x in parts(s[i : i + n])]
        mean = [sum(x[j] for x in got) / max(1, len(got)) for j in (0, 1)]
        assert m.word_scores([w])[0] == pytest.approx([x - max(mean) for x in mean], abs=1e-4), w
    assert list(m.predict_all(["haus und", "the house", "haus und", None, "1"])) == [m.predict("haus und"), m.predict("the house"), m.predict("haus und"), ("und", 0.0), ("und", 0.0)]


def test_clashing_names(odd, empty):
    m = L.Model(["de", "en"], {"the": {"en": 5}, "und": {"de": 4}}, {"the": 2, "und": 2})
    for rows in (odd, empty):
        out = L.identified(rows, m)
        assert out.columns == [*odd.columns, "lang_pred", "score_"] and out.count() == rows.count()
        out = K.scored(rows, K.Scorer(None, None))
        assert out.columns == [*odd.columns, "score_"] and out.where(F.col("score") != "own").count() == 0
