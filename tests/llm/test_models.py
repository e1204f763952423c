"""Language, toxicity and licence models on small texts."""

from pyspark.sql import functions as F

from cipherledger.llm import kn_toxicity as K
from cipherledger.llm import language_id as L
from cipherledger.llm import license_scan as S

EN = "the house of the man and the dog is in the town where they live with a friend"
DE = "das haus von dem mann und der hund ist in der stadt wo sie mit einem freund leben"


def _docs(spark):
    rows = [(i, (EN if i % 2 else DE) + f" wort{i}", "en" if i % 2 else "de") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark, odd, empty):
    m = L.train(_docs(spark), F.lit(True))
    assert m.langs == ["de", "en"]
    assert m.predict(EN)[0] == "en" and m.predict("hundstadt freundlich")[0] == "de"
    assert m.predict("12 !")[0] == "und" and m.predict(None) == ("und", 0.0)
    got = {r.doc_id: r for r in L.identified(odd, m).select("doc_id", "lang_pred", F.col("lang_pred").alias("x")).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[5].lang_pred == "und" and got[4].lang_pred == "en"
    assert L.identified(empty, m).count() == 0
    none = L.train(_docs(spark).limit(0), F.lit(True))
    assert none.predict(EN) == ("und", 0.0)


def test_toxicity(spark, odd, empty):
    rows = [(i, EN + (f" you vile grumpf{'abcdefgh'[i % 8]} of a man" if i % 3 == 0 else " and a friend") + f" n{i}", int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    s = K.train(docs, labels, F.lit(True))
    assert s.score(EN + " he is a grumpfz") > 0.7 > 0.3 > s.score(EN)
    assert s.score("") == s.score(None) == s.score("123") < 0.7
    assert K.scored(odd, s, score="s").where("s is null or s < 0 or s > 1").count() == 0
    assert K.scored(empty, s, score="s").count() == 0
    assert K.train(docs, labels.limit(0), F.lit(True)).score(EN) == 0.0


def test_licences(spark, odd, empty):
    s = S.train(_docs(spark))
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary", "Licensed under the Foo License, Version 9": "unknown"}
    for t, f in lines.items():
        assert s.classify(t)[0] == f, t
    assert s.classify(EN) is None and s.classify("the driver got a license") is None
    text = EN + "\nReleased under the MIT License.\n"
    ((a, b, f, _),) = s.scan(text)
    assert (text[a:b], f) == ("Released under the MIT License.", "MIT")
    got = {r.doc_id: r for r in S.scanned(odd, s).collect()}
    assert got[6].family == "MIT" and got[2].family is None and got[3].n_paragraphs == 0
    assert S.scanned(empty, s).count() == 0
