from pyspark.sql import functions as F

from cipherledger.llm import kn_toxicity as K
from cipherledger.llm import language_id as L

EN = "the house of the man and the dog is in the town where they live with a friend"
DE = "das haus von dem mann und der hund ist in der stadt wo sie mit einem freund leben"


def test_language_of_a_long_run(spark):
    rows = [(i, (EN if i % 2 else DE) + f" wort{i}", "en" if i % 2 else "de") for i in range(60)]
    m = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert m.predict(EN.replace(" ", "")[:41] + DE.replace(" ", "") * 5)[0] == "de"


def test_toxicity_behind_a_long_run(spark):
    rows = [(i, EN + (" you vilegrumpf of a man" if i % 3 == 0 else " and a friend") + f" n{i}", int(i % 3 == 0)) for i in range(150)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    s = K.train(docs, labels, F.lit(True))
    start = "friend" * 7
    assert s.model.weight(start + "vilegrumpf") > s.model.weight(start + "friendtown") + 1
