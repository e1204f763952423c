import math

from pyspark.sql import functions as F

from cipherledger.llm import kn_toxicity as K

EN = "the house of the man and the dog is in the town where they live with a friend"


def test_counts_of_all_labels(spark):
    rare = ["zorkvile", "quuxmean", "blatfoul", "grimtok"]
    rows = [(i, EN + (f" you {rare[i // 3 % 4]} of a man" if i % 3 == 0 else " and a friend") + f" n{i}", int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    whole = K.train(docs, labels, F.lit(True))
    few = K.train(docs, labels, F.lit(True), max_toxic=20, max_ordinary=20)
    assert few.model.top == whole.model.top
    ordinary = few.score(EN), whole.score(EN)
    even = K.Scorer(few.model, few.fit - [-math.log(2), *[0.0] * (len(few.fit) - 1)])  # without the correction by log(1/2)
    assert few.score(EN) < even.score(EN) and max(ordinary) < 0.3
