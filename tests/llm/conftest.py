import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    long = "the quick word of a long text " * 4000
    rows = [
        (1, "The owner of the house and the dog went to the market in the town", "en", "a", 60),
        (1, "The owner of the house and the dog went to the market in the town", "en", "a", 60),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (None, "no id here but the text of it is kept", "en", None, 3),
        (4, long, "en", "a", len(long)),
        (5, "¿?! ... 123", "es", "a", 11),
        (6, 'token = "0123456789abcdef0123456789"\nReleased under the MIT License.', "en", "a", 40),
        (7, "The owner of the house and the dog went to the market in the town", None, "a", 60),
    ]
    names = "fp,label,score,token_ids,topic,weight,kept,shard,tier,k_id,added,range,node,component".split(",")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("own") for n in names})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
