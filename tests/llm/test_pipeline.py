import corpus_pipeline
from cipherledger.llm import registry

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= before
        before = docs.count()
        assert docs.columns[: len(columns)] == columns
    assert docs.where("size(token_ids) <> n_tokens").count() == 0


def test_stages_on_odd_and_empty_rows(spark, odd, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names go through all stages, one after the other."""
    for name, docs in (("odd", odd), ("empty", empty)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            kept = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert kept.columns[: len(columns)] == columns
            assert kept.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0  # a stage only drops rows
            docs = kept
        assert docs.where("token_ids <> 'own'").count() == 0  # a caller's column stays
        if name == "odd":
            left = [r.text for r in docs.collect()]
            assert not any(t and "0123456789abcdef" in t for t in left) and len(left) == len(set(left))


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
