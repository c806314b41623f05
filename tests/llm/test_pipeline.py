import pytest

import corpus_pipeline


def test_stages_keep_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, sf_dir)
        assert out.columns == docs.columns, name
        path = corpus_pipeline.scratch(spark, name)
        out.write.parquet(path)
        held = spark.read.parquet(path)
        assert 0.5 * docs.count() < held.count() <= docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir)
    assert packed.select("doc_id").distinct().count() == held.select("doc_id").distinct().count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_input(spark, odd, empty, sf_dir, name, stage):
    out = stage(spark, odd, sf_dir)
    rows = out.collect()
    ids = {r["doc_id"] for r in rows}
    assert None in ids and {4, 5, 6, 9} <= ids
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.select("doc_id").collect()}
    else:
        assert out.columns == odd.columns
        assert {r["doc_id"]: r["text"] for r in rows}[4] is None
        gone = {1, 2, 3, 7, 8} - ids
        assert gone == ({2, 3, 8} if name == "ngram_join" else set()) and len(rows) == odd.count() - len(gone)
    assert stage(spark, empty, sf_dir).count() == 0
