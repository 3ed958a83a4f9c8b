"""The pipeline's stages against what each may do to its input."""

import corpus_pipeline
from gridloom.llm.common import handed_on

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = handed_on(stage(spark, before, SF), name)
        kept[name] = after
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        before = after
    rules, deduplicated, masked, mixed, encoded = kept.values()
    assert 0 < rules.count() < docs.count()
    assert deduplicated.count() == deduplicated.select("doc_id").distinct().count() <= rules.count()
    assert masked.count() == deduplicated.count()
    assert masked.where("text RLIKE 'token = \"[0-9a-f]{40}'").count() == 0
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    assert encoded.count() == mixed.count() and encoded.where("n_tokens = 0").count() == 0
