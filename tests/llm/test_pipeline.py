"""The stages in a row on the smallest tables."""

import corpus_pipeline
from keepsake.sources.tables import table

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "decontamination", "secrets", "mixture"]
    columns, before = docs.columns, docs.count()
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*columns, "copies"] and 0 < out.count() <= before


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
