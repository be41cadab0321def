"""The pipeline over the smallest folder, and its columns between stages."""

import corpus_pipeline
from riskspark.llm.common import table, write_shared


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_shared(stage(spark, docs, folder), "t")
        found = docs.collect()
        assert docs.columns == columns and found and {r.doc_id for r in found} <= ids, name
        assert all(r.n_chars == len(r.text) for r in found), name
        ids = {r.doc_id for r in found}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == len(found) and {r.doc_id for r in last} == ids
    assert all(len(r.ids) == r.n_tokens for r in last)
