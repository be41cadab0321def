"""Line dedup and the lines below MIN_CHARS."""

import corpus_pipeline
from riskspark.llm.linededup import op3

LINE = "a line of some thirty characters"


def test_unique_short_lines_keep_their_document(spark):
    rows = [(1, LINE), (2, f"own verse\n{LINE}\n雪が降る"), (3, f"{LINE}\n\n---")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: LINE, 2: "own verse\n雪が降る"}


def test_short_lines_are_judged_by_equality(spark, tmp_path):
    rows = [(1, "Home\n\nAbout us\nfirst text"), (2, "Home\n\nAbout us!\nsecond text"), (3, "Home")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "\nAbout us!\nsecond text"}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.dropped_lines for r in op3(spark, str(tmp_path)).collect()}
    assert found == {1: "", 2: "0", 3: "0"}
