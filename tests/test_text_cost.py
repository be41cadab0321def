"""Reports that do not move whole texts."""

from pyspark.sql import functions as F

from riskspark.operators import ensemble, textmodel


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_report_joins_snippets(spark):
    rows = [(i, f"{'win a prize now' if i % 2 else 'team meeting notes'} {'x' * 300}", i % 2) for i in range(20)]
    df = spark.createDataFrame(rows + [(99, None, 0)], "id long, text string, label int").withColumn("text_snippet", F.lit("mine"))
    report = ensemble.predict_batch(df, textmodel.fit_nb(df))
    joined = plan(report)[plan(report).index("Join LeftOuter") :].splitlines()[1]
    assert "_snippet" in joined and " text#" not in joined and "[text#" not in joined
    got = {r.id: r.text_snippet for r in report.collect()}
    assert got == {i: text[:100] for i, text, _ in rows}
