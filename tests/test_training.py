import math
import random

import pytest
from pyspark.sql import functions as F

from riskspark.functions import scoring, text
from riskspark.operators import corpus, ensemble, metrics, sampling, textmodel, trees
from riskspark.plans.corpus import build_mail_corpus, build_text_corpus, build_url_corpus
from riskspark.sources import readers, writers


def values(spark, func, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.o for r in df.select("i", func(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_text(spark):
    given = ["<html><body><p>Hello <b>world</b></p></body></html>", "  hello    world   ", "HELLO World", None,
             "a < b", "café   x", "Tom &amp; <i>J</i>",
             "<p>a&#8217;b &#x41; &mdash; c</p>", "<p>&#65;&#x42;&lbrace;&amp;lt; &nosuch; &#0;&#xD800;z &quot;q&quot;&#39;</p>"]
    assert values(spark, text.clean_text, given) == [
        "hello world", "hello world", "hello world", "", "a b", "caf x", "tom & j",
        "a b a c", "ab{&lt; &nosuch; z \"q\"'",
    ]


def test_entities(spark):
    given = ["a&#8217;b", "&#x1F600;", "&mdash;&eacute;", "&amp;amp;", "&lt;&gt;&vert;", "x & y; &; &#;", "", None, "&copy; 2024 &NotEqualTilde;&Tab;z"]
    assert values(spark, text.decode_entities, given) == [
        "a\u2019b", "\U0001F600", "\u2014\u00e9", "&amp;", "<>|", "x & y; &; &#;", "", None, "\u00a9 2024 \u2242\u0338\tz",
    ]


def test_label_words(spark):
    given = ["phishing", "legitimate", "Phishing", "Legit", "spam", "ham", "SPAM", "HAM", " yes ", "0.7", "0.5", "nan", "unknown", "1e3"]
    assert values(spark, text.coerce_label, given) == [1, 0, 1, 0, 1, 0, 1, 0, 1, 1, 0, 0, 0, 1]


def test_label_types(spark):
    flags = corpus.label_as_int(spark.createDataFrame([(True,), (False,)], "label boolean"))
    assert sorted(r.label for r in flags.collect()) == [0, 1]
    numbers = corpus.label_as_int(spark.createDataFrame([(0.4,), (0.6,), (float("nan"),)], "label double"))
    assert sorted(r.label for r in numbers.collect()) == [0, 0, 1]


def test_column_guess(spark):
    df = spark.createDataFrame([(1, "x", "spam")], "id int, EmailText string, Class string")
    assert corpus.normalize_columns(df).columns == ["text", "label"]
    assert corpus.normalize_columns(df.select("id", F.col("Class").alias("other"))).head().text == "spam"
    with pytest.raises(ValueError):
        corpus.normalize_columns(df.select("id"))


@pytest.mark.parametrize("n, sizes", [(100, (70, 15, 15)), (11, (7, 1, 3)), (1, (0, 0, 1))])
def test_split_sizes_and_disjointness(spark, n, sizes):
    rows = sampling.assign_split(spark.range(n)).collect()
    assert len({r.id for r in rows}) == n == len(rows)
    names = [r.split for r in rows]
    assert tuple(names.count(s) for s in ("train", "val", "test")) == sizes


def test_stratified_split_and_null_class(spark):
    df = spark.range(60).withColumn("label", F.when(F.col("id") % 3 < 2, F.col("id") % 3))
    rows = sampling.assign_split(df, (0.8,), ("train", "test"), stratify="label").groupBy("label", "split").count()
    assert {(r.label, r.split): r["count"] for r in rows.collect()} == {
        (c, s): n for c in (0, 1, None) for s, n in (("train", 16), ("test", 4))
    }


def test_cap_keeps_small_classes_whole(spark):
    df = spark.range(1000).withColumn("label", F.when(F.col("id") < 20, 1).otherwise(0))
    got = sampling.cap_per_class(df, 100).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 100, 1: 20}


def test_limits_joined_or_broadcast_give_the_same_rows(spark, monkeypatch):
    df = spark.range(3000).withColumn("label", F.when(F.col("id") % 3 > 0, F.col("id") % 500))
    expected = {tuple(r) for r in sampling.cap_per_class(df, 2).collect()}
    split = {tuple(r) for r in sampling.assign_split(df, (0.8,), ("train", "test"), stratify="label").collect()}
    monkeypatch.setattr(sampling._few, "__defaults__", (0,))
    assert {tuple(r) for r in sampling.cap_per_class(df, 2).collect()} == expected
    assert {tuple(r) for r in sampling.assign_split(df, (0.8,), ("train", "test"), stratify="label").collect()} == split
    assert sampling.assign_split(df.limit(0)).count() == 0


def test_dedupe_keeps_the_first_label(spark):
    df = spark.createDataFrame([("a", 1, 1, 0), ("a", 0, 0, 5), ("b", 1, 0, 1)], "text string, label int, src int, row int")
    once = corpus.dedupe_first(df, "text", ["src", "row"])
    assert sorted(map(tuple, once.collect())) == [("a", 0, 0, 5), ("b", 1, 0, 1)]
    assert sorted(map(tuple, corpus.dedupe_first(once, "text", ["src", "row"]).collect())) == sorted(map(tuple, once.collect()))


def test_corpus_plans(spark):
    rows = [(i % 2, i, f"<b>Text</b> {i % 40}" if i % 3 else "same copy") for i in range(120)]
    df = spark.createDataFrame(rows, "label int, ord int, text string")
    built = build_text_corpus(df, ["ord"], max_per_class=10)
    assert {r.label: r["count"] for r in built.groupBy("label").count().collect()} == {0: 10, 1: 10}
    urls = spark.createDataFrame([("http://a.com/", 1)] * 30 + [("http://b.com/", 0), (None, 0)], "url string, label int")
    kept = build_url_corpus([urls], max_per_class=12)
    assert {r.label: r["count"] for r in kept.groupBy("label").count().collect()} == {0: 1, 1: 12}


TRAIN = [("verify account now", 1), ("verify account urgent", 1), ("team meeting now", 0), ("team lunch meeting", 0), ("account meeting notes", 0)]


@pytest.fixture(scope="module")
def nb(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(TRAIN)], "id int, text string, label int")
    return textmodel.fit_nb(df, ngram_range=(1, 1), stop_words=[])


def test_nb_golden_model(nb):
    rows = nb.terms.orderBy("term").collect()
    assert [r.term for r in rows] == ["account", "meeting", "now", "team", "verify"]
    assert [r.idf for r in rows] == pytest.approx([1.405465, 1.405465, 1.693147, 1.693147, 1.693147], abs=1e-6)
    assert [r.logp0 for r in rows] == pytest.approx([-1.721554, -1.208326, -1.780233, -1.389562, -2.256354], abs=1e-6)
    assert [r.logp1 for r in rows] == pytest.approx([-1.332953, -2.096053, -1.619931, -2.096053, -1.229261], abs=1e-6)


def test_nb_model_of_many_terms_joins_by_term(spark, nb, monkeypatch):
    df = spark.createDataFrame([(1, "verify account"), (2, "team meeting"), (3, None)], "id int, text string")
    near = [r.p_nb for r in textmodel.predict_nb(nb, df).orderBy("id").collect()]
    monkeypatch.setattr(textmodel, "BROADCAST_TERMS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        far = textmodel.predict_nb(nb, df)
        assert "SortMergeJoin" in far._jdf.queryExecution().executedPlan().toString()
        assert [r.p_nb for r in far.orderBy("id").collect()] == pytest.approx(near)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_tokenized_once_per_plan(spark):
    """No filter repeats the tokenizer below the projection that holds its result."""
    counted = textmodel.with_counts(textmodel.tokenize(spark.range(3).selectExpr("id", "'a b ' || id AS text")))
    plan = textmodel.term_counts(counted).filter("df > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("array_sort") == 1


def test_nb_golden_probabilities_survive_saving(spark, nb, tmp_path):
    asked = ["verify account", "team meeting", "hello", "now", None]
    expected = [0.653177, 0.180041, 0.4, 0.439014, 0.4]
    df = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    writers.save_nb(spark, nb, str(tmp_path / "nb"))
    for model in (nb, writers.load_nb(spark, str(tmp_path / "nb"))):
        got = [r.p_nb for r in textmodel.predict_nb(model, df).orderBy("id").collect()]
        assert got == pytest.approx(expected, abs=1e-6)


def test_top_terms(spark, nb):
    rows = textmodel.top_terms(spark, nb, 2).collect()
    assert [(r.side, r.term) for r in rows] == [
        ("phishing", "verify"), ("phishing", "account"), ("legitimate", "meeting"), ("legitimate", "team"),
    ]
    assert textmodel.top_terms(spark, nb, 99).count() == 10


def test_explanations_sum_to_the_margin(spark, nb):
    df = spark.createDataFrame([(1, "verify account now verify")], "id int, text string")
    parts = textmodel.explain_nb(nb, df, k=10).collect()
    assert {r.term for r in parts} == {"verify", "account", "now"}
    p = textmodel.predict_nb(nb, df).head().p_nb
    margin = sum(r.contribution for r in parts) + math.log(2 / 3)
    assert math.log(p / (1 - p)) == pytest.approx(margin)


def test_bigrams_bridge_stop_words_and_accents_fold(spark):
    df = spark.createDataFrame([("Vérify the Account́ a",), ("x",), (None,)], "text string")
    got = [r.tokens for r in textmodel.tokenize(df).collect()]
    assert got == [["verify", "account", "verify account"], [], []]


def test_vocabulary_limit_takes_the_most_frequent(spark):
    df = spark.createDataFrame([("aa aa bb cc",), ("aa bb cc dd",)], "text string")
    tokens = textmodel.tokenize(df, ngram_range=(1, 1), stop_words=[])
    assert {r.term for r in textmodel.vocabulary(tokens, 2, 1).collect()} == {"aa", "bb"}
    assert textmodel.vocabulary(tokens, 9, 1).count() == 4
    assert textmodel.vocabulary(tokens, 9, 3).count() == 0


def test_sampling_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(1000).selectExpr("id", "id % 3 AS label").mapInPandas(counted, "id long, label long")
    assert sampling.cap_per_class(df, 50).count() == 150
    assert seen.value == 1000
    assert sampling.assign_split(df, stratify="label").groupBy("split").count().count() == 3
    assert seen.value == 2000


@pytest.mark.parametrize(
    "mode, weights, second, nb_p, expected",
    [("soft", (0.7, 0.3), 0.8, 0.6, 0.7), ("weighted", (0.7, 0.3), 1.0, 0.0, 0.7), ("weighted", (0.7, 0.3), 0.0, 1.0, 0.3),
     ("weighted", (0.5, 0.5), 0.8, 0.4, 0.6), ("weighted", (7, 3), 1.0, 1.0, 1.0), ("weighted", (0.7, 0.3), 0.0, 0.0, 0.0)],
)
def test_ensemble(spark, mode, weights, second, nb_p, expected):
    col = scoring.combine_probs(F.lit(second), F.lit(nb_p), mode, weights)
    assert spark.range(1).select(col.alias("p")).head().p == pytest.approx(expected)


def test_ensemble_errors(spark):
    with pytest.raises(ValueError, match="positive"):
        scoring.combine_probs(F.lit(0.5), F.lit(0.5), "weighted", (0.0, 0.0))
    a = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id int, p double")
    with pytest.raises(Exception, match="Shape mismatch"):
        ensemble.combine_tables(a, a.filter("id = 1")).collect()


def test_labels(spark):
    assert values(spark, scoring.binary_name, [0.2, 0.5, 0.6, 0.61, 0.9], "double") == ["Legitimate"] * 3 + ["Phishing"] * 2
    assert values(spark, scoring.binary_label, [0.3, 0.5, 0.7, 0.49, 0.51], "double") == [0, 1, 1, 0, 1]
    assert values(spark, lambda c: scoring.binary_label(c, 0.6), [0.3, 0.5, 0.7], "double") == [0, 0, 1]


def judged(spark, y, pred, p):
    return spark.createDataFrame(list(zip(y, pred, p)), "label int, pred int, p double")


def test_metrics_perfect_and_wrong(spark):
    df = judged(spark, [0, 0, 1, 1], [0, 0, 1, 1], [0.1, 0.2, 0.9, 0.8])
    assert tuple(metrics.binary_metrics(df).head()) == (1.0, 1.0, 1.0, 1.0)
    assert metrics.roc_auc(df).head().roc_auc == 1.0
    df = judged(spark, [0, 0, 1, 1], [1, 1, 0, 0], [0.9, 0.8, 0.1, 0.2])
    assert tuple(metrics.binary_metrics(df).head()) == (0.0, 0.0, 0.0, 0.0)
    assert metrics.roc_auc(df).head().roc_auc == 0.0


def test_confusion_and_report(spark):
    df = judged(spark, [0, 1, 0, 1], [0, 1, 1, 0], [0.2, 0.8, 0.6, 0.4])
    assert [tuple(r) for r in metrics.confusion(df).collect()] == [(0, 1, 1), (1, 1, 1)]
    rows = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert set(rows) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rows["1"].support == 2 and rows["accuracy"].f1 == 0.5


def test_auc_with_ties_skew_and_one_class(spark):
    y = [1, 0, 1, 0, 1, 0, 0, 1, 1, 0] * 30
    p = [0.5, 0.5, 0.7, 0.1, 0.5, 0.9, 0.5, 0.2, 0.5, 0.3] * 30
    pairs = [(a, b) for a, u in zip(p, y) if u for b, v in zip(p, y) if not v]
    expected = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    df = judged(spark, y, y, p)
    for buckets in (2, 256):
        assert metrics.roc_auc(df, buckets=buckets).head().roc_auc == pytest.approx(expected)
    assert math.isnan(metrics.roc_auc(df.filter("label = 1")).head().roc_auc)


@pytest.mark.parametrize("scale, shift", [(1e6, -4e5), (1e-7, 0.3), (1.0, 0.0)])
def test_auc_wherever_the_scores_lie(spark, scale, shift):
    rng = random.Random(5)
    y = [rng.random() < 0.4 for _ in range(3000)]
    p = [(rng.random() + 0.3 * u) ** 3 * scale + shift for u in y]
    order = sorted(range(len(y)), key=lambda i: p[i])
    places = sum(k + 1 for k, i in enumerate(order) if y[i])
    n = sum(y)
    expected = (places - n * (n + 1) / 2) / (n * (len(y) - n))
    df = judged(spark, [int(u) for u in y], [int(u) for u in y], p).withColumn("model", F.lit("a"))
    both = df.unionAll(df.withColumns({"model": F.lit("b"), "p": F.col("p") * 1000}))
    for row in metrics.roc_auc(both, by=["model"], buckets=16).collect():
        assert row.roc_auc == pytest.approx(expected)
    tied = both.select("model", F.col("p").alias("s"))
    sizes = [r["count"] for r in metrics.in_ranges(tied, ["model"], 16).groupBy("bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / 16


def test_trees_learn_and_tolerate_absent_columns(spark):
    df = spark.range(200).select(
        (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 2 == 1, 5.0).otherwise(1.0).alias("a"),
        F.when(F.col("id") % 5 != 0, 1.0).alias("b"),
    )
    forest = trees.fit_forest(df, ["a", "b"], trees=5, depth=3, fill=-1)
    scored = trees.predict_trees(df, forest, fill=-1)
    assert scored.filter("prediction = label").count() == 200
    assert trees.importances(spark, forest).head().feature == "a"
    median = trees.fit_forest(df, ["a", "b"], trees=5, depth=3, fill="median")
    assert trees.feature_names(median) == ["a", "b"]


def test_corpus_reader_order_and_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"one, ""two""\nline",spam\nx,ham\n')
    (tmp_path / "b.csv").write_text("body,other\nx,1\n")
    with pytest.raises(ValueError):
        readers.read_text_corpus(spark, [{"path": str(tmp_path / "b.csv")}])
    specs = [{"path": str(tmp_path / "a.csv"), "multi_line": True}, {"path": str(tmp_path / "b.csv"), "default_label": 1}]
    df = readers.read_text_corpus(spark, specs)
    assert sorted((r.text, r.label) for r in df.collect()) == [('one, "two"\nline', 1), ("x", 0), ("x", 1)]
    first = corpus.dedupe_first(df, "text", ["src_ord", "path", "row_ord"])
    assert {r.text: r.label for r in first.collect()}["x"] == 0


def test_arff_header_ends_at_data(spark, tmp_path):
    (tmp_path / "x.arff").write_text("@relation r\n@attribute a numeric\n@attribute Result {-1,1}\n@DATA\n1,-1\n@attribute late numeric\n2,1\n")
    got = readers.read_arff(spark, str(tmp_path / "x.arff")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1), (2.0, 0)]


def test_one_probability_per_key(spark):
    probs = spark.createDataFrame([(1, 0.2, None), (1, 0.4, 0.5), (1, 0.4, 0.3), (2, None, None)], "id int, p_second double, p_nb double")
    got = {r.id: (r.p_second, r.p_nb) for r in ensemble.one_probability(probs, "id", "p_second", "p_nb").collect()}
    assert got == {1: (0.4, 0.5), 2: (None, None)}
    texts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, text string")
    twice = probs.select("id", F.col("p_second").alias("p"))
    assert {(r.id, r.p_second) for r in ensemble.with_second_model(texts, twice).collect()} == {(1, 0.4), (2, None), (3, None)}


def test_mail_corpus(spark):
    rows = [("b.eml", "Hello \n team", 1), ("c.eml", " Hello team ", 0), ("a.eml", "Hello team", 0), ("d.eml", " \t ", 1), ("e.eml", None, 0)]
    rows += [(f"f{i:03}.eml", f"mail {i}", i % 2) for i in range(99)]
    built = build_mail_corpus(spark.createDataFrame(rows, "path string, text string, label int"))
    got = {r.path: r for r in built.collect()}
    assert len(got) == 100 and got["a.eml"].text == "Hello team" and got["a.eml"].label == 0
    sizes = {r["split"]: r["count"] for r in built.groupBy("split").count().collect()}
    assert sizes == {"train": 70, "val": 15, "test": 15}
    assert build_mail_corpus(spark.createDataFrame(rows, "path string, text string, label int"), 10).count() <= 20
