"""Null and repeated answers, odd ranks, long suffix lists, scores that are no numbers."""

import datetime as dt
import math

from pyspark.sql import functions as F

from riskspark.operators import answers, metrics
from riskspark.plans.scans import score_urls
from riskspark.sources import readers


def test_null_and_failed_answers(spark):
    rows = [(1, None, False), (2, "SCORE: 80\nVERDICT: phishing\nANALYSIS: bad", False), (3, "SCORE: 80", True), (4, "no format", None)]
    rows += [(5, "SCORE: " + "9" * 400, False)]
    df = spark.createDataFrame(rows, "id int, answer string, failed boolean")
    got = {r.id: (r.llm_success, r.llm_score, r.llm_verdict) for r in answers.parse_llm_answers(df, failed="failed").collect()}
    assert got == {1: (False, 0, "UNKNOWN"), 2: (True, 80, "PHISHING"), 3: (False, 0, "UNKNOWN"), 4: (True, 0, "UNKNOWN"), 5: (True, 100, "UNKNOWN")}


def test_null_answer_leaves_the_scan(spark):
    urls = spark.createDataFrame([(1, "https://www.google.com/")], "id int, url string")
    none = spark.createDataFrame([(1, None)], "id int, answer string")
    assert [(r.risk_score, r.verdict) for r in score_urls(urls, llm=none).collect()] == [(0.0, "SAFE")]


def test_repeated_answers_do_not_multiply(spark):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    rows = [(1, "SCORE: 10", dt.datetime(2024, 1, 2)), (1, "SCORE: 90", dt.datetime(2024, 1, 1)), (1, None, dt.datetime(2024, 1, 3))]
    got = answers.attach_llm(base, spark.createDataFrame(rows, "id int, answer string, at timestamp")).collect()
    assert sorted((r.id, r.llm_score) for r in got) == [(1, 10), (2, 0)]


def test_top_sites_keep_odd_ranks(spark, tmp_path):
    (tmp_path / "s.csv").write_text("1,a.com\nx,b.com\n,c.com\n4,d.com,extra\n5\n")
    assert sorted(r.url for r in readers.read_top_sites(spark, str(tmp_path / "s.csv")).collect()) == ["a.com", "b.com", "c.com"]


def test_suffix_list_is_whole(spark, tmp_path):
    (tmp_path / "l.dat").write_text("// head\n" + "".join(f"s{i}\n" for i in range(50_010)) + "// ===BEGIN PRIVATE DOMAINS===\nprivate\n")
    rules = readers.read_suffix_list(spark, str(tmp_path / "l.dat"))
    assert rules == [f"s{i}" for i in range(50_010)]


def test_auc_without_numbers(spark):
    rows = [(1, 0.9), (0, 0.2), (1, 0.2), (0, float("nan")), (1, None), (None, 0.5), (0, -1.0), (1, 2.0), (0, 1.0)]
    df = spark.createDataFrame(rows, "label int, p double")
    kept = [(y, s) for y, s in rows if y is not None and s is not None and not math.isnan(s)]
    pairs = [(a, b) for y, a in kept if y for z, b in kept if not z]
    want = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert abs(metrics.roc_auc(df).head().roc_auc - want) < 1e-12
    assert math.isnan(metrics.roc_auc(df.filter(F.col("label") == 1)).head().roc_auc)
