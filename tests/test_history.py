import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskspark.operators import history
from riskspark.plans.scans import score_urls
from riskspark.sources import writers
from riskspark.streaming import navigation


@pytest.fixture(scope="module")
def scans(spark):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 7) * 3000)
    verdict = F.element_at(F.array(F.lit("SAFE"), F.lit("SUSPICIOUS"), F.lit("PHISHING")), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(500).select("id", verdict.alias("verdict"), at.alias("created_at"))


def test_pages_cover_everything_once(scans):
    whole = [r.id for r in history.newest(scans).collect()]
    for page in (1, 2, 3, 13, 25, 26):
        assert [r.id for r in history.history_page(scans, page).collect()] == whole[(page - 1) * 20 : page * 20]


def test_pages_with_scans_without_a_time(spark):
    at = F.when(F.col("id") % 12 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 30))
    scans = spark.range(12_000).select("id", at.alias("created_at"))
    whole = [r.id for r in history.newest(scans).collect()]
    for page in (550, 551, 576, 600, 601):  # the last 1,000 scans have no time
        assert [r.id for r in history.history_page(scans, page).collect()] == whole[(page - 1) * 20 : page * 20]


def test_keyset_matches_offset(scans):
    third = history.history_page(scans, 3).collect()
    last = history.history_page(scans, 2).collect()[-1]
    assert history.history_after(scans, last.created_at, last.id).collect() == third


def test_stats(scans):
    assert tuple(history.stats(scans).head()) == (500, 166, 167, 167)
    assert tuple(history.page_info(scans).head()) == (500, 25)
    assert history.stats(scans.limit(0)).head().total_scans == 0


def test_history_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://" + "a" * 300 + ".com/")], "id long, url string")
    writers.append_scans(score_urls(df), str(tmp_path / "h"))
    writers.append_scans(score_urls(df), str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == 2 and back.filter("length(scan_summary) = 255").count() == 2
    record = history.to_records(back).head()
    assert record.details.checks[0].name == "Excessive URL Length"


def stream_of(spark, tmp_path, rows, schema, batches):
    """A file stream that reads one file per batch, in the order written."""
    folder = str(tmp_path / "in")
    for i in range(batches):
        part = rows[i * len(rows) // batches : (i + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def minute(m):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)


@pytest.mark.parametrize("batches", [1, 6])
def test_result_cache_does_not_slide(spark, tmp_path, batches):
    rows = [("u", minute(m)) for m in (0, 12, 19, 25, 33, 47)]
    stream = stream_of(spark, tmp_path, rows, "url string, ts timestamp", batches)
    out = str(tmp_path / "out")
    navigation.cache_stream(stream, out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(f"{out}/due").collect()
    assert sorted(r.ts.minute for r in got) == [0, 12, 25, 47]


@pytest.mark.parametrize("batches", [1, 9])
def test_permission_is_used_once_and_expires(spark, tmp_path, batches):
    events = [
        (1, "u", "nav", 0), (2, "u", "allow", 1), (3, "u", "nav", 2), (4, "u", "nav", 3),
        (5, "u", "allow", 10), (6, "u", "allow", 13), (7, "u", "nav", 16),  # the timer of minute 10 fires at 15
        (8, "u", "allow", 30), (9, "u", "nav", 36),
    ]
    rows = [(i, u, k, minute(m)) for i, u, k, m in events]
    stream = stream_of(spark, tmp_path, rows, "id long, url string, kind string, ts timestamp", batches)
    out = str(tmp_path / "out")
    navigation.permission_stream(stream, out, str(tmp_path / "state")).awaitTermination()
    got = {r.id: r.allowed for r in spark.read.parquet(f"{out}/allowed").collect()}
    assert got == {1: False, 3: True, 4: False, 7: False, 9: False}


@pytest.mark.parametrize("batches", [1, 3])
def test_navigation_job(spark, tmp_path, batches):
    events = [
        (1, "http://a.com/", "nav", 0), (2, "http://a.com/", "nav", 5), (3, "http://a.com/", "allow", 6),
        (4, "http://a.com/", "nav", 7), (5, "http://a.com/", "nav", 11), (6, "http://h:abc/", "nav", 12),
        (7, "ftp://a.com/", "nav", 13), (8, "http://a.com/", "nav", 21),
    ]
    rows = [(i, u, k, minute(m)) for i, u, k, m in events]
    stream = stream_of(spark, tmp_path, rows, "id long, url string, kind string, ts timestamp", batches)
    out = str(tmp_path / "job")
    navigation.navigation_job(stream, out, str(tmp_path / "job-state")).awaitTermination()
    got = {r.id: (r.source, r.action, r.badge) for r in spark.read.parquet(f"{out}/actions").collect()}
    assert {i: s for i, (s, _, _) in got.items()} == {1: "scan", 2: "cached", 4: "allowed", 5: "scan", 6: "scan", 8: "scan"}
    assert got[4] == ("allowed", "allow", "⚠") and got[6] == ("scan", "allow", "!") and got[2][1:] == got[1][1:]
    stored = writers.read_history(spark, f"{out}/history")
    assert stored.count() == 4 and stored.filter("verdict = 'ERROR'").count() == 1


def test_navigation_job_without_scanning(spark, tmp_path):
    rows = [(1, "http://a.com/", "nav", minute(0)), (2, "http://a.com/", "nav", minute(1))]
    stream = stream_of(spark, tmp_path, rows, "id long, url string, kind string, ts timestamp", 2)
    out = str(tmp_path / "job")
    navigation.navigation_job(stream, out, str(tmp_path / "job-state"), auto_scan=False).awaitTermination()
    got = spark.read.parquet(f"{out}/actions").collect()
    assert {(r.source, r.action, r.badge) for r in got} == {("off", "allow", "")} and len(got) == 2
    assert writers.read_history(spark, f"{out}/history").count() == 0


def test_history_skips_other_days(spark, tmp_path):
    path = str(tmp_path / "h")
    urls = spark.createDataFrame([(i, f"http://a{i}.com/", minute(i * 1440)) for i in range(5)], "id long, url string, ts timestamp")
    scans = score_urls(urls.select("id", "url")).join(urls.select("id", F.col("ts").alias("created_at")), "id")
    writers.append_scans(scans, path)
    stored = writers.read_history(spark, path)
    at = stored.filter("id = 2").head().created_at
    older = history.history_after(stored, at, 2)
    assert [r.id for r in older.collect()] == [1, 0]
    later = history.since(stored, at.strftime("%Y-%m-%d"))
    assert sorted(r.id for r in later.collect()) == [2, 3, 4]
    for df in (older, later):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "created_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_scannable_and_switch(spark):
    urls = ["http://a.com", "https://a.com", "ftp://a.com", "http://localhost:5000/x", "http://x/?127.0.0.1", None]
    nav = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    kept = navigation.scannable(nav)
    assert [r.id for r in kept.orderBy("id").collect()] == [0, 1]
    assert {r.action for r in navigation.score_stream(kept, auto_scan=False).collect()} == {"allow"}
    bad = spark.createDataFrame([(1, "http://h:abc/"), (2, "http://g00gle-account.tk/verify?redirect=1")], "id int, url string")
    rows = {r.id: (r.action, r.badge) for r in navigation.score_stream(bad).collect()}
    assert rows == {1: ("allow", "!"), 2: ("block", "84.0")}
    assert {r.id: r.verdict for r in navigation.score_batch(bad).collect()} == {1: "ERROR", 2: "PHISHING"}
