"""Stream state against a plain replay of every url's events, over any cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from riskspark.functions.staging import Scratch
from riskspark.streaming import navigation, slots, state
from test_history import minute, stream_of

ALLOW, CACHE = 5 * 60_000_000, 10 * 60_000_000
SCHEMA = "id long, url string, kind string, ts timestamp"


def replay(events, auto_scan=True):
    """{id: source} of (id, url, kind, at) events, one url after the other and in order."""
    out = {}
    for url in {e[1] for e in events}:
        is_open, timers, due = False, [], None
        for i, _, kind, at in sorted((e for e in events if e[1] == url), key=lambda e: (e[3], e[2], e[0])):
            while timers and timers[0] <= at:
                timers.pop(0)
                is_open = False
            if kind == "allow":
                is_open = True
                timers.append(at + ALLOW)
                continue
            if is_open:
                out[i], is_open = "allowed", False
            elif not auto_scan:
                out[i] = "off"
            elif due is None or at >= due:
                out[i], due = "scan", at + CACHE
            else:
                out[i] = "cached"
    return out


def events_of(seed, n, urls, minutes):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 1, 1_000_000, int(minutes * 60_000_000)])
        # A third of the events, and more, are of one url.
        url = "http://hot.com/" if rng.random() < 0.4 else f"http://u{rng.randrange(urls)}.com/"
        rows.append((i, url, "allow" if rng.random() < 0.3 else "nav", at))
    return rows


def as_rows(events):
    base = minute(0)
    return [(i, u, k, base + (minute(1) - base) * (at / 60_000_000)) for i, u, k, at in events]


@pytest.mark.parametrize("batches, minutes", [(1, 0.7), (4, 4)])
def test_job_against_replay(spark, tmp_path, monkeypatch, batches, minutes):
    monkeypatch.setattr(state, "SNAPSHOT", 2)  # several snapshots and removals
    events = events_of(batches, 300, 4, minutes)
    base = 1_704_067_200_000_000
    exact = [(i, u, k, base + at) for i, u, k, at in events]
    raw = [(i, u, k, at) for i, u, k, at in exact]
    folder = str(tmp_path / "in")
    for b in range(batches):
        part = raw[b * len(raw) // batches : (b + 1) * len(raw) // batches]
        df = spark.createDataFrame(part, "id long, url string, kind string, at long")
        df.select("id", "url", "kind", F.timestamp_micros("at").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    # Files of one second may come in any order: the batches are read from the folder in order of time.
    out = str(tmp_path / "job")
    navigation.navigation_job(stream, out, str(tmp_path / "state")).awaitTermination()
    got = {r.id: r.source for r in spark.read.parquet(f"{out}/decided").collect()}
    assert got == replay(exact)
    assert {"scan", "cached", "allowed"} <= set(got.values())


@pytest.mark.parametrize("hot", [5, 60, 10**6])
def test_hot_and_whole_urls_against_replay(spark, tmp_path, monkeypatch, hot):
    """Urls in slots and urls that are one slot give the same decisions, also with several events at one time."""
    monkeypatch.setattr(slots, "HOT", hot)
    base = 1_704_067_200_000_000
    rows = [(i, u, k, base + at) for i, u, k, at in events_of(hot, 400, 6, 1.5)]
    rows += [(1000 + i, u, "nav", at) for i, u, k, at in rows[::9]]
    folder = str(tmp_path / "in")
    for part in (rows[:150] + rows[400:420], rows[150:400] + rows[420:]):
        df = spark.createDataFrame(part, "id long, url string, kind string, at long")
        df.select("id", "url", "kind", F.timestamp_micros("at").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    out = str(tmp_path / "job")
    navigation.navigation_job(stream, out, str(tmp_path / "state")).awaitTermination()
    got = [(r.id, r.source) for r in spark.read.parquet(f"{out}/decided").collect()]
    assert len(got) == len(dict(got)) and dict(got) == replay(rows)


def test_events_without_a_time(spark, tmp_path):
    """They decide nothing, and neither open a url nor are scanned."""
    events = [
        (1, "http://u.com/", "nav", None), (2, "http://u.com/", "allow", None), (3, "http://v.com/", "nav", None),
        (4, "http://u.com/", "nav", minute(0)), (5, "http://w.com/", "nav", minute(0)), (6, "http://u.com/", "nav", minute(1)),
    ]
    stream = stream_of(spark, tmp_path, events, SCHEMA, 1)
    navigation.navigation_job(stream, str(tmp_path / "job"), str(tmp_path / "s1")).awaitTermination()
    got = {r.id: r.source for r in spark.read.parquet(str(tmp_path / "job/decided")).collect()}
    assert got == {4: "scan", 5: "scan", 6: "cached"}
    navigation.cache_stream(stream.select("url", "ts"), str(tmp_path / "due"), str(tmp_path / "s2")).awaitTermination()
    due = spark.read.parquet(str(tmp_path / "due/due")).collect()
    assert sorted((r.url, r.ts is None) for r in due) == [("http://u.com/", False), ("http://w.com/", False)]


def counted(monkeypatch):
    """Rows of each table that is staged, by name."""
    seen, plain = [], Scratch.stage

    def stage(self, df, name):
        out = plain(self, df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(Scratch, "stage", stage)
    return seen


def test_rounds_get_smaller(spark, monkeypatch):
    """What no chain can reach is dropped from round to round, and times without a neighbour never take part."""
    rng = random.Random(1)
    dense = [("a", rng.randrange(200_000)) for _ in range(4_000)]
    sparse = [(f"u{i}", t * 10_000) for i in range(400) for t in range(5)]
    seen = counted(monkeypatch)
    none = spark.createDataFrame([], "url string, due long")
    with Scratch(spark) as scratch:
        found = slots.chained(micros(spark, dense + sparse), none, 1_000, scratch, slots.hot_urls(micros(spark, dense))).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} >= set(sparse)
    nodes = [n for name, n in seen if name == "nodes"]
    assert nodes[0] < 4_000 and nodes[3] < nodes[0] / 2 and sum(nodes) < 5 * nodes[0]


def test_only_hot_urls_meet_as_slots(spark, monkeypatch):
    """Slots get longer with a hot url's time, but stay below its lifetime; other urls are one slot each."""
    monkeypatch.setattr(slots, "HOT", 100)
    rows = [("hot", i * 60_000_000) for i in range(5_000)] + [(f"u{i % 50}", i * 60_000_000) for i in range(2_000)]
    times, length = micros(spark, rows), CACHE // slots.SLOTS
    hot = slots.hot_urls(times)
    assert [tuple(r) for r in hot.collect()] == [("hot", 4_999 * 60_000_000)]
    groups = {r.url: (r.n, r.most) for r in slots.dealt(times, "at", length, hot).groupBy("url", "_slot").count()
              .groupBy("url").agg(F.count("*").alias("n"), F.max("count").alias("most")).collect()}
    assert groups.pop("hot")[0] > 1_000 and set(groups.values()) == {(1, 40)}


def test_history_scores_a_url_once(spark, tmp_path, monkeypatch):
    """Many scans of one url share one scored row of their batch."""
    asked = []
    plain = navigation.score_urls
    monkeypatch.setattr(navigation, "score_urls", lambda df, **more: asked.append(df.count()) or plain(df, **more))
    events = [(i, "http://g00gle-account.tk/verify?redirect=1", "nav", minute(11 * i)) for i in range(30)]
    events += [(50, "https://www.google.com/", "nav", minute(3)), (51, "http://h:abc/", "nav", minute(4))]
    stream = stream_of(spark, tmp_path, events, SCHEMA, 1)
    navigation.scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out/history")).groupBy("verdict", "risk_score").count().collect()
    assert {tuple(r) for r in stored} == {("PHISHING", 84.0, 30), ("SAFE", 0.0, 1), ("ERROR", 0.0, 1)}
    assert asked == [3]


def micros(spark, rows):
    return spark.createDataFrame(rows, "url string, at long")


def test_chain_against_search(spark):
    rng = random.Random(3)
    rows = [(u, rng.randrange(10**4)) for u in "aab" for _ in range(150)] + [("c", 5), ("d", 7)]
    due = [("a", 700), ("c", 6), ("d", 7), ("e", 1)]
    for span in (1, 64, 700, 10**6):
        want = set()
        for u in "abcd":
            nxt = dict(due).get(u, 0)
            for at in sorted({t for v, t in rows if v == u}):
                if at >= nxt:
                    want.add((u, at))
                    nxt = at + span
        with Scratch(spark) as scratch:
            found = slots.chained(micros(spark, rows), spark.createDataFrame(due, "url string, due long"), span, scratch).collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_hot_url_spreads(spark):
    """The times of one url are dealt by (url, slot), and only slots meet by url."""
    times = micros(spark, [("hot", i * 1_000_000) for i in range(5_000)])
    length = CACHE // slots.SLOTS
    asked = times.select("url", (F.col("at") + CACHE).alias("x"))
    found = slots.first_from(asked, times, length)
    assert found.filter("found IS NOT NULL").count() == 4_400
    groups = times.groupBy("url", slots.slot_of("at", length)).count()
    assert groups.count() > 500 and groups.agg(F.max("count")).first()[0] < 20


def test_odd_events(spark, tmp_path):
    """Repeated times, navigations without a url, and empty slots between."""
    events = [
        (1, "u", "nav", minute(0)), (2, "u", "nav", minute(0)), (3, None, "nav", minute(0)), (4, "u", "allow", minute(0)),
        (5, "u", "nav", minute(500)), (6, "", "nav", minute(1)),
    ]
    stream = stream_of(spark, tmp_path, events, SCHEMA, 1)
    out = str(tmp_path / "out")
    navigation.permission_stream(stream, out, str(tmp_path / "s1")).awaitTermination()
    got = {r.id: r.allowed for r in spark.read.parquet(f"{out}/allowed").collect()}
    assert got == {1: True, 2: False, 3: False, 5: False, 6: False}
    navigation.cache_stream(stream.select("url", "ts"), out, str(tmp_path / "s2")).awaitTermination()
    due = spark.read.parquet(f"{out}/due").collect()
    assert sorted((r.url, r.ts.hour) for r in due) == [("", 0), ("u", 0), ("u", 8)]


def test_state_lives_and_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SNAPSHOT", 1)
    path, far = str(tmp_path / "s"), 10**12

    def changed(at):
        rows = [("u", "due", at + 10, None), ("u", "last", at, True), ("u", "timer", at, None), (None, "clock", at, None)]
        return spark.createDataFrame(rows, state.FIELDS)

    state.StateTable(spark, path, 0).write(changed(100), 50, 20)
    now = state.StateTable(spark, path, 1)
    assert now.due().first().due == 110 and now.timers().count() == 1 and now.last().first().open
    now.write(spark.createDataFrame([("v", "due", far, None), (None, "clock", far, None)], state.FIELDS), 50, 20)
    after = state.StateTable(spark, path, 2)
    assert [r.url for r in after.due().collect()] == ["v"] and not after.timers().count() and not after.last().count()
