"""Navigation stream: filter, allow-list, result cache, scoring, history sink.

Permissions and the cache are worked out per micro-batch with joins and windows over slots of time,
with what they need from earlier batches in a small table. All steps are DataFrame functions, and a url
that holds a third of the stream spreads over tasks by its times.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskspark.functions.staging import Scratch, remove
from riskspark.operators import scans as scan_ops
from riskspark.plans.scans import score_urls
from riskspark.sources.writers import write_history
from riskspark.streaming.slots import SLOTS, chained, first_from, hot_urls, with_previous
from riskspark.streaming.state import StateTable

# Lifetimes of a cached result and of a permission, and own addresses.
CACHE_SECONDS = 10 * 60
ALLOW_SECONDS = 5 * 60
SERVICE = "http://localhost:5000"
LOCAL_NAMES = ["localhost", "127.0.0.1"]
ALLOWED_BADGE = "⚠"
#: State outlives its lifetime by so much event time, for events that come late.
LATE_SECONDS = 60 * 60


def scannable(df: DataFrame, col: str = "url", service: str = SERVICE) -> DataFrame:
    """Only http and https pages that belong neither to the service nor to this machine."""
    url = F.col(col)
    web = url.startswith("http://") | url.startswith("https://")
    local = url.startswith(service)
    for name in LOCAL_NAMES:
        local = local | url.contains(name)
    return df.filter(url.isNotNull() & web & ~local)


def first_per_window(
    nav: DataFrame, state: StateTable, scratch: Scratch, ttl: int = CACHE_SECONDS, hot: DataFrame | None = None, unique: bool = False
) -> DataFrame:
    """(url, at) of the navigations (url, at) of one batch that need a scan: the first per url, then the
    first at or after `ttl` seconds from the scan before, in this or an earlier batch. A cached result
    does not slide.

    The batch's times are put in order, of whatever url and slot; what arrives after a later scan is cached.
    `hot` holds the urls that are spread over slots (by default those of `nav`); `unique` tells that the rows are distinct.
    """
    nav = nav.filter("url IS NOT NULL")
    hot = scratch.stage(hot_urls(nav), "hot") if hot is None else hot
    return chained(nav, state.due(), ttl * 1_000_000, scratch, hot, unique)


def allow_once(
    events: DataFrame, state: StateTable, scratch: Scratch, ttl: int = ALLOW_SECONDS, hot: DataFrame | None = None
) -> DataFrame:
    """(url, at, first, navs, last_open, allowed) per url and time of one batch of `nav` and `allow` events
    (id, url, at, kind): the smallest navigation id, the number of navigations, whether a permission is the
    time's last event, and whether its first navigation is allowed. No other navigation of one time can be.

    Allowing a url opens it for `ttl` seconds or until its next navigation, which uses the permission up.
    Every allowance starts a timer that closes the url when it fires, even if it was allowed anew
    meanwhile. At one time permissions come first, then navigations by id. `hot` holds the urls that are
    spread over slots, by default those of the batch and its running timers.
    """
    span = ttl * 1_000_000
    length = max(span // SLOTS, 1)
    is_nav = F.col("kind") == "nav"
    # One row per url and time, summed map-side: a hot url moves as its distinct times.
    per = events.filter("url IS NOT NULL").groupBy("url", "at").agg(
        F.min(F.when(is_nav, F.col("id"))).alias("first"), F.count(F.when(is_nav, 1)).alias("navs"),
        F.max(F.col("kind") == "allow").alias("allows"),
    )
    per = scratch.stage(per.withColumn("last_open", F.col("navs") == 0), "events")
    hot = scratch.stage(hot_urls(per, state.timers()), "hot") if hot is None else hot
    known = state.last().select("url", F.struct("at", F.col("open").alias("last_open")).alias("known"))
    known = scratch.stage(known, "known")
    told = with_previous(per, "last_open", length, hot).join(known, "url", "left")
    before = F.coalesce("before", "known")
    told = told.withColumn("opened", F.when(F.col("allows"), F.col("at")).when(before["last_open"], before["at"]))
    told = scratch.stage(told.drop("before", "known", "ahead", "last"), "opened")
    # The earliest timer that is still running when the permission is given closes the url.
    allows = scratch.stage(per.filter("allows").select("url", "at").union(state.timers()).distinct(), "allows")
    # Where no permission was given nothing is looked up, and nothing moves.
    given = told.filter("navs > 0 AND opened IS NOT NULL")
    asked = given.select("url", (F.col("opened") - (span - 1)).alias("x"))
    running = first_from(asked.distinct(), allows, length, hot)
    running = running.select("url", (F.col("x") + (span - 1)).alias("opened"), F.col("found").alias("timer"))
    open_still = (F.col("timer") <= F.col("opened")) & (F.col("timer") + span > F.col("at"))
    judged = given.join(running, ["opened", "url"], "left").withColumn("allowed", F.coalesce(open_still, F.lit(False)))
    judged = judged.unionByName(told.filter("navs = 0 OR opened IS NULL").withColumn("allowed", F.lit(False)), allowMissingColumns=True)
    return judged.select("url", "at", "first", "navs", "last_open", "allowed")


def decisions(
    events: DataFrame, state: StateTable, scratch: Scratch, auto_scan: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(decided, changed): what decides each navigation of one batch of `nav` and `allow` events
    (id, url, at, kind), as (id, url, at, source), and the rows of state that it changes.

    `source` is, in this order: `allowed` by a permission, which it uses up; `off` without automatic
    scanning; `cached` while the url's last scan lives; else `scan`. Of navigations at one time the
    smallest id scans.
    """
    hot = scratch.stage(hot_urls(events.filter("url IS NOT NULL"), state.timers()), "hot")
    per = scratch.stage(allow_once(events, state, scratch, hot=hot), "permitted")
    nav = events.filter("kind = 'nav' AND url IS NOT NULL").select("id", "url", "at")
    left_over = per.filter(F.col("navs") > F.col("allowed").cast("int"))
    left_over = left_over.select("url", "at")
    scans = first_per_window(left_over, state, scratch, hot=hot, unique=True) if auto_scan else left_over.limit(0)
    scans = scratch.stage(scans, "scans")
    # Times differ where addresses begin alike: rows are sorted by time first.
    told = per.filter("navs > 0").join(scans.withColumn("scans", F.lit(True)), ["at", "url"], "left")
    told = told.select("url", "at", "first", "navs", "allowed", F.coalesce("scans", F.lit(False)).alias("scans"))
    told = scratch.stage(told, "told")

    def source(allowed, scans):
        return F.when(allowed, "allowed").when(F.lit(not auto_scan), "off").when(scans, "scan").otherwise("cached").alias("source")

    # The only navigation of its time is decided as its time is; others meet their time.
    lone = (F.col("navs") == 1) & F.col("first").isNotNull()
    decided = told.filter(lone).select(F.col("first").alias("id"), "url", "at", source(F.col("allowed"), F.col("scans")))
    told = scratch.stage(told.filter(~lone), "several")
    # Where the first navigation of a time is allowed, the second one scans.
    both = told.filter("allowed AND scans").select("url", "at", "first")
    second = nav.join(both, ["at", "url"]).filter("id > first").groupBy("url", "at").agg(F.min("id").alias("second"))
    told = scratch.stage(told.join(second, ["at", "url"], "left"), "several")
    scanner = F.when(F.col("scans"), F.when(F.col("allowed"), F.col("second")).otherwise(F.col("first")))
    several = source(F.col("allowed") & (F.col("id") == F.col("first")), F.col("id") == scanner)
    decided = decided.union(nav.join(told, ["at", "url"]).select("id", "url", "at", several))
    return decided, changes(events, per, scans)


def changes(events: DataFrame, per: DataFrame | None, scans: DataFrame | None) -> DataFrame:
    """The rows of state that a batch changes, from its judged times and its scans."""
    none = F.lit(None).cast("boolean")
    clock = events.agg(F.max("at").alias("at")).filter("at IS NOT NULL")
    out = clock.select(F.lit(None).cast("string").alias("url"), F.lit("clock").alias("what"), "at", none.alias("open"))
    if scans is not None:
        due = scans.groupBy("url").agg(F.max("at").alias("at"))
        out = out.union(due.select("url", F.lit("due"), F.col("at") + CACHE_SECONDS * 1_000_000, none))
    if per is not None:
        last = per.groupBy("url").agg(F.max(F.struct("at", "last_open")).alias("s"))
        out = out.union(last.select("url", F.lit("last"), "s.at", "s.last_open"))
        timers = events.filter("kind = 'allow' AND url IS NOT NULL").select("url", "at").distinct()
        out = out.union(timers.select("url", F.lit("timer"), "at", none))
    return out


def each_batch(stream: DataFrame, checkpoint: str, write) -> StreamingQuery:
    """Run `write(batch, number)` on all that is there."""
    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _timed(batch: DataFrame) -> DataFrame:
    """With `at`, the time in microseconds, which is free of time zones."""
    return batch.withColumn("at", F.unix_micros("ts")).drop("ts")


def _kept(df: DataFrame, path: str, number: int) -> DataFrame:
    """`df` written to the folder of its batch, which a repeated batch replaces."""
    target = f"{path}/batch={number}"
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def cache_stream(nav: DataFrame, path: str, checkpoint: str, late: int = LATE_SECONDS, then=None) -> StreamingQuery:
    """Write (url, ts) of the navigations of a stream (url, ts) that need a scan below `path`/due.

    State is below `path`/state. `then(due, number)` gets the written scans of each batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        state = StateTable(batch.sparkSession, f"{path}/state", number)
        with Scratch(batch.sparkSession) as scratch:
            events = scratch.stage(_timed(batch.select("url", "ts")).distinct(), "nav")
            scans = scratch.stage(first_per_window(events, state, scratch, unique=True), "scans")
            due = _kept(scans.select("url", F.timestamp_micros("at").alias("ts")), f"{path}/due", number)
            if then:
                then(due, number)
            state.write(changes(events, None, scans), 0, late * 1_000_000)

    return each_batch(nav, checkpoint, write)


def permission_stream(events: DataFrame, path: str, checkpoint: str, late: int = LATE_SECONDS) -> StreamingQuery:
    """Write (id, url, ts, allowed) of each navigation of a stream of `nav` and `allow` events below
    `path`/allowed; state is below `path`/state. Navigations without a url are not allowed."""

    def write(batch: DataFrame, number: int) -> None:
        state = StateTable(batch.sparkSession, f"{path}/state", number)
        with Scratch(batch.sparkSession) as scratch:
            rows = scratch.stage(_timed(batch.select("id", "url", "kind", "ts")), "events")
            per = scratch.stage(allow_once(rows, state, scratch), "permitted")
            told = rows.filter("kind = 'nav'").join(per.select("url", "at", "first", "allowed"), ["at", "url"], "left")
            allowed = F.coalesce(F.col("allowed") & (F.col("id") == F.col("first")), F.lit(False))
            _kept(told.select("id", "url", F.timestamp_micros("at").alias("ts"), allowed.alias("allowed")), f"{path}/allowed", number)
            state.write(changes(rows, per, None), ALLOW_SECONDS * 1_000_000, late * 1_000_000)

    return each_batch(events, checkpoint, write)


def score_batch(nav: DataFrame, **options) -> DataFrame:
    """Score each url of one batch once and give the result to all its navigations.

    The navigations of a hot url join the single scored row; adaptive execution splits
    such a join partition.
    """
    urls = nav.select("url").distinct().withColumn("id", F.xxhash64("url"))
    scored = score_urls(urls, **options).select("url", "risk_score", "verdict")
    return nav.join(scored, "url", "left")


def score_stream(nav: DataFrame, auto_scan: bool = True, **options) -> DataFrame:
    """Add risk_score, verdict and action to navigations (id, url, ts), batch or stream.

    Without automatic scanning everything is allowed. A url that cannot be scored is
    allowed with the badge `!`.
    """
    if not auto_scan:
        return nav.withColumns(
            {
                "risk_score": F.lit(None).cast("double"),
                "verdict": F.lit(None).cast("string"),
                "action": F.lit("allow"),
                "badge": F.lit(""),
            }
        )
    return with_action(_scored(nav, **options))


def with_action(scored: DataFrame) -> DataFrame:
    """Add action and badge; a url that cannot be scored is allowed with the badge `!`."""
    scored = scan_ops.action_policy(scored)
    failed = F.col("verdict") == "ERROR"
    return scored.withColumn("action", F.when(failed, "allow").otherwise(F.col("action"))).withColumn(
        "badge", F.when(failed, "!").otherwise(F.col("risk_score").cast("string"))
    )


def _scored(nav: DataFrame, **options) -> DataFrame:
    others = [c for c in nav.columns if c not in ("id", "url")]
    packed = nav.withColumn("_nav", F.struct("id", *others)).withColumn("id", F.col("_nav"))
    scored = score_urls(packed, **options)
    return scored.select(
        "id.id", "url", *[f"id.{c}" for c in others], "risk_score", "verdict", "scan_summary", "details"
    )


def sink_counts(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of scans per verdict up to date: `path`/batch=N after batch N, the one before is removed."""

    def write(batch: DataFrame, number: int) -> None:
        _kept(batch, path, number)
        # The one before stays until this one is whole.
        remove(batch.sparkSession, f"{path}/batch={number - 1}")

    counts = scored.groupBy("verdict").agg(F.count("*").alias("n"))
    return (
        counts.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def scan_stream(nav: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Cache, score and store a navigation stream: `path`/history holds the scans, as one run per batch.

    The scans of one url in a batch share its score. External answers (`llm`) belong to single scans, which are then scored one by one.
    """

    def score(due: DataFrame, number: int) -> None:
        due = due.withColumn("id", F.xxhash64("url", "ts"))
        if options.get("llm") is not None:
            scored = _scored(due, **options)
        else:
            urls = due.select("url").distinct().withColumn("id", F.xxhash64("url"))
            scored = score_urls(urls, **options).select("url", "risk_score", "verdict", "scan_summary", "details")
            scored = due.join(scored, "url")
        scans = scored.withColumns({"scan_type": F.lit("url"), "created_at": F.col("ts")})
        write_history(scans, f"{path}/history", f"batch-{number}")

    return cache_stream(scannable(nav), path, checkpoint, then=score)


def navigation_job(
    events: DataFrame, path: str, checkpoint: str, auto_scan: bool = True, late: int = LATE_SECONDS, **options
) -> StreamingQuery:
    """Everything a navigation needs, from a stream (id, url, ts, kind) of `nav` and `allow` events.

    Scannable pages only; then permission, switch, cache, scan, action. Below `path`, with a folder
    per batch number that a repeated batch replaces: `decided` (what decides each navigation),
    `scored` (each url of the batch once), `actions` (id, url, ts, source, risk_score, verdict,
    action, badge); `history` holds the scans made, as one run per batch number; `state` is kept
    from batch to batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = StateTable(spark, f"{path}/state", number)
        with Scratch(spark) as scratch:
            rows = scratch.stage(_timed(batch.select("id", "url", "kind", "ts")), "events")
            decided, changed = decisions(rows, state, scratch, auto_scan)
            decided = decided.select("id", "url", F.timestamp_micros("at").alias("ts"), "source")
            decided = _kept(decided, f"{path}/decided", number)
            act(decided, number)
            state.write(changed, ALLOW_SECONDS * 1_000_000, late * 1_000_000)

    def act(decided: DataFrame, number: int) -> None:
        asked = decided.filter(F.col("source").isin("scan", "cached")).select("url").distinct()
        scored = score_urls(asked.withColumn("id", F.xxhash64("url")), **options)
        scored = _kept(scored.select("url", "risk_score", "verdict", "scan_summary", "details"), f"{path}/scored", number)
        by_source = F.when(F.col("source") == "allowed", ALLOWED_BADGE).when(F.col("source") == "off", "")
        judged = F.col("source").isin("scan", "cached")
        acted = with_action(decided.join(scored.select("url", "risk_score", "verdict"), "url", "left"))
        acted = acted.withColumns(
            {
                "action": F.when(judged, F.col("action")).otherwise("allow"),
                "badge": F.when(judged, F.col("badge")).otherwise(by_source),
                **{c: F.when(judged, F.col(c)) for c in ("risk_score", "verdict")},
            }
        )
        _kept(acted.select("id", "url", "ts", "source", "risk_score", "verdict", "action", "badge"), f"{path}/actions", number)
        scans = decided.filter("source = 'scan'").drop("id").join(scored, "url")
        scans = scans.withColumns(
            {"id": F.xxhash64("url", "ts"), "scan_type": F.lit("url"), "created_at": F.col("ts")}
        )
        write_history(scans, f"{path}/history", f"batch-{number}")

    return each_batch(scannable(events), checkpoint, write)
