"""Searches and chains over the times of many urls, spread over slots of time.

One url may hold a third of a stream. The distinct times (microseconds) of such hot urls fall into slots
shorter than the lifetime asked about; every other url is one slot. What concerns the times of a slot is a
window over (url, slot), so a hot url spreads over as many groups as it has slots; only one row per slot
of the hot urls meets in a window over the url. Rows move and sort by a hash of url and slot before the url
itself, as most addresses begin alike.
"""

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from riskspark.functions.staging import Scratch

SLOTS = 64  # per lifetime
#: A url with more rows in a batch is hot.
HOT = 50_000
#: Slots that a hot url's times should fall into: longer ones for a long backlog, up to `LONGEST` times as long.
HOT_SLOTS, LONGEST = 4096, 16
GROUP = ["_key", "url", "_slot"]


def slot_of(at: str | Column, length: int) -> Column:
    """The start of the slot of a time."""
    at = F.col(at) if isinstance(at, str) else at
    return at - F.pmod(at, F.lit(length))


def hot_urls(*tables: DataFrame) -> DataFrame:
    """(url, spread) of the urls with more than `HOT` rows in all tables (url, at) together, one per `HOT` rows at
    most, with the time between their first and last row."""
    rows = tables[0].select("url", "at")
    for more in tables[1:]:
        rows = rows.union(more.select("url", "at"))
    per = rows.groupBy("url").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("spread"))
    return per.filter(F.col("n") > HOT).select("url", "spread")


def dealt(rows: DataFrame, at: str, length: int, hot: DataFrame | None) -> DataFrame:
    """Add the columns of `GROUP`, and `_whole` where the slot holds all of its url. Slots are `length` long, or
    longer with `hot` (url, spread); without it every url is hot. Rows without a url or time are in none."""
    rows = rows.filter(F.col("url").isNotNull() & F.col(at).isNotNull())
    if hot is None:
        rows = rows.withColumns({"_whole": F.lit(False), "_slot": slot_of(at, length)})
    else:
        rows = rows.join(F.broadcast(hot.select("url", F.col("spread").alias("_spread"))), "url", "left")
        wanted = F.floor(F.col("_spread") / HOT_SLOTS)
        own = F.greatest(F.lit(length).cast("long"), F.least(wanted, F.lit(length * LONGEST).cast("long")))
        slot = F.col(at) - F.pmod(F.col(at), own)
        whole = F.col("_spread").isNull()
        rows = rows.withColumns({"_whole": whole, "_slot": F.when(whole, F.lit(0).cast("long")).otherwise(slot)}).drop("_spread")
    return rows.withColumn("_key", F.hash("url", "_slot"))


def first_from(asked: DataFrame, times: DataFrame, length: int, hot: DataFrame | None = None, value: str | None = None) -> DataFrame:
    """(url, x, found) for each of the distinct rows `asked` (url, x): the first of the url's `times`
    (url, at) at or after x, null if there is none; with `value`, as (at, `value`). Other columns of `asked` stay."""
    own = F.struct("at", value) if value else F.col("at")
    kept = [c for c in asked.columns if c not in ("url", "x")]
    rows = times.select("url", F.col("at").alias("p"), own.alias("own"))
    rows = rows.unionByName(asked.withColumnRenamed("x", "p"), allowMissingColumns=True)
    rows = dealt(rows, "p", length, hot)
    # Backwards, so that the minimum runs along; a time stands before a question of the same moment.
    inside = Window.partitionBy(*GROUP).orderBy(F.desc("p"), F.col("own").isNull())
    found = rows.withColumn("found", F.min("own").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    behind = Window.partitionBy("url").orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    lows = rows.filter("NOT _whole").groupBy(*GROUP).agg(F.min("own").alias("low"))
    later = lows.select(*GROUP, F.min("low").over(behind).alias("later"))
    return (
        found.filter("own IS NULL")
        .join(later, GROUP, "left")
        .select("url", F.col("p").alias("x"), *kept, F.coalesce("found", "later").alias("found"))
    )


def with_previous(times: DataFrame, value: str, length: int, hot: DataFrame | None = None) -> DataFrame:
    """Add `before`, the (at, `value`) of the url's time before; `times` has one row per (url, at). `ahead` is
    the url's next time if it lies in the same slot, and `last` tells that there is none at all, where that is seen."""
    rows = dealt(times, "at", length, hot)
    inside = Window.partitionBy(*GROUP).orderBy("at")
    lasts = rows.filter("NOT _whole").groupBy(*GROUP).agg(F.max(F.struct("at", value)).alias("_last"))
    across = Window.partitionBy("url").orderBy("_slot")
    carried = lasts.select(*GROUP, F.lag("_last").over(across).alias("_carried"))
    # The two columns are joined after the window: before it they would move twice.
    near = {"_at": F.lag("at").over(inside), "_value": F.lag(value).over(inside), "ahead": F.lead("at").over(inside)}
    before = F.when(F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_value").alias(value)))
    return (
        rows.withColumns(near)
        .join(carried, GROUP, "left")
        .withColumns({"before": F.coalesce(before, "_carried"), "last": F.col("_whole") & F.col("ahead").isNull()})
        .drop("_key", "_slot", "_whole", "_at", "_value", "_carried")
    )


def chained(
    times: DataFrame, due: DataFrame, span: int, scratch: Scratch, hot: DataFrame | None = None, unique: bool = False
) -> DataFrame:
    """(url, at) of the times on each url's chain: the first at or after its `due` (url, due), or its
    first time without one, then always the first at or after `span` from the one before. `unique` tells
    that `times` has one row per (url, at).

    After a gap of `span` a time is on the chain whatever came before, so chains start anew there, all at
    once, and times between two gaps have no part in what follows. Between gaps every time points at its
    successor. Each round marks what marked times point at and doubles the pointers, in one join of the table
    with itself: rounds grow with the logarithm of the longest time without a gap, and within one lifetime
    there are none. A time that is not marked and that nothing points at can never be marked, and one that
    points nowhere has nothing to mark: neither is kept, so rounds get smaller.
    """
    length = max(span // SLOTS, 1)
    times = times.select("url", "at")
    times = (times if unique else times.distinct()).withColumn("same", F.lit(True))
    told = with_previous(times, "same", length, hot)
    fresh = F.coalesce(F.col("at") - F.col("before.at") >= span, F.lit(True))
    alone = F.col("last") | F.coalesce(F.col("ahead") - F.col("at") >= span, F.lit(False))
    told = told.withColumn("fresh", fresh).withColumn("alone", F.col("fresh") & alone)
    # One row per url, written to be known as small where it is.
    told = told.join(scratch.stage(due.select("url", "due"), "due"), "url", "left")
    begins = F.col("fresh") & (F.col("due").isNull() | (F.col("at") >= F.col("due")))
    times = scratch.stage(told.select("url", "at", "due", "fresh", "alone", begins.alias("begins")), "times")
    # What is fresh begins a chain by itself. No chain meets another's beginning, so nothing is found twice.
    behind = times.filter("at >= due").groupBy("url").agg(F.min(F.struct("at", "fresh")).alias("s"))
    behind = scratch.stage(behind.filter("NOT s.fresh").select("url", "s.at"), "behind")
    inner = times.filter("NOT alone")
    asked = inner.select("url", (F.col("at") + span).alias("x"), "begins")
    steps = first_from(asked, inner, length, hot, "fresh").filter("NOT found.fresh")
    steps = steps.select("url", (F.col("x") - span).alias("at"), F.col("found.at").alias("next"), "begins")
    nodes = steps.join(behind.withColumn("late", F.lit(True)), ["at", "url"], "left")
    nodes = nodes.select("url", "at", "next", (F.col("begins") | F.coalesce("late", F.lit(False))).alias("marked"))
    out = times.filter("begins").select("url", "at").union(behind.select("url", "at"))
    while True:
        pointing = Observation()
        nodes = scratch.stage(nodes.observe(pointing, F.count("*").alias("n")), "nodes")
        if not pointing.get["n"]:
            return out
        out = out.union(nodes.filter("marked").select("url", "next"))
        then = nodes.select("url", F.col("at").alias("next"), F.col("next").alias("after"))
        hits = nodes.groupBy("url", F.col("next").alias("at")).agg(F.max("marked").alias("hit"))
        nodes = (
            nodes.join(then, ["next", "url"]).join(hits, ["at", "url"], "left").filter("marked OR hit IS NOT NULL")
            .select("url", "at", F.col("after").alias("next"), (F.col("marked") | F.coalesce("hit", F.lit(False))).alias("marked"))
        )
