"""Queries over the stored scans."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stats(scans: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return scans.agg(
        F.count("*").alias("total_scans"),
        F.count_if(v == "PHISHING").alias("phishing_caught"),
        F.count_if(v == "SUSPICIOUS").alias("suspicious_count"),
        F.count_if(v == "SAFE").alias("safe_count"),
    )


def newest(scans: DataFrame) -> DataFrame:
    """Newest first; scans without a time come last."""
    return scans.orderBy(F.desc_nulls_last("created_at"), F.desc("id"))


def history_page(scans: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page, newest first, scans without a time last. A page past the end is empty.

    Every page is found the same way: a running sum over counts per second tells which seconds
    overlap the page, and only their scans are ordered. The table is not sorted.
    """
    skip = (page - 1) * per_page
    second = F.date_trunc("second", "created_at")
    counts = scans.groupBy(second.alias("slot")).agg(F.count("*").alias("n"))
    # Days first: their sums are few, so no window holds more than the seconds of one day.
    day = F.date_trunc("day", "slot")
    days = counts.groupBy(day.alias("day")).agg(F.sum("n").alias("day_n"))
    before = Window.orderBy(F.desc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("day_before", F.coalesce(F.sum("day_n").over(before), F.lit(0)))
    days = days.filter((F.col("day_before") < skip + per_page) & (F.col("day_before") + F.col("day_n") > skip))
    inside = Window.partitionBy("day").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.join(days, day.eqNullSafe(F.col("day")))
    start = F.col("day_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    slots = slots.withColumn("start", start).filter(
        (F.col("start") < skip + per_page) & (F.col("start") + F.col("n") > skip)
    )
    near = scans.join(slots.select("slot", "start"), second.eqNullSafe(F.col("slot")))
    within = Window.partitionBy("slot").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    place = F.col("start") + F.row_number().over(within)
    wanted = near.withColumn("place", place).filter((F.col("place") > skip) & (F.col("place") <= skip + per_page))
    return newest(wanted.select(*scans.columns))


def page_info(scans: DataFrame, per_page: int = 20) -> DataFrame:
    return scans.agg(F.count("*").alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / per_page).cast("long")
    )


def history_after(scans: DataFrame, created_at, last_id: int, n: int = 20) -> DataFrame:
    """The next `n` scans after a known row: the keyset form for walking deep history.

    Where scans are stored by `created_date`, later days are not read.
    """
    at = F.lit(created_at)
    if "created_date" in scans.columns:
        scans = scans.filter(F.col("created_date") <= F.to_date(at.cast("timestamp")))
    older = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < last_id))
    return newest(scans.filter(older)).limit(n)


def recent(scans: DataFrame, n: int = 5) -> DataFrame:
    return newest(scans).limit(n)


def verdict_share(scans: DataFrame) -> DataFrame:
    return scans.groupBy("verdict").agg(F.count("*").alias("n"))


def since(scans: DataFrame, day: str) -> DataFrame:
    """Scans from a day (yyyy-MM-dd) on; where they are stored by `created_date`, earlier days are not read."""
    if "created_date" in scans.columns:
        return scans.filter(F.col("created_date") >= F.lit(day).cast("date"))
    return scans.filter(F.to_date("created_at") >= F.lit(day).cast("date"))


def weekly_activity(scans: DataFrame) -> DataFrame:
    """Scans per calendar week, starting on Monday."""
    week = F.date_trunc("week", F.col("created_at")).alias("week_start")
    return scans.groupBy(week).agg(F.count("*").alias("n"))


DETAILS = (
    "layer_scores struct<rule_based: double, ml_prediction: double, llm: double>, "
    "checks array<struct<name: string, status: string, detail: string>>, llm_analysis string"
)


def to_records(scans: DataFrame, details: str = "details_json") -> DataFrame:
    """Stored rows to API records: parsed details and ISO time."""
    return scans.select(
        "id",
        "scan_type",
        "scan_summary",
        "risk_score",
        "verdict",
        F.from_json(F.col(details), DETAILS).alias("details"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )
