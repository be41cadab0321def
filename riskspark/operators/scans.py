"""Turning scored rows into scan records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import scoring
from riskspark.functions.staging import hold

SUMMARY_LIMIT = 255  # width of the stored summary column


def _or(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def blend(df: DataFrame) -> DataFrame:
    """Add risk_score and verdict from rule_score, ml_score and, if present, the LLM layer."""
    risk = scoring.combine_scores(
        F.col("rule_score"),
        F.col("ml_score"),
        _or(df, "llm_score", 0),
        _or(df, "llm_success", False),
    )
    return df.withColumn("risk_score", risk).withColumn(
        "verdict", scoring.verdict(F.col("risk_score"))
    )


def layer_scores(df: DataFrame) -> Column:
    ok = _or(df, "llm_success", False)
    return F.struct(
        F.bround(F.col("rule_score").cast("double"), 1).alias("rule_based"),
        F.bround(F.col("ml_score").cast("double"), 1).alias("ml_prediction"),
        F.when(ok, _or(df, "llm_score", 0)).otherwise(0).cast("double").alias("llm"),
    )


def llm_analysis(df: DataFrame) -> Column:
    if "llm_available" not in df.columns:
        return F.lit("Not configured")
    return F.when(F.col("llm_available").isNull(), "Not configured").otherwise(
        F.coalesce(F.col("llm_analysis"), F.lit("Not available"))
    )


def to_scan(df: DataFrame, scan_type: str, *extra: str) -> DataFrame:
    """Scan records: id, type, summary, blended score, verdict, details and extras.

    `df` carries id, scan_summary, rule_score, ml_score, checks and optional LLM columns.
    """
    df = blend(df)
    details = F.struct(
        layer_scores(df).alias("layer_scores"),
        F.col("checks"),
        llm_analysis(df).alias("llm_analysis"),
    )
    return df.select(
        "id",
        F.lit(scan_type).alias("scan_type"),
        F.substr("scan_summary", F.lit(1), F.lit(SUMMARY_LIMIT)).alias("scan_summary"),
        "risk_score",
        "verdict",
        details.alias("details"),
        _or(df, "llm_available", False).alias("llm_available"),
        _or(df, "llm_success", False).alias("llm_success"),
        *extra,
    )


def action_policy(df: DataFrame) -> DataFrame:
    return df.withColumn("action", scoring.action(F.col("verdict"), F.col("risk_score")))


def threat_meter(df: DataFrame) -> DataFrame:
    """Add the display level from the hybrid probability, or the risk score without one."""
    level = scoring.threat_meter(
        F.col("hybrid_probability"),
        F.col("hybrid_prediction"),
        F.col("hybrid_available"),
        F.col("risk_score"),
    )
    return df.withColumn("threat_level", level)


def most_frequent(counted: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return counted
    return counted.orderBy(F.desc("n"), "scan_type", "name", "status").limit(k)


def count_reasons(df: DataFrame, rows: list[tuple], scan_type: str, k: int | None = None) -> DataFrame:
    """`top_reasons` of rows whose checks are not built yet: (condition, name, status, detail) in `rows`.

    Each row becomes the bits of its conditions; they are counted map-side in one row per task and
    named after that. No check text is built.
    """
    bits = F.array(*[F.coalesce(condition, F.lit(False)) for condition, *_ in rows]).alias("bits")
    counts = hold(df.select(bits), "bits").agg(
        *[F.count_if(F.get("bits", F.lit(i))).alias(f"n{i}") for i in range(len(rows))]
    )
    named = [
        F.struct(F.lit(name).alias("name"), F.lit(status).alias("status"), F.col(f"n{i}").alias("n"))
        for i, (_, name, status, _) in enumerate(rows)
    ]
    counts = counts.select(F.inline(F.array(*named))).filter("n > 0")
    counts = counts.groupBy("name", "status").agg(F.sum("n").alias("n"))
    return most_frequent(counts.select(F.lit(scan_type).alias("scan_type"), "name", "status", "n"), k)


def top_reasons(scans: DataFrame, k: int | None = None) -> DataFrame:
    """How often each check of stored scans was raised, most frequent first."""
    counted = (
        scans.select("scan_type", F.explode("details.checks").alias("c"))
        .groupBy("scan_type", F.col("c.name").alias("name"), F.col("c.status").alias("status"))
        .agg(F.count("*").alias("n"))
    )
    return most_frequent(counted, k)
