"""Whole scan jobs: messages or URLs in, scan records out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.staging import hold
from riskspark.operators import answers as llm_answers
from riskspark.operators.ensemble import one_probability
from riskspark.operators import mail, scans, sms, trees, urls


def score_urls(df: DataFrame, col="url", model=None, suffixes=None, llm=None) -> DataFrame:
    """Scan records for (id, url) rows. Rows that cannot be parsed get verdict ERROR."""
    df = df.withColumn("url", F.col(col))
    if llm is not None:
        # Joined before scoring: the shuffle carries addresses, not checks.
        df = llm_answers.attach_llm(df, llm)
    df = urls.full_url_score(df)
    if model is not None:
        df = trees.apply_url_model(df, model, suffixes)
    df = df.withColumn("scan_summary", F.coalesce(F.nullif("host", F.lit("")), F.substr("url", F.lit(1), F.lit(50))))
    out = scans.to_scan(df, "url", "url", "ml_probability", "error")
    failed = F.col("error").isNotNull()
    return out.withColumns(
        {
            "risk_score": F.when(failed, 0.0).otherwise(F.col("risk_score")),
            "verdict": F.when(failed, "ERROR").otherwise(F.col("verdict")),
        }
    )


def score_mail(df: DataFrame, probs: DataFrame | None = None, llm=None) -> DataFrame:
    """Scan records for parsed messages.

    Columns: id, sender, subject, reply_to, body_text, body_html, links, attachments,
    spf_status, dkim_status; optional p_second and p_nb, or `probs` keyed by id, of which one row per id counts.
    """
    df = mail.mail_extras(mail.mail_features(df))
    if probs is not None:
        # The preview is cut already, so the join moves no message body.
        df = df.join(one_probability(probs, "id", "p_second", "p_nb"), "id", "left")
    df = hold(mail.hybrid_score(mail.mail_rule_score(df)), "rule_score", "ml_score")
    df = mail.mail_checks(df)
    if llm is not None:
        df = llm_answers.attach_llm(df, llm)
    return scans.to_scan(
        df, "email", "sender_domain", "urgency_keywords", "links_analyzed", "attachments",
        "body_preview", "hybrid_prediction", "hybrid_probability", "hybrid_available",
    )


def score_sms(df: DataFrame, llm=None) -> DataFrame:
    """Scan records for (id, message, sender) rows; empty messages are rejected."""
    df = sms.sms_flags(sms.valid_sms(df))
    df = hold(sms.sms_heuristic_score(sms.sms_rule_score(df)), "rule_score", "ml_score")
    df = sms.sms_extras(sms.sms_checks(df))
    if llm is not None:
        df = llm_answers.attach_llm(df, llm)
    return scans.to_scan(
        df, "sms", "message_preview", "sender", "content_flags", "links_analyzed"
    )


def url_reasons(df: DataFrame, col="url", k: int | None = None) -> DataFrame:
    """How often `score_urls` raises each check, without building the checks."""
    return scans.count_reasons(urls.url_check_inputs(df, col), urls.url_check_rows(), "url", k)


def mail_reasons(df: DataFrame, k: int | None = None) -> DataFrame:
    """How often `score_mail` raises each check, without building the checks."""
    return scans.count_reasons(mail.mail_features(df), mail.mail_check_rows(), "email", k)


def sms_reasons(df: DataFrame, k: int | None = None) -> DataFrame:
    """How often `score_sms` raises each check, without building the checks."""
    return scans.count_reasons(sms.sms_flags(sms.valid_sms(df)), sms.sms_check_rows(), "sms", k)
