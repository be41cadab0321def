"""SMS scoring: keyword groups, links, sender shape. One narrow projection."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.functions.text import (
    capped, checks_array, keyword_hits, pattern_hits, shown, strip_ws,
)
from riskspark.operators.links import find_links, score_links

LINK_LIMIT = 5
GROUPS = {
    "urgency": lexicon.SMS_URGENCY,
    "prizes": lexicon.SMS_PRIZE,
    "threats": lexicon.SMS_THREAT,
    "financial": lexicon.SMS_FINANCIAL,
    "actions": lexicon.SMS_ACTION,
}


def valid_sms(df: DataFrame) -> DataFrame:
    """Trim message and sender; drop rows whose message is empty."""
    return df.withColumns(
        {
            "message": strip_ws(F.coalesce("message", F.lit(""))),
            "sender": strip_ws(F.coalesce("sender", F.lit(""))),
        }
    ).filter(F.col("message") != "")


def sms_flags(df: DataFrame) -> DataFrame:
    """Add the keyword groups, OTP and link columns."""
    lower = F.col("_lower")
    df = df.withColumn("_lower", F.lower("message")).withColumn(
        "links", find_links(F.col("message"), lexicon.SMS_LINK_PATTERN)
    )
    df = df.withColumns({name: keyword_hits(lower, words) for name, words in GROUPS.items()})
    df = df.withColumns(
        {
            "otp_hits": pattern_hits(lower, lexicon.SMS_OTP_PATTERNS),
            "link_words": F.size(keyword_hits(lower, lexicon.SMS_LINK_WORDS)) > 0,
        }
    )
    df = score_links(df, "links", LINK_LIMIT)
    return df.withColumn("pressured", _has("actions") & (_has("urgency") | _has("threats") | _has("prizes")))


def _has(name: str):
    return F.size(name) > 0


def _count(name: str):
    return F.size(name)


def sms_rule_score(df: DataFrame) -> DataFrame:
    points = [
        capped(_count("urgency") * 8, 20),
        capped(_count("prizes") * 10, 25),
        capped(_count("threats") * 8, 20),
        F.when(F.col("otp_hits") > 0, 10).otherwise(0),
        capped(_count("financial") * 5, 15),
        F.when(F.col("pressured"), 10).otherwise(0),
        F.when(
            F.col("risky_links") > 0, capped(F.floor(F.col("link_max") / 2).cast("int"), 25)
        ).otherwise(0),
    ]
    return df.withColumn("rule_score", capped(sum(points[1:], points[0]), 100))


def sms_heuristic_score(df: DataFrame) -> DataFrame:
    points = [
        capped(_count("urgency") * 10, 25),
        capped(_count("prizes") * 12, 25),
        capped(_count("threats") * 10, 20),
        capped(_count("financial") * 5, 10),
        F.when(F.col("pressured"), 10).otherwise(0),
        capped(F.floor(F.col("link_max") / 3).cast("int"), 15),
    ]
    return df.withColumn("ml_score", capped(sum(points[1:], points[0]), 100))


def sms_check_rows() -> list[tuple]:
    """(condition, name, status, detail) of every check, over the columns of scored messages."""

    def found(prefix: str, name: str):
        return F.concat(F.lit(prefix), shown(F.col(name), 3))

    def counted(name, suffix: str):
        return F.concat(name.cast("string"), F.lit(suffix))

    analyzed = F.size("links_analyzed")
    risky, linked = F.col("risky_links") > 0, analyzed > 0
    sender = F.col("sender")
    short = sender.rlike(r"(?U)^\d{4,6}$")
    phone = sender.rlike(r"(?U)^\+?\d{10,15}$")
    short_detail = F.concat(
        F.lit("Short code: "), sender, F.lit(" (legitimate services use these, but so do scams)")
    )
    return [
        (_has("urgency"), "Urgency Language", "fail", found("Found: ", "urgency")),
        (~_has("urgency"), "Urgency Check", "pass", "No urgency manipulation detected"),
        (_has("prizes"), "Prize/Lottery Scam", "fail", found("Found: ", "prizes")),
        (_has("threats"), "Threat Language", "fail", found("Found: ", "threats")),
        (F.col("otp_hits") > 0, "OTP/Code Pattern", "warn", "Contains OTP-related content"),
        (_has("financial"), "Financial Content", "warn", found("References: ", "financial")),
        (F.col("pressured"), "Call to Action", "fail", found("Pressuring action: ", "actions")),
        (risky, "Suspicious Links", "fail", counted(F.col("risky_links"), " risky link(s) detected")),
        (~risky & linked, "Link Analysis", "pass", counted(analyzed, " link(s) analyzed, appear safe")),
        (
            ~linked & F.col("link_words"), "Missing Link", "warn",
            "Mentions action but link may be hidden",
        ),
        (short, "Short Code Sender", "warn", short_detail),
        (~short & phone, "Standard Number", "pass", "Standard phone number format"),
        (
            ~short & ~phone & (sender != ""), "Sender Format", "warn",
            F.concat(F.lit("Non-standard sender: "), sender),
        ),
    ]


def sms_checks(df: DataFrame) -> DataFrame:
    return df.withColumn("checks", checks_array(*sms_check_rows()))


def sms_extras(df: DataFrame) -> DataFrame:
    """Add the preview, the flag struct and the scan summary."""
    message, sender = F.col("message"), F.col("sender")
    preview = F.concat(
        F.substr(message, F.lit(1), F.lit(100)),
        F.when(F.length(message) > 100, "...").otherwise(""),
    )
    return df.withColumns(
        {
            "message_preview": preview,
            "content_flags": F.struct(*GROUPS),
            "scan_summary": F.when(sender != "", F.concat(F.lit("SMS from "), sender)).otherwise(
                "SMS scan"
            ),
        }
    )
