"""Email scoring: headers, content, links, attachments, model blend."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.functions import scoring
from riskspark.functions.text import (
    capped, checks_array, collapse_ws, keyword_hits, pattern_hits, shown, strip_html, strip_ws,
)
from riskspark.operators.links import extract_links, score_links

LINK_LIMIT = 10


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def auth_status(df: DataFrame) -> DataFrame:
    """Add spf_status and dkim_status from the authentication header."""
    lower = F.lower(_text("auth_results"))
    return df.withColumns(
        {
            "spf_status": F.when(lower.contains("spf=pass"), "pass")
            .when(lower.contains("spf=fail") | lower.contains("spf=softfail"), "fail")
            .otherwise("unknown"),
            "dkim_status": F.when(lower.contains("dkim=pass"), "pass")
            .when(lower.contains("dkim=fail"), "fail")
            .otherwise("unknown"),
        }
    )


def address_domain(col: Column) -> Column:
    """Domain after the first `@`, case kept; null when there is none."""
    return F.nullif(F.regexp_extract(col, r"(?U)@([\w.-]+)", 1), F.lit(""))


def fold_parts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Add body_text, body_html and attachments from a parts table.

    `parts`: id, ord, content_type, disposition, filename, text. The last plain and the
    last html part win. Bodies combine before the shuffle; only names are collected.
    Messages without parts keep empty bodies.
    """
    attached = F.coalesce("disposition", F.lit("")).contains("attachment")
    plain = ~attached & (F.col("content_type") == "text/plain")
    html = ~attached & (F.col("content_type") == "text/html")
    marked = parts.select(
        "id",
        "ord",
        F.when(plain, F.col("text")).alias("_plain"),
        F.when(html, F.col("text")).alias("_html"),
        F.when(
            attached, F.struct("ord", F.coalesce(F.nullif("filename", F.lit("")), F.lit("unknown")).alias("name"))
        ).alias("_file"),
        F.when(plain, F.col("ord")).alias("_plain_at"),
        F.when(html, F.col("ord")).alias("_html_at"),
    )
    folded = marked.groupBy("id").agg(
        F.max_by("_plain", "_plain_at").alias("body_text"),
        F.max_by("_html", "_html_at").alias("body_html"),
        F.sort_array(F.collect_list("_file")).alias("_files"),
    )
    joined = messages.join(folded, "id", "left")
    return joined.withColumns(
        {
            "body_text": _text("body_text"),
            "body_html": _text("body_html"),
            "attachments": F.coalesce(F.col("_files.name"), F.array().cast("array<string>")),
        }
    ).drop("_files")


def fold_nested_parts(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Same as `fold_parts` for messages that carry their parts in an array column.

    A message that is not multipart takes its only part: html if it says so, else text.
    """
    attached = F.filter(parts, lambda p: p["disposition"].contains("attachment"))
    inline = F.filter(parts, lambda p: ~p["disposition"].contains("attachment"))
    only = F.try_element_at(F.col(parts), F.lit(1))

    def last(kind: str) -> Column:
        of_kind = F.filter(inline, lambda p: p["content_type"] == kind)
        return F.coalesce(F.try_element_at(of_kind, F.lit(-1))["text"], F.lit(""))

    single = ~F.col("multipart")
    is_html = only["content_type"] == "text/html"
    return df.withColumns(
        {
            "body_text": F.when(single, F.when(is_html, "").otherwise(only["text"])).otherwise(
                last("text/plain")
            ),
            "body_html": F.when(single, F.when(is_html, only["text"]).otherwise("")).otherwise(
                last("text/html")
            ),
            "attachments": F.when(single, F.array().cast("array<string>")).otherwise(
                F.transform(
                    attached, lambda p: F.coalesce(F.nullif(p["filename"], F.lit("")), F.lit("unknown"))
                )
            ),
        }
    )


def render_mail_text(messages: DataFrame, parts: DataFrame, html_fallback=False) -> DataFrame:
    """Corpus text: non-empty headers, a blank line, then all plain parts joined by newline.

    `html_fallback` uses the html parts, tags removed, where a message has no plain part.
    """
    inline = F.coalesce("disposition", F.lit("")) != "attachment"
    kinds = ["text/plain", "text/html"] if html_fallback else ["text/plain"]
    wanted = parts.filter(inline & F.lower("content_type").isin(kinds)).select(
        "id", F.lower("content_type").alias("kind"), F.struct("ord", "text").alias("piece")
    )
    bodies = wanted.groupBy("id").agg(
        *[
            strip_ws(
                F.array_join(
                    F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("piece"))))["text"], "\n"
                )
            ).alias(k.split("/")[1])
            for k in kinds
        ]
    )
    body = F.coalesce(F.col("plain"), F.lit(""))
    if html_fallback:
        stripped = collapse_ws(strip_html(F.coalesce(F.col("html"), F.lit(""))))
        body = F.when(body == "", stripped).otherwise(body)
    return messages.join(bodies, "id", "left").select("id", corpus_body(body).alias("text"))


def corpus_body(body: Column) -> Column:
    """The non-empty headers, one per line, a blank line and the body."""
    headers = [
        F.when(_text(c) != "", F.concat(F.lit(label + ": "), F.col(c)))
        for label, c in (
            ("subject", "subject"), ("from", "sender"), ("to", "recipient"), ("date", "date"),
        )
    ]
    return strip_ws(F.concat_ws("\n", *headers, F.lit(""), body))


def form_mail(df: DataFrame) -> DataFrame:
    """Messages typed into a form: sender, subject, body, links; headers are unknown."""
    trimmed = df.withColumns(
        {
            "sender": strip_ws(_text("sender")),
            "subject": strip_ws(_text("subject")),
            "body_text": strip_ws(_text("body")),
            "links_text": strip_ws(_text("links_text")),
            "body_html": F.lit(""),
            "reply_to": F.lit(""),
            "spf_status": F.lit("unknown"),
            "dkim_status": F.lit("unknown"),
            "attachments": F.array().cast("array<string>"),
        }
    )
    given = (F.col("sender") != "") | (F.col("subject") != "") | (F.col("body_text") != "")
    return extract_links(trimmed.filter(given), "form")


def mail_features(df: DataFrame) -> DataFrame:
    """Add the rule inputs: domains, keyword and pattern hits, links, attachments."""
    body = F.when(_text("body_text") != "", F.col("body_text")).otherwise(_text("body_html"))
    df = df.withColumns(
        {
            "body": body,
            "sender_domain": address_domain(_text("sender")),
            "reply_domain": address_domain(_text("reply_to")),
        }
    ).withColumn("_lower", F.lower(F.concat("body", F.lit(" "), _text("subject"))))
    dangerous = "|".join(e[1:] for e in lexicon.DANGEROUS_EXTENSIONS)
    df = df.withColumns(
        {
            "urgency_keywords": keyword_hits(F.col("_lower"), lexicon.MAIL_URGENCY),
            "pattern_count": pattern_hits(F.col("_lower"), lexicon.MAIL_PATTERNS),
            "dangerous_files": F.filter(
                "attachments", lambda a: F.lower(a).rlike(rf"\.(?:{dangerous})\z")
            ),
            "suspicious_sender": F.coalesce(
                F.lower("sender_domain").isin(lexicon.SUSPICIOUS_SENDERS), F.lit(False)
            ),
            "has_reply": (_text("reply_to") != "") & (_text("sender") != ""),
            "reply_mismatch": F.coalesce(
                F.col("sender_domain") != F.col("reply_domain"), F.lit(False)
            ),
            "body_chars": F.length("_lower"),
        }
    )
    return score_links(df, "links", LINK_LIMIT)


def _points(flag: Column, value: int) -> Column:
    return F.when(flag, value).otherwise(0)


def mail_rule_score(df: DataFrame) -> DataFrame:
    spf, dkim = F.col("spf_status"), F.col("dkim_status")
    points = [
        F.when(spf == "fail", 20).when(spf == "pass", 0).otherwise(5),
        F.when(dkim == "fail", 15).when(dkim == "pass", 0).otherwise(3),
        _points(F.col("has_reply") & F.col("reply_mismatch"), 15),
        _points(F.col("suspicious_sender"), 15),
        capped(F.size("urgency_keywords") * 5, 20),
        capped(F.col("pattern_count") * 5, 20),
        F.when(
            F.col("risky_links") > 0, capped(F.floor(F.col("link_max") / 2).cast("int"), 20)
        ).otherwise(0),
        F.when(F.size("dangerous_files") > 0, 25).when(F.size("attachments") > 0, 3).otherwise(0),
    ]
    return df.withColumn("rule_score", capped(sum(points[1:], points[0]), 100))


def mail_heuristic_score(df: DataFrame) -> DataFrame:
    points = [
        capped(F.size("urgency_keywords") * 7, 28),
        capped(F.col("pattern_count") * 10, 30),
        capped(F.floor(F.col("link_max") / 3).cast("int"), 20),
        _points(F.col("body_chars") < 100, 5),
    ]
    return df.withColumn("heuristic_score", capped(sum(points[1:], points[0]), 100))


def model_text(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "model_text",
        F.concat(F.lit("From: "), _text("sender"), F.lit("\nSubject: "), _text("subject"), F.lit("\n\n"), F.col("body")),
    )


def hybrid_score(df: DataFrame) -> DataFrame:
    """Add ml_score and the hybrid columns from p_second and p_nb, else the heuristic."""
    df = mail_heuristic_score(df)
    have = {"p_second", "p_nb"} <= set(df.columns)
    blended = (
        scoring.clamp(scoring.combine_probs(F.col("p_second"), F.col("p_nb")), 0.0, 1.0)
        if have
        else F.lit(None).cast("double")
    )
    fallback = F.col("heuristic_score") / F.lit(100.0)
    df = df.withColumn("hybrid_available", blended.isNotNull()).withColumn(
        "hybrid_probability", F.coalesce(blended, fallback)
    )
    p = F.col("hybrid_probability")
    return df.withColumns(
        {
            "ml_score": F.when(F.col("hybrid_available"), p * 100.0).otherwise(
                F.col("heuristic_score").cast("double")
            ),
            "hybrid_prediction": F.when(p >= scoring.LABEL_THRESHOLD, "PHISHING").otherwise(
                "LEGITIMATE"
            ),
        }
    )


def mail_check_rows() -> list[tuple]:
    """(condition, name, status, detail) of every check, over the columns of scored messages."""

    def status(col: str, label: str, failed: str, passed: str, unknown: str) -> list[tuple]:
        state = F.col(col)
        return [
            (state == "fail", f"{label}_FAILURE", "fail", failed),
            (state == "pass", f"{label}_PASS", "pass", passed),
            (~state.isin("fail", "pass"), f"{label}_UNKNOWN", "warn", unknown),
        ]

    def counted(col: Column, suffix: str) -> Column:
        return F.concat(col.cast("string"), F.lit(suffix))

    domains = F.concat(
        F.lit("Sender: "), F.col("sender_domain"), F.lit(", Reply-To: "), F.col("reply_domain")
    )
    replied, differs = F.col("has_reply"), F.col("reply_mismatch")
    urgent = F.size("urgency_keywords") > 0
    analyzed, attached = F.size("links_analyzed"), F.size("attachments")
    risky = F.col("risky_links") > 0
    dangerous = F.size("dangerous_files") > 0
    return [
        *status(
            "spf_status", "SPF", "Unauthorized sender IP", "Authorized sender IP",
            "SPF record not verifiable",
        ),
        *status(
            "dkim_status", "DKIM", "Email signature invalid", "Verified domain signature",
            "DKIM not verifiable",
        ),
        (replied & differs, "REPLY_TO_MISMATCH", "fail", domains),
        (replied & ~differs, "REPLY_TO_CHECK", "pass", "Sender and Reply-To domains match"),
        (
            F.col("suspicious_sender"), "SUSPICIOUS_SENDER", "fail",
            F.concat(F.lit("Known suspicious domain: "), F.col("sender_domain")),
        ),
        (
            urgent, "URGENCY_KEYWORDS", "fail",
            F.concat(F.lit("Found: "), shown(F.col("urgency_keywords"), 5)),
        ),
        (~urgent, "URGENCY_CHECK", "pass", "No urgency manipulation detected"),
        (
            F.col("pattern_count") > 0, "PHISHING_PATTERNS", "fail",
            counted(F.col("pattern_count"), " suspicious patterns detected"),
        ),
        (risky, "RISKY_LINKS", "fail", counted(F.col("risky_links"), " suspicious links found")),
        (
            ~risky & (analyzed > 0), "LINK_ANALYSIS", "pass",
            counted(analyzed, " links analyzed, none suspicious"),
        ),
        (
            dangerous, "DANGEROUS_ATTACHMENTS", "fail",
            F.concat(F.lit("Dangerous files: "), F.array_join("dangerous_files", ", ")),
        ),
        (~dangerous & (attached > 0), "ATTACHMENTS", "warn", counted(attached, " attachment(s) found")),
    ]


def mail_checks(df: DataFrame) -> DataFrame:
    return df.withColumn("checks", checks_array(*mail_check_rows()))


def mail_extras(df: DataFrame) -> DataFrame:
    """Add the body preview and the scan summary."""
    preview = F.substr("body", F.lit(1), F.lit(500))
    return df.withColumns(
        {
            "body_preview": F.when(F.col("body") != "", preview).otherwise("No body content"),
            "scan_summary": F.coalesce("sender_domain", F.lit("Email scan")),
        }
    )
