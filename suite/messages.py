"""SMS, email and language-model queries and their SQL checks."""

from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.operators import answers, links, mail, scans, sms
from riskspark.plans.scans import mail_reasons, score_mail, score_sms, score_urls
from suite.registry import query
from suite.urls import hits, url_ctes
from suite.views import cte, listed, quoted


def matches(text: str, patterns) -> str:
    return " + ".join(f"regexp_matches({text}, {quoted(p)})::INT" for p in patterns)


def link_ctes(source: str, limit: int) -> str:
    """CTE lk: per id the scored links of `source`(id, links), by explode and regroup."""
    inner = url_ctes("lk_rows", "id, pos")
    return f"""
lk_rows AS (SELECT id, unnest(links[1:{limit}]) AS url, unnest(range(1, len(links[1:{limit}]) + 1)) AS pos FROM {source}),
{inner},
lk AS (SELECT id, array_to_string(list(url || '|' || rule_score ORDER BY pos), ';') AS links_analyzed, count(*) AS n_links,
  max(rule_score)::BIGINT AS link_max, count(*) FILTER (rule_score > 40) AS risky FROM s WHERE error IS NULL GROUP BY id)"""


# -- SMS --------------------------------------------------------------------

GROUPS = {
    "urgency": lexicon.SMS_URGENCY, "prizes": lexicon.SMS_PRIZE, "threats": lexicon.SMS_THREAT,
    "financial": lexicon.SMS_FINANCIAL, "actions": lexicon.SMS_ACTION,
}
SMS = f"""WITH {cte("v_sms")},
m0 AS (SELECT id, regexp_replace(message, '^\\s+|\\s+$', '', 'g') AS message, regexp_replace(sender, '^\\s+|\\s+$', '', 'g') AS sender FROM v_sms),
m1 AS (SELECT *, lower(message) AS low FROM m0 WHERE message <> ''),
m2 AS (SELECT *, {", ".join(f"{hits('low', w)} AS {n}" for n, w in GROUPS.items())},
  {matches("low", lexicon.SMS_OTP_PATTERNS)} AS otp, len({hits("low", lexicon.SMS_LINK_WORDS)}) > 0 AS link_words,
  regexp_extract_all(message, {quoted(lexicon.SMS_LINK_PATTERN)}) AS links FROM m1),
{link_ctes("m2", 5)},
m3 AS (SELECT m2.*, coalesce(lk.links_analyzed, '') AS links_analyzed, coalesce(n_links, 0) AS n_links, coalesce(link_max, 0) AS link_max, coalesce(risky, 0) AS risky,
  len(actions) > 0 AND len(urgency) + len(threats) + len(prizes) > 0 AS pressured FROM m2 LEFT JOIN lk ON lk.id = m2.id),
m AS (SELECT *, least(100, least(8 * len(urgency), 20) + least(10 * len(prizes), 25) + least(8 * len(threats), 20) + 10 * (otp > 0)::INT
    + least(5 * len(financial), 15) + 10 * pressured::INT + CASE WHEN risky > 0 THEN least(link_max // 2, 25) ELSE 0 END)::BIGINT AS rule_score,
  least(100, least(10 * len(urgency), 25) + least(12 * len(prizes), 25) + least(10 * len(threats), 20) + least(5 * len(financial), 10)
    + 10 * pressured::INT + least(link_max // 3, 15))::BIGINT AS ml_score,
  CASE WHEN regexp_full_match(sender, '\\d{{4,6}}') THEN 'Short Code Sender|warn|Short code: ' || sender || ' (legitimate services use these, but so do scams)'
    WHEN regexp_full_match(sender, '\\+?\\d{{10,15}}') THEN 'Standard Number|pass|Standard phone number format'
    WHEN sender <> '' THEN 'Sender Format|warn|Non-standard sender: ' || sender END AS sender_check,
  CASE WHEN risky > 0 THEN 'Suspicious Links|fail|' || risky || ' risky link(s) detected'
    WHEN n_links > 0 THEN 'Link Analysis|pass|' || n_links || ' link(s) analyzed, appear safe'
    WHEN link_words THEN 'Missing Link|warn|Mentions action but link may be hidden' END AS link_check FROM m3),
mc AS (SELECT *, concat_ws(';',
  CASE WHEN len(urgency) > 0 THEN 'Urgency Language|fail|Found: ' || array_to_string(urgency[1:3], ', ') ELSE 'Urgency Check|pass|No urgency manipulation detected' END,
  CASE WHEN len(prizes) > 0 THEN 'Prize/Lottery Scam|fail|Found: ' || array_to_string(prizes[1:3], ', ') END,
  CASE WHEN len(threats) > 0 THEN 'Threat Language|fail|Found: ' || array_to_string(threats[1:3], ', ') END,
  CASE WHEN otp > 0 THEN 'OTP/Code Pattern|warn|Contains OTP-related content' END,
  CASE WHEN len(financial) > 0 THEN 'Financial Content|warn|References: ' || array_to_string(financial[1:3], ', ') END,
  CASE WHEN pressured THEN 'Call to Action|fail|Pressuring action: ' || array_to_string(actions[1:3], ', ') END,
  link_check, sender_check) AS checks FROM m)"""


def sms_flagged(t):
    return sms.sms_flags(sms.valid_sms(t.view("v_sms")))


def _sms_group(name: str, title: str, factor: int, limit: int):
    sql = f"{SMS} SELECT id, array_to_string({name}, ';') AS words, least({factor} * len({name}), {limit})::BIGINT AS points FROM m"

    @query(title, sql)
    def _(t):
        points = F.least(F.size(name) * factor, F.lit(limit))
        return sms_flagged(t).select("id", F.col(name).alias("words"), points.alias("points"))


_sms_group("urgency", "sms_urgency", 8, 20)
_sms_group("prizes", "sms_prize", 10, 25)
_sms_group("threats", "sms_threat", 8, 20)
_sms_group("financial", "sms_financial", 5, 15)


@query("sms_otp", f"{SMS} SELECT id, otp::BIGINT AS otp_hits FROM m")
def _(t):
    return sms_flagged(t).select("id", "otp_hits")


@query("sms_call_to_action", f"{SMS} SELECT id, array_to_string(actions, ';') AS actions, pressured FROM m")
def _(t):
    return sms_flagged(t).select("id", "actions", "pressured")


@query("sms_links", f"{SMS} SELECT id, links_analyzed, link_max, risky AS risky_links FROM m")
def _(t):
    return sms_flagged(t).select("id", "links_analyzed", "link_max", "risky_links")


def _sms_check(names: list[str]):
    def build(t):
        scored = sms.sms_checks(sms_flagged(t))
        wanted = F.filter("checks", lambda c: c["name"].isin(names))
        return scored.select("id", wanted.alias("checks"))

    return build


query("sms_missing_link", f"{SMS} SELECT id, coalesce(link_check, '') AS checks FROM m")(
    _sms_check(["Missing Link", "Suspicious Links", "Link Analysis"])
)
query("sms_sender", f"{SMS} SELECT id, coalesce(sender_check, '') AS checks FROM m")(
    _sms_check(["Short Code Sender", "Standard Number", "Sender Format"])
)


@query(
    "sms_rule_score",
    f"""{SMS} SELECT id, rule_score, checks, left(message, 100) || CASE WHEN length(message) > 100 THEN '...' ELSE '' END AS message_preview FROM mc""",
)
def _(t):
    df = sms.sms_extras(sms.sms_checks(sms.sms_rule_score(sms_flagged(t))))
    return df.select("id", "rule_score", "checks", "message_preview")


@query("sms_heuristic_score", f"{SMS} SELECT id, ml_score FROM m")
def _(t):
    return sms.sms_heuristic_score(sms_flagged(t)).select("id", "ml_score")


VERDICT = "CASE WHEN risk_score >= 66 THEN 'PHISHING' WHEN risk_score >= 31 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict"


@query(
    "sms_scans",
    f"""{SMS}, z AS (SELECT *, ((rule_score + ml_score) / 2.0)::DOUBLE AS risk_score FROM mc)
    SELECT id, 'sms' AS scan_type, CASE WHEN sender <> '' THEN 'SMS from ' || sender ELSE 'SMS scan' END AS scan_summary, risk_score, {VERDICT}, checks,
      array_to_string(urgency, ';') AS urgency, links_analyzed FROM z""",
)
def _(t):
    return score_sms(t.view("v_sms")).select(
        "id", "scan_type", "scan_summary", "risk_score", "verdict", "details.checks",
        "content_flags.urgency", "links_analyzed",
    )


# -- email ------------------------------------------------------------------

DANGEROUS = "|".join(e[1:] for e in lexicon.DANGEROUS_EXTENSIONS)
# Attachments of the mail view are a `;` list; an empty list means none.
MAIL_BASE = f"""{cte("v_mail")},
e0 AS (SELECT *, CASE WHEN files = '' THEN [] ELSE string_split(files, ';') END AS attachments, lower(auth_results) AS la,
  regexp_extract_all(body_text || ' ' || body_html, {quoted(lexicon.MAIL_LINK_PATTERN)}) AS found FROM v_mail),
e1 AS (SELECT *, CASE WHEN contains(la, 'spf=pass') THEN 'pass' WHEN contains(la, 'spf=fail') OR contains(la, 'spf=softfail') THEN 'fail' ELSE 'unknown' END AS spf_status,
  CASE WHEN contains(la, 'dkim=pass') THEN 'pass' WHEN contains(la, 'dkim=fail') THEN 'fail' ELSE 'unknown' END AS dkim_status,
  [found[i] FOR i IN range(1, len(found) + 1) IF list_position(found, found[i]) = i] AS links,
  CASE WHEN body_text <> '' THEN body_text ELSE body_html END AS body FROM e0)"""


def mail_ctes(source: str = "e1") -> str:
    return f"""
e2 AS (SELECT *, nullif(regexp_extract(sender, '@([\\w.-]+)', 1), '') AS sender_domain, nullif(regexp_extract(reply_to, '@([\\w.-]+)', 1), '') AS reply_domain,
  lower(body || ' ' || subject) AS low FROM {source}),
e3 AS (SELECT *, {hits("low", lexicon.MAIL_URGENCY)} AS urgency, ({matches("low", lexicon.MAIL_PATTERNS)})::BIGINT AS patterns,
  [a FOR a IN attachments IF regexp_matches(lower(a), '\\.({DANGEROUS})$')] AS dangerous,
  coalesce(list_contains({listed(lexicon.SUSPICIOUS_SENDERS)}, lower(sender_domain)), false) AS bad_sender,
  reply_to <> '' AND sender <> '' AS replied, coalesce(sender_domain <> reply_domain, false) AS differs FROM e2),
{link_ctes("e3", 10)},
e4 AS (SELECT e3.*, coalesce(lk.links_analyzed, '') AS links_analyzed, coalesce(n_links, 0) AS n_links, coalesce(link_max, 0) AS link_max, coalesce(risky, 0) AS risky FROM e3 LEFT JOIN lk ON lk.id = e3.id),
e AS (SELECT *, CASE spf_status WHEN 'fail' THEN 20 WHEN 'pass' THEN 0 ELSE 5 END AS spf_points, CASE dkim_status WHEN 'fail' THEN 15 WHEN 'pass' THEN 0 ELSE 3 END AS dkim_points,
  least(100, CASE spf_status WHEN 'fail' THEN 20 WHEN 'pass' THEN 0 ELSE 5 END + CASE dkim_status WHEN 'fail' THEN 15 WHEN 'pass' THEN 0 ELSE 3 END
    + 15 * (replied AND differs)::INT + 15 * bad_sender::INT + least(5 * len(urgency), 20) + least(5 * patterns, 20)
    + CASE WHEN risky > 0 THEN least(link_max // 2, 20) ELSE 0 END + CASE WHEN len(dangerous) > 0 THEN 25 WHEN len(attachments) > 0 THEN 3 ELSE 0 END)::BIGINT AS rule_score,
  least(100, least(7 * len(urgency), 28) + least(10 * patterns, 30) + least(link_max // 3, 20) + CASE WHEN length(low) < 100 THEN 5 ELSE 0 END)::BIGINT AS heuristic_score,
  concat_ws(';',
    CASE spf_status WHEN 'fail' THEN 'SPF_FAILURE|fail|Unauthorized sender IP' WHEN 'pass' THEN 'SPF_PASS|pass|Authorized sender IP' ELSE 'SPF_UNKNOWN|warn|SPF record not verifiable' END,
    CASE dkim_status WHEN 'fail' THEN 'DKIM_FAILURE|fail|Email signature invalid' WHEN 'pass' THEN 'DKIM_PASS|pass|Verified domain signature' ELSE 'DKIM_UNKNOWN|warn|DKIM not verifiable' END,
    CASE WHEN replied AND differs THEN 'REPLY_TO_MISMATCH|fail|Sender: ' || sender_domain || ', Reply-To: ' || reply_domain WHEN replied THEN 'REPLY_TO_CHECK|pass|Sender and Reply-To domains match' END,
    CASE WHEN bad_sender THEN 'SUSPICIOUS_SENDER|fail|Known suspicious domain: ' || sender_domain END,
    CASE WHEN len(urgency) > 0 THEN 'URGENCY_KEYWORDS|fail|Found: ' || array_to_string(urgency[1:5], ', ') ELSE 'URGENCY_CHECK|pass|No urgency manipulation detected' END,
    CASE WHEN patterns > 0 THEN 'PHISHING_PATTERNS|fail|' || patterns || ' suspicious patterns detected' END,
    CASE WHEN risky > 0 THEN 'RISKY_LINKS|fail|' || risky || ' suspicious links found' WHEN n_links > 0 THEN 'LINK_ANALYSIS|pass|' || n_links || ' links analyzed, none suspicious' END,
    CASE WHEN len(dangerous) > 0 THEN 'DANGEROUS_ATTACHMENTS|fail|Dangerous files: ' || array_to_string(dangerous, ', ') WHEN len(attachments) > 0 THEN 'ATTACHMENTS|warn|' || len(attachments) || ' attachment(s) found' END) AS checks FROM e4)"""


MAIL = f"WITH {MAIL_BASE}, {mail_ctes()}"


def parsed_mail(t):
    """Mail view as parsed messages: attachments as a list, header status, distinct links."""
    df = t.view("v_mail")
    none = F.array().cast("array<string>")
    files = F.when(F.col("files") == "", none).otherwise(F.split("files", ";"))
    return links.extract_links(mail.auth_status(df.withColumn("attachments", files)), "upload")


def featured_mail(t):
    return mail.mail_features(parsed_mail(t))


@query("mail_auth_status", f"{MAIL} SELECT id, spf_status, dkim_status FROM e1")
def _(t):
    return mail.auth_status(t.view("v_mail")).select("id", "spf_status", "dkim_status")


PARTS = f"""WITH {cte("v_parts")}, {cte("v_mail")},
w AS (SELECT id, max_by(text, ord) FILTER (content_type = 'text/plain' AND NOT contains(disposition, 'attachment')) AS body_text,
  max_by(text, ord) FILTER (content_type = 'text/html' AND NOT contains(disposition, 'attachment')) AS body_html,
  string_agg(CASE WHEN filename = '' THEN 'unknown' ELSE filename END, ';' ORDER BY ord) FILTER (contains(disposition, 'attachment')) AS files
  FROM v_parts GROUP BY id)"""


@query(
    "mail_parts_fold",
    f"""{PARTS} SELECT v_mail.id, coalesce(w.body_text, '') AS body_text, coalesce(w.body_html, '') AS body_html, coalesce(w.files, '') AS attachments
    FROM v_mail LEFT JOIN w ON w.id = v_mail.id""",
)
def _(t):
    return mail.fold_parts(t.view("v_mail").select("id"), t.view("v_parts"))


@query("mail_links_upload", f"{MAIL} SELECT id, array_to_string(links, ' ') AS links FROM e1")
def _(t):
    return parsed_mail(t).select("id", F.array_join("links", " ").alias("links"))


FORM_LINKS = "regexp_extract_all(body_text || ' ' || links_text, 'https?://[^\\s]+')"


@query(
    "mail_links_form",
    f"WITH {cte('v_mail')} SELECT id, array_to_string({FORM_LINKS}, ' ') AS links FROM v_mail",
)
def _(t):
    df = links.extract_links(t.view("v_mail"), "form")
    return df.select("id", F.array_join("links", " ").alias("links"))


@query("mail_address_domain", f"{MAIL} SELECT id, sender_domain, reply_domain FROM e2")
def _(t):
    return t.view("v_mail").select(
        "id",
        mail.address_domain(F.col("sender")).alias("sender_domain"),
        mail.address_domain(F.col("reply_to")).alias("reply_domain"),
    )


def _mail_check(title: str, names: list[str], sql_case: str):
    """The named checks of each message, in order, against one SQL expression."""

    @query(title, f"{MAIL} SELECT id, {sql_case} AS checks FROM e")
    def _(t):
        df = mail.mail_checks(featured_mail(t))
        return df.select("id", F.filter("checks", lambda c: c["name"].isin(names)).alias("checks"))


_mail_check(
    "mail_auth_points",
    [f"{a}_{b}" for a in ("SPF", "DKIM") for b in ("FAILURE", "PASS", "UNKNOWN")],
    """CASE spf_points WHEN 20 THEN 'SPF_FAILURE|fail|Unauthorized sender IP' WHEN 0 THEN 'SPF_PASS|pass|Authorized sender IP' ELSE 'SPF_UNKNOWN|warn|SPF record not verifiable' END || ';' ||
    CASE dkim_points WHEN 15 THEN 'DKIM_FAILURE|fail|Email signature invalid' WHEN 0 THEN 'DKIM_PASS|pass|Verified domain signature' ELSE 'DKIM_UNKNOWN|warn|DKIM not verifiable' END""",
)
_mail_check(
    "mail_reply_mismatch",
    ["REPLY_TO_MISMATCH", "REPLY_TO_CHECK"],
    "CASE WHEN NOT replied THEN '' WHEN differs THEN 'REPLY_TO_MISMATCH|fail|Sender: ' || sender_domain || ', Reply-To: ' || reply_domain ELSE 'REPLY_TO_CHECK|pass|Sender and Reply-To domains match' END",
)


@query("mail_suspicious_sender", f"{MAIL} SELECT id, bad_sender AS suspicious_sender FROM e")
def _(t):
    return featured_mail(t).select("id", "suspicious_sender")


@query("mail_urgency", f"{MAIL} SELECT id, array_to_string(urgency, ';') AS urgency_keywords FROM e")
def _(t):
    return featured_mail(t).select("id", "urgency_keywords")


@query("mail_patterns", f"{MAIL} SELECT id, patterns AS pattern_count FROM e")
def _(t):
    return featured_mail(t).select("id", "pattern_count")


@query("mail_link_analysis", f"{MAIL} SELECT id, links_analyzed, link_max, risky AS risky_links FROM e")
def _(t):
    return featured_mail(t).select("id", "links_analyzed", "link_max", "risky_links")


@query(
    "mail_attachments",
    f"{MAIL} SELECT id, array_to_string(dangerous, ';') AS dangerous_files, len(attachments)::BIGINT AS n FROM e",
)
def _(t):
    return featured_mail(t).select("id", "dangerous_files", F.size("attachments").alias("n"))


@query("mail_rule_score", f"{MAIL} SELECT id, rule_score, checks FROM e")
def _(t):
    return mail.mail_checks(mail.mail_rule_score(featured_mail(t))).select("id", "rule_score", "checks")


@query("mail_heuristic_score", f"{MAIL} SELECT id, heuristic_score FROM e")
def _(t):
    return mail.mail_heuristic_score(featured_mail(t)).select("id", "heuristic_score")


# Probabilities by key stand in for two trained models; some messages have none.
PROBS = "SELECT doc_id AS id, (doc_id % 97) / 97.0D AS p_second, (doc_id % 89) / 89.0D AS p_nb FROM {documents} WHERE doc_id % 4 <> 3"
PROBS_SQL = PROBS.replace("{documents}", "documents").replace("97.0D", "97.0::DOUBLE").replace("89.0D", "89.0::DOUBLE")
HYBRID = f"""{MAIL}, pr AS ({PROBS_SQL}),
h0 AS (SELECT e.*, pr.id IS NOT NULL AS hybrid_available, CASE WHEN pr.id IS NOT NULL THEN 0.7::DOUBLE * p_second + 0.3::DOUBLE * p_nb ELSE heuristic_score / 100.0::DOUBLE END AS p FROM e LEFT JOIN pr ON pr.id = e.id),
h AS (SELECT *, CASE WHEN p >= 0.61 THEN 'PHISHING' ELSE 'LEGITIMATE' END AS hybrid_prediction, CASE WHEN hybrid_available THEN p * 100 ELSE heuristic_score END AS ml FROM h0)"""


def mail_probs(t):
    return t.spark.sql(PROBS, documents=t.table("documents"))


@query(
    "mail_hybrid_score",
    f"{HYBRID} SELECT id, hybrid_available, round(p, 6)::DOUBLE AS hybrid_probability, hybrid_prediction, round(ml, 6)::DOUBLE AS ml_score FROM h",
)
def _(t):
    df = featured_mail(t).join(mail_probs(t), "id", "left")
    return mail.hybrid_score(df).select(
        "id", "hybrid_available", F.round("hybrid_probability", 6).alias("hybrid_probability"),
        "hybrid_prediction", F.round("ml_score", 6).alias("ml_score"),
    )


@query(
    "mail_model_text",
    f"{MAIL} SELECT id, md5('From: ' || sender || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || body) AS digest, length(body) AS body_chars FROM e1",
)
def _(t):
    df = mail.model_text(featured_mail(t))
    return df.select("id", F.md5("model_text").alias("digest"), F.length("body").alias("body_chars"))


@query(
    "mail_corpus_text",
    f"""{PARTS}, plain AS (SELECT id, string_agg(text, chr(10) ORDER BY ord) AS body FROM v_parts WHERE content_type = 'text/plain' AND NOT starts_with(disposition, 'attachment') GROUP BY id)
    SELECT v_mail.id, md5(regexp_replace(concat_ws(chr(10), CASE WHEN subject <> '' THEN 'subject: ' || subject END, CASE WHEN sender <> '' THEN 'from: ' || sender END,
      'to: ' || recipient, CASE WHEN date <> '' THEN 'date: ' || date END, '', coalesce(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), '')), '^\\s+|\\s+$', '', 'g')) AS digest
    FROM v_mail LEFT JOIN plain ON plain.id = v_mail.id""",
)
def _(t):
    parts = t.view("v_parts").withColumn("disposition", F.substring_index("disposition", ";", 1))
    return mail.render_mail_text(t.view("v_mail"), parts).select("id", F.md5("text").alias("digest"))


@query(
    "mail_body_preview",
    f"{MAIL} SELECT id, CASE WHEN body <> '' THEN left(body, 500) ELSE 'No body content' END AS body_preview FROM e1",
)
def _(t):
    return mail.mail_extras(featured_mail(t)).select("id", "body_preview")


SCAN_MAIL = f"""SELECT id, 'email' AS scan_type, coalesce(sender_domain, 'Email scan') AS scan_summary, risk_score, {VERDICT}, checks, links_analyzed"""


@query(
    "mail_form_scans",
    f"""WITH {cte("v_mail")}, e1 AS (SELECT id, sender, subject, '' AS reply_to, 'unknown' AS spf_status, 'unknown' AS dkim_status, []::VARCHAR[] AS attachments,
      regexp_replace(body_text, '^\\s+|\\s+$', '', 'g') AS body, regexp_extract_all(regexp_replace(body_text, '^\\s+|\\s+$', '', 'g') || ' ' || links_text, 'https?://[^\\s]+') AS links FROM v_mail
      WHERE sender <> '' OR subject <> '' OR regexp_replace(body_text, '^\\s+|\\s+$', '', 'g') <> ''),
    {mail_ctes()}, z AS (SELECT *, ((rule_score + heuristic_score) / 2.0)::DOUBLE AS risk_score FROM e) {SCAN_MAIL} FROM z""",
)
def _(t):
    form = t.view("v_mail").select("id", "sender", "subject", F.col("body_text").alias("body"), "links_text")
    return score_mail(mail.form_mail(form)).select(
        "id", "scan_type", "scan_summary", "risk_score", "verdict", "details.checks", "links_analyzed"
    )


@query(
    "mail_scans",
    f"""{HYBRID}, z AS (SELECT *, round_even(least(greatest(rule_score * 0.5::DOUBLE + ml * 0.5::DOUBLE, 0), 100), 1)::DOUBLE AS risk_score FROM h)
    {SCAN_MAIL}, hybrid_prediction FROM z""",
)
def _(t):
    return score_mail(parsed_mail(t), probs=mail_probs(t)).select(
        "id", "scan_type", "scan_summary", "risk_score", "verdict", "details.checks",
        "links_analyzed", "hybrid_prediction",
    )


# -- blending, language model, presentation -----------------------------------

ANSWERS = f"""{cte("v_answers")},
a0 AS (SELECT id, answer, regexp_extract(answer, '(?i)SCORE:\\s*(\\d+)', 1) AS d, upper(regexp_extract(answer, '(?i)VERDICT:\\s*(SAFE|SUSPICIOUS|PHISHING)', 1)) AS v FROM v_answers),
a AS (SELECT id, CASE WHEN d = '' THEN 0 ELSE least(d::BIGINT, 100) END::BIGINT AS llm_score, CASE WHEN v = '' THEN 'UNKNOWN' ELSE v END AS llm_verdict,
  CASE WHEN regexp_matches(answer, '(?i)ANALYSIS:') THEN regexp_replace(regexp_extract(answer, '(?is)ANALYSIS:\\s*(.*)', 1), '^\\s+|\\s+$', '', 'g') ELSE answer END AS llm_analysis FROM a0)"""


@query("llm_answers", f"WITH {ANSWERS} SELECT * FROM a")
def _(t):
    return answers.parse_llm_answers(t.view("v_answers")).select(
        "id", "llm_score", "llm_verdict", "llm_analysis"
    )


BLENDED = f"""WITH {cte("v_urls")}, {url_ctes("v_urls")}, {ANSWERS},
b AS (SELECT s.*, a.id IS NOT NULL AS llm_success, coalesce(llm_score, 0) AS llm, coalesce(llm_analysis, 'Not available') AS llm_analysis FROM s LEFT JOIN a ON a.id = s.id),
z AS (SELECT *, round_even(CASE WHEN llm_success THEN rule_score * 0.3::DOUBLE + ml_score * 0.3::DOUBLE + llm * 0.4::DOUBLE ELSE (rule_score + ml_score) / 2.0::DOUBLE END, 1)::DOUBLE AS risk_score FROM b)"""


@query(
    "llm_attached",
    f"{BLENDED} SELECT id, llm_success, llm_success AS llm_available, llm AS llm_score, llm_analysis FROM z",
)
def _(t):
    return answers.attach_llm(t.view("v_urls"), t.view("v_answers")).select(
        "id", "llm_success", "llm_available", "llm_score", "llm_analysis"
    )


def with_llm(t):
    return score_urls(t.view("v_urls"), llm=t.view("v_answers"))


@query("score_blend", f"{BLENDED} SELECT id, risk_score FROM z WHERE error IS NULL")
def _(t):
    return with_llm(t).filter("error IS NULL").select("id", "risk_score")


@query("score_verdict", f"{BLENDED} SELECT id, {VERDICT} FROM z WHERE error IS NULL")
def _(t):
    return with_llm(t).filter("error IS NULL").select("id", "verdict")


@query(
    "score_result",
    f"""{BLENDED} SELECT id, rule_score::DOUBLE AS rule_based, ml_score::DOUBLE AS ml_prediction, CASE WHEN llm_success THEN llm ELSE 0 END::DOUBLE AS llm,
      llm_analysis, llm_success, llm_success AS llm_available FROM z""",
)
def _(t):
    return with_llm(t).select(
        "id", "details.layer_scores.*", "details.llm_analysis", "llm_success", "llm_available"
    )


FORMAT = answers.ANSWER_FORMAT


def _prompt_sql(head: str, body: str, ask: str, aspects: list[str]) -> str:
    numbered = "".join(f"{i}. {a}\n" for i, a in enumerate(aspects, 1))
    return f"{quoted(head)} || {body} || {quoted(chr(10) * 2 + ask + chr(10) + numbered + chr(10) + FORMAT)}"


URL_HEAD = "You are a cybersecurity expert analyzing URLs for phishing threats.\n\nAnalyze this URL for phishing indicators: "
MAIL_HEAD = "You are a cybersecurity expert analyzing emails for phishing threats.\n\nAnalyze this email:\n- From: "
SMS_HEAD = "You are a cybersecurity expert analyzing SMS messages for phishing and scam threats.\n\nAnalyze this SMS:\n- Sender: "


@query(
    "llm_prompts_url",
    f"WITH {cte('v_urls')} SELECT id, {_prompt_sql(URL_HEAD, 'url', 'Consider:', answers.URL_ASPECTS)} AS prompt FROM v_urls",
)
def _(t):
    return answers.build_prompts(t.view("v_urls"), "url")


@query(
    "llm_prompts_mail",
    f"""{MAIL} SELECT id, md5({_prompt_sql(MAIL_HEAD, "sender || chr(10) || '- Subject: ' || subject || chr(10) || '- Body Preview: ' || CASE WHEN body <> '' THEN left(body, 500) ELSE 'No body content' END || chr(10) || '- Links found: ' || CASE WHEN len(links) > 0 THEN array_to_string(links[1:5], ', ') ELSE 'None' END", "Evaluate for:", answers.MAIL_ASPECTS)}) AS digest FROM e1""",
)
def _(t):
    df = answers.build_prompts(mail.mail_extras(featured_mail(t)), "email")
    return df.select("id", F.md5("prompt").alias("digest"))


@query(
    "llm_prompts_sms",
    f"""{SMS} SELECT id, {_prompt_sql(SMS_HEAD, "CASE WHEN sender = '' THEN 'Unknown' ELSE sender END || chr(10) || '- Message: ' || message", "Evaluate for:", answers.SMS_ASPECTS)} AS prompt FROM m1""",
)
def _(t):
    return answers.build_prompts(sms.valid_sms(t.view("v_sms")), "sms")


@query(
    "threat_meter",
    f"""{HYBRID} SELECT id, round(CASE WHEN hybrid_available AND hybrid_prediction = 'PHISHING' THEN floor((75 + least(greatest((p - 0.61) / (1.0::DOUBLE - 0.61), 0), 1) * 20) * 10 + 0.5) / 10
      WHEN hybrid_available THEN floor((5 + least(p / 0.61::DOUBLE, 1) * 25) * 10 + 0.5) / 10
      ELSE round_even((rule_score + ml) / 2.0::DOUBLE, 1) END, 6)::DOUBLE AS threat_level FROM h""",
)
def _(t):
    df = scans.threat_meter(score_mail(parsed_mail(t), probs=mail_probs(t)))
    return df.select("id", F.round("threat_level", 6).alias("threat_level"))


@query(
    "action_policy",
    f"""{BLENDED} SELECT id, CASE WHEN risk_score >= 70 THEN 'block' WHEN risk_score >= 31 THEN 'warn' ELSE 'allow' END AS action FROM z WHERE error IS NULL""",
)
def _(t):
    return scans.action_policy(with_llm(t)).filter("error IS NULL").select("id", "action")


@query(
    "top_reasons",
    f"""{MAIL}, c AS (SELECT unnest(string_split(checks, ';')) AS c FROM e)
    SELECT 'email' AS scan_type, split_part(c, '|', 1) AS name, split_part(c, '|', 2) AS status, count(*) AS n FROM c GROUP BY ALL""",
)
def _(t):
    return mail_reasons(parsed_mail(t))


@query(
    "top_reasons_first_three",
    f"""{MAIL}, c AS (SELECT unnest(string_split(checks, ';')) AS c FROM e)
    SELECT 'email' AS scan_type, split_part(c, '|', 1) AS name, split_part(c, '|', 2) AS status, count(*) AS n FROM c GROUP BY ALL ORDER BY n DESC, name, status LIMIT 3""",
)
def _(t):
    return mail_reasons(parsed_mail(t), 3)
