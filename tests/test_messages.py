import pytest
from pyspark.sql import functions as F

from riskspark.functions import scoring
from riskspark.operators import answers, links, mail, scans
from riskspark.plans.scans import score_mail, score_sms, score_urls, sms_reasons, url_reasons
from riskspark.sources import maildir

SMS = [
    ("See you at lunch", 0, 0, 0.0, "SAFE"),
    ("URGENT: account suspended, verify at http://g00gle-account.tk/verify?redirect=1", 59, 55, 57.0, "SUSPICIOUS"),
    ("Congratulations winner! Claim your cash prize, reply now", 35, 35, 35.0, "SUSPICIOUS"),
    ("Your OTP is 1234, do not share", 10, 0, 5.0, "SAFE"),
    ("I wonder who came first in the taxi", 20, 22, 21.0, "SAFE"),
    ("Click below to go to the site", 0, 0, 0.0, "SAFE"),
    ("Unauthorized payment blocked. Legal action within 24 hours. Call your bank. http://192.168.4.7/login", 56, 71, 63.5, "SUSPICIOUS"),
]


def sms_table(spark, rows):
    return spark.createDataFrame(rows, "id long, message string, sender string")


def test_sms_golden_rows(spark):
    df = sms_table(spark, [(i, s[0], "") for i, s in enumerate(SMS)])
    rows = score_sms(df).orderBy("id").select("*", "details.layer_scores.*").collect()
    got = [(r.rule_based, r.ml_prediction, r.risk_score, r.verdict) for r in rows]
    assert got == [tuple(s[1:]) for s in SMS]
    assert [c.name for c in rows[5].details.checks][-1] == "Missing Link"
    assert rows[0].scan_summary == "SMS scan"


def test_sms_rejects_blank_and_names_sender(spark):
    df = sms_table(spark, [(1, "  ", "x"), (2, "hi", "12345"), (3, "hi", "+12025550100"), (4, "hi", "ACME")])
    rows = score_sms(df).orderBy("id").collect()
    assert [r.id for r in rows] == [2, 3, 4]
    assert [r.details.checks[-1].name for r in rows] == ["Short Code Sender", "Standard Number", "Sender Format"]
    assert rows[0].scan_summary == "SMS from 12345"


MAIL = "id long, sender string, subject string, reply_to string, body_text string, body_html string, links array<string>, attachments array<string>, spf_status string, dkim_status string"


def test_mail_golden_rows(spark):
    rows = [
        (0, "A <a@x.com>", "Hello", "", "See you tomorrow", "", [], [], "pass", "pass"),
        (1, "Bank <b@mailinator.com>", "Security alert", "c@evil.tk",
         "Dear customer, your account has been suspended. Click here to verify your account immediately.",
         "", ["http://g00gle-account.tk/verify?redirect=1"], ["invoice.EXE"], "fail", "fail"),
        (2, "b@y.org", "", "", "Please find the report attached for the quarterly meeting. " * 3, "",
         ["https://www.google.com/"], ["r.pdf"], "unknown", "unknown"),
        (3, "", "Last chance", "", "You have won! Update your billing within 24 hours", "", [], [], "unknown", "unknown"),
    ]
    got = score_mail(spark.createDataFrame(rows, MAIL)).orderBy("id").select("*", "details.layer_scores.*").collect()
    assert [(r.rule_based, r.ml_prediction, r.risk_score, r.verdict) for r in got] == [
        (0.0, 5.0, 2.5, "SAFE"), (100.0, 78.0, 89.0, "PHISHING"), (11.0, 0.0, 5.5, "SAFE"), (33.0, 46.0, 39.5, "SUSPICIOUS"),
    ]
    assert [r.scan_summary for r in got] == ["x.com", "mailinator.com", "y.org", "Email scan"]


def test_only_the_first_links_count(spark):
    df = spark.createDataFrame(
        [(1, ["https://a.com/"] * 5 + ["http://g00gle-account.tk/verify?redirect=1"], None)],
        "id long, links array<string>, none array<string>",
    )
    assert links.score_links(df, "links", 5).head().link_max == 0
    assert links.score_links(df, "links", 10).head().link_max == 84
    assert links.score_links(df, "none", 10).head().link_max == 0


def test_mail_scoring_moves_no_message(spark):
    row = (1, "a@x.com", "s", "", "see http://h:abc/ https://bit.ly/x1", "", ["http://h:abc/", "https://bit.ly/x1"], [], "pass", "pass")
    df = score_mail(spark.createDataFrame([row], MAIL))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(x.url, x.rule_score) for x in df.head().links_analyzed] == [("https://bit.ly/x1", 8)]


def test_missing_probabilities_fall_back(spark):
    row = (1, "a@x.com", "Last chance", "", "body", "", [], [], "pass", "pass")
    df = spark.createDataFrame([row, (2, *row[1:])], MAIL)
    probs = spark.createDataFrame([(1, 1.0, 1.0)], "id long, p_second double, p_nb double")
    got = {r.id: (r.hybrid_available, r.hybrid_prediction, r.hybrid_probability) for r in score_mail(df, probs).collect()}
    assert got[1] == (True, "PHISHING", 1.0)
    assert got[2][:2] == (False, "LEGITIMATE") and got[2][2] == pytest.approx(0.12)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize(
    "rule, ml, llm, ok, expected",
    [(80, 60, 90, True, 78.0), (80, 60, 90, False, 70.0), (0, 0, 0, False, 0.0), (100, 100, 100, True, 100.0), (11, 0, 0, None, 5.5)],
)
def test_blend(spark, rule, ml, llm, ok, expected):
    assert one(spark, scoring.combine_scores(F.lit(rule), F.lit(ml), F.lit(llm), F.lit(ok).cast("boolean"))) == expected


@pytest.mark.parametrize("score, expected", [(30.9, "SAFE"), (31.0, "SUSPICIOUS"), (65.9, "SUSPICIOUS"), (66.0, "PHISHING")])
def test_verdict(spark, score, expected):
    assert one(spark, scoring.verdict(F.lit(score))) == expected


@pytest.mark.parametrize(
    "verdict, score, expected",
    [("PHISHING", 70.0, "block"), ("PHISHING", 69.9, "warn"), ("SUSPICIOUS", 40.0, "warn"), ("SAFE", 0.0, "allow")],
)
def test_action(spark, verdict, score, expected):
    assert one(spark, scoring.action(F.lit(verdict), F.lit(score))) == expected


@pytest.mark.parametrize("p, label, expected", [(1.0, "PHISHING", 95.0), (0.61, "PHISHING", 75.0), (0.0, "LEGITIMATE", 5.0)])
def test_threat_meter(spark, p, label, expected):
    assert one(spark, scoring.threat_meter(F.lit(p), F.lit(label), F.lit(True), F.lit(1.0))) == expected
    assert one(spark, scoring.threat_meter(F.lit(p), F.lit(label), F.lit(False), F.lit(1.0))) == 1.0


def test_llm_answers(spark):
    df = spark.createDataFrame(
        [(1, "SCORE: 250\nVERDICT: phishing\nANALYSIS: two\nlines "), (2, "plain"), (3, "score: 99999999999999999999")],
        "id long, answer string",
    )
    got = [(r.llm_score, r.llm_verdict, r.llm_analysis) for r in answers.parse_llm_answers(df).orderBy("id").collect()]
    assert got == [(100, "PHISHING", "two\nlines"), (0, "UNKNOWN", "plain"), (100, "UNKNOWN", "score: 99999999999999999999")]
    urls = spark.createDataFrame([(1, "https://a.com/"), (9, "https://a.com/")], "id long, url string")
    scored = {r.id: r for r in score_urls(urls, llm=df).collect()}
    assert scored[1].risk_score == 40.0 and scored[1].llm_success
    assert scored[9].risk_score == 0.0 and scored[9].details.llm_analysis == "Not available"
    assert score_urls(urls).head().details.llm_analysis == "Not configured"


def eml(subject="Test Subject", sender="sender@example.com", body="Hello world", kind="text/plain"):
    lines = [f"From: {sender}", "To: recipient@example.com", f"Subject: {subject}", "MIME-Version: 1.0",
             f"Content-Type: {kind}; charset=utf-8", "", body]
    return "\r\n".join(lines).encode()


def test_mail_directory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.eml").write_bytes(eml("Verify Account", "phisher@evil.com", "Click here now www.x.com/a"))
    (tmp_path / "in" / "b.EML").write_bytes(eml(body=""))
    (tmp_path / "in" / "c.eml").write_bytes(eml(body="<p>Click <a href='http://phish.com'>here</a></p>", kind="text/html"))
    (tmp_path / "in" / "skip.txt").write_bytes(b"no mail")
    parsed = maildir.parse_mail(maildir.read_mail_files(spark, str(tmp_path)))
    texts = {r.path[-5:]: r.text for r in maildir.corpus_text(parsed).collect()}
    assert len(texts) == 3
    assert texts["a.eml"] == "subject: Verify Account\nfrom: phisher@evil.com\nto: recipient@example.com\n\nClick here now www.x.com/a"
    assert "subject:" in texts["b.EML"].lower()
    assert "Click" not in texts["c.eml"]  # html is left out of the training text
    rows = {r.path[-5:]: r for r in maildir.read_mail_dir(spark, str(tmp_path)).collect()}
    assert rows["a.eml"].links == ["www.x.com/a"] and rows["c.eml"].links == ["http://phish.com"]
    corpus = maildir.read_mail_corpus(spark, str(tmp_path), str(tmp_path))
    assert {(r.src_ord, r.label) for r in corpus.collect()} == {(0, 0), (1, 1)}


def test_html_fallback(spark):
    messages = spark.createDataFrame([(1, "s", "a@b.c", "", "")], "id long, subject string, sender string, recipient string, date string")
    parts = spark.createDataFrame([(1, 0, "text/html", "", "", "<p>Hi&amp;bye</p>")], "id long, ord int, content_type string, disposition string, filename string, text string")
    assert mail.render_mail_text(messages, parts).head().text == "subject: s\nfrom: a@b.c"
    assert mail.render_mail_text(messages, parts, html_fallback=True).head().text.endswith("\n\nHi&bye")


def test_top_reasons(spark):
    df = sms_table(spark, [(1, "hi", ""), (2, "yo", "")])
    assert [tuple(r) for r in scans.top_reasons(score_sms(df), 1).collect()] == [("sms", "Urgency Check", "pass", 2)]


def test_counted_reasons_are_those_of_the_scans(spark):
    texts = ["Urgent: verify at http://10.0.0.1/login", "you won a prize, claim now", "", "hello there", None]
    df = spark.createDataFrame([(i, t, s) for i, t in enumerate(texts) for s in ("12345", "+12025550123", "ACME", "")], "id long, message string, sender string")
    assert rows_of(sms_reasons(df)) == rows_of(scans.top_reasons(score_sms(df)))
    urls = spark.createDataFrame(list(enumerate(["http://10.0.0.1/login?next=1", "https://example.com/", "http://h:abc/", "", None])), "id long, url string")
    assert rows_of(url_reasons(urls)) == rows_of(scans.top_reasons(score_urls(urls)))
    plan = sms_reasons(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Found: " not in plan and "detail" not in plan
    assert sms_reasons(df.limit(0)).count() == 0


def rows_of(df):
    return sorted(map(tuple, df.collect()))
