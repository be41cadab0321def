import pytest
from pyspark.sql import functions as F

from riskspark.operators import urls
from riskspark.plans.scans import score_urls

# url, host, entropy, brand, keywords, specials, rule, heuristic, risk, verdict
GOLDEN = [
    ("https://www.google.com/", "www.google.com", 2.84, None, 0, 0, 0, 0, 0.0, "SAFE"),
    ("http://192.168.4.7/login", "192.168.4.7", 2.85, None, 1, 0, 35, 37, 36.0, "SUSPICIOUS"),
    ("http://g00gle-account.tk/verify?redirect=1", "g00gle-account.tk", 3.62, "google", 2, 2, 84, 84, 84.0, "PHISHING"),
    ("https://bit.ly/x1", "bit.ly", 2.58, None, 0, 0, 8, 8, 8.0, "SAFE"),
    ("http://user@paypa1.com:8080/secure/login/update?token=a", "paypa1.com", 2.92, "paypal", 3, 3, 91, 69, 80.0, "PHISHING"),
    ("evil.com/?r=http://x", "", 0.0, None, 0, 2, 16, 12, 14.0, "SAFE"),
    ("https://chase.com/", "chase.com", 2.95, "banking", 0, 0, 25, 30, 27.5, "SAFE"),
    ("https://a.b.c.d.example.org/", "a.b.c.d.example.org", 3.43, None, 0, 0, 10, 10, 10.0, "SAFE"),
    ("http://my-bank-login-verify.xyz/account/confirm/password/" + "a" * 36, "my-bank-login-verify.xyz", 4.02, None, 5, 0, 63, 64, 63.5, "SUSPICIOUS"),
    ("https://amazone.com/", "amazone.com", 2.91, None, 0, 0, 0, 0, 0.0, "SAFE"),
    ("http://spam-farm.example.org/en/728?utm_source=feed", "spam-farm.example.org", 3.56, None, 0, 2, 26, 24, 25.0, "SAFE"),
    ("https://netfiix.top//a", "netfiix.top", 3.10, "netflix", 0, 0, 40, 48, 44.0, "SUSPICIOUS"),
    ("http://10.0.0.1/login/verify?session=1&next=/a@b", "10.0.0.1", 1.56, None, 2, 5, 70, 64, 67.0, "PHISHING"),
]


def table(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, url string")


def test_golden_rows(spark):
    df = table(spark, [g[0] for g in GOLDEN])
    rows = urls.url_heuristic_score(df).orderBy("id").collect()
    got = [
        (r.url, r.host, r.hostname_entropy, r.typosquat_brand, len(r.suspicious_keywords),
         r.special_char_count, r.rule_score, r.ml_score)
        for r in rows
    ]
    assert got == [g[:8] for g in GOLDEN]
    scans = score_urls(df).orderBy("id").collect()
    assert [(s.risk_score, s.verdict) for s in scans] == [g[8:] for g in GOLDEN]


def test_bad_addresses_become_error_rows(spark):
    bad = ["http://h:abc/", "http://[::1", "http://h:70000/", "http://x]y/", None]
    rows = score_urls(table(spark, bad)).orderBy("id").collect()
    assert [r.verdict for r in rows[:4]] == ["ERROR"] * 4
    assert all(r.risk_score == 0.0 for r in rows[:4])
    assert rows[4].verdict == "SAFE"


def test_parts_follow_the_lenient_rules(spark):
    cases = {
        "http://a@b@Host.Example:0080/p;x=1/q;y?z;w#f": ("host.example", 80, "/p;x=1/q", "z;w"),
        "ftp://h/p;type=a": ("h", None, "/p", ""),
        "http://[2001:DB8::1]:8080/x": ("2001:db8::1", 8080, "/x", ""),
        "HTTP://": ("", None, "", ""),
        "a.com:99/x": ("a.com", 99, "/x", ""),
        "http://a.com\t/x\n": ("a.com", None, "/x", ""),
        "http:///path": ("", None, "/path", ""),
        "odd://h/p;x": ("h", None, "/p;x", ""),
    }
    rows = urls.url_parts(table(spark, list(cases))).orderBy("id").collect()
    assert [(r.host, r.port, r.path, r.query) for r in rows] == list(cases.values())
    assert all(r.error is None for r in rows)


def test_checks_of_one_address(spark):
    [row] = urls.url_checks(table(spark, ["http://g00gle-account.tk/verify?redirect=1"])).collect()
    assert [(c.name, c.status, c.detail) for c in row.checks] == [
        ("URL Length", "pass", "42 characters (normal)"),
        ("IP-based Hostname", "pass", "Uses domain name"),
        ("HTTPS Protocol", "fail", "No HTTPS - insecure connection"),
        ("Suspicious TLD", "fail", 'TLD ".tk" is commonly used in phishing'),
        ("High Entropy Hostname", "fail", "Entropy: 3.62 (random-looking domain)"),
        ("Typosquatting Detected", "fail", 'Impersonating "google"'),
        ("Suspicious Keywords", "fail", "Found: verify, account"),
        ("Suspicious Parameters", "fail", "Query contains sensitive parameter names"),
    ]


def test_validation(spark):
    values = ["  example.com ", "http://1.2.3.4/x", "", "no spaces here", "http://a.com:80/", "localhost"]
    accepted, rejected = urls.split_validated(table(spark, values))
    assert {r.url for r in accepted.collect()} == {"example.com", "http://1.2.3.4/x"}
    assert {r.reject_reason for r in rejected.collect()} == {"URL is required", "Invalid URL format"}


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://www.forums.bbc.co.uk/x", ("www.forums", "bbc", "co.uk")),
        ("user@shop.example.com.au:80/a", ("shop", "example", "com.au")),
        ("http://10.1.2.3/x", ("", "10.1.2.3", "")),
        ("999.1.1.1", ("999.1.1", "1", "")),
        ("localhost", ("", "localhost", "")),
        ("co.uk", ("", "", "co.uk")),
        ("a.b.www.ck", ("a.b", "www", "ck")),
        ("a.b.other.ck", ("a", "b", "other.ck")),
        ("x.unknownsuffix", ("x", "unknownsuffix", "")),
    ],
)
def test_registrable_domain(spark, url, expected):
    [row] = urls.registrable_domain(table(spark, [url]), "url").collect()
    assert (row.subdomain, row.domain, row.suffix) == expected


def test_filter_on_a_score_is_not_inlined(spark):
    df = score_urls(table(spark, ["https://www.google.com/"])).filter("verdict = 'PHISHING'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000
    assert df.count() == 0


def test_score_bounds(spark):
    nasty = "http://user@10.0.0.1:99/login/verify/update?token=" + "@!$" * 40
    row = score_urls(table(spark, [nasty])).select("details.layer_scores.*", "risk_score").head()
    assert 0 <= row.rule_based <= 100 and 0 <= row.risk_score <= 100


def test_model_features_of_prefixed_address(spark):
    row = urls.url_model_features(table(spark, ["HTTPS://www.Login.example.tk/a-b?x=1"])).head()
    assert row.url_length == len("login.example.tk/a-b?x=1")
    assert (row.path_length, row.sus_tld, row.sus_keyword_count, row.has_ip) == (8, 1, 1, 0)
    assert (row.subdomain_len, row.domain_len) == (5, 7)


def test_scan_reads_only_the_address_column(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    df = score_urls(pages.select(F.col("page_id").alias("id"), "url"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "Exchange" not in plan
