"""Decorated views: one SQL text per view that runs unchanged in both engines.

The given tables hold invented prose without the words and addresses that the rules look
for. Each view keeps every row, and every text whole, and adds such tokens by key.
`{table}` names a given table.
"""

VIEWS: dict[str, str] = {}

VIEWS["v_urls"] = """
SELECT page_id AS id, CASE page_id % 32
  WHEN 10 THEN 'http://192.168.4.7/login?from=' || url
  WHEN 11 THEN 'http://g00gle-account.tk/verify?redirect=' || page_id
  WHEN 12 THEN 'https://bit.ly/x' || page_id
  WHEN 13 THEN 'http://user@paypa1.com:8080/secure/login/update?token=a' || page_id
  WHEN 14 THEN 'evil.com/?r=' || url
  WHEN 15 THEN 'https://chase.com/' || page_id
  WHEN 16 THEN 'https://a.b.c.d.example.org/' || page_id
  WHEN 17 THEN 'http://my-bank-login-verify.xyz/account/confirm/password/' || url
  WHEN 18 THEN 'https://amazone.com/' || page_id || ';v=1'
  WHEN 19 THEN 'https://netfiix.top//a' || page_id
  WHEN 20 THEN 'http://10.0.0.' || (page_id % 256) || '/login/verify?session=1&next=/a@b'
  WHEN 21 THEN 'http://h:abc/' || page_id
  WHEN 22 THEN 'http://[::1'
  WHEN 23 THEN 'http://[::1]:8080/x' || page_id
  WHEN 24 THEN 'www.Google.com/search?q=' || page_id
  WHEN 25 THEN 'https://mail.google.com:443/u/' || page_id
  WHEN 26 THEN 'HTTPS://WWW.PayPal.COM/signin?return=/x' || page_id
  WHEN 27 THEN 'http://a@b@evil.co.uk:99999/p' || page_id
  WHEN 28 THEN '  ' || url || ' '
  WHEN 29 THEN ''
  WHEN 30 THEN 'http://foo.bar.ck/x?next=1' || page_id
  WHEN 31 THEN 'not a url ' || page_id
  ELSE url END AS url
FROM {pages}
"""

VIEWS["v_sms"] = """
SELECT conv_id * 1000 + turn AS id,
  CASE (conv_id * 7 + turn) % 12
    WHEN 1 THEN text || ' URGENT: account suspended, verify at http://g00gle-account.tk/verify?redirect=1'
    WHEN 2 THEN text || ' Congratulations winner! Claim your cash prize, reply now'
    WHEN 3 THEN text || ' Your OTP is ' || conv_id || ', do not share'
    WHEN 4 THEN 'I wonder who came first in the taxi. ' || text
    WHEN 5 THEN text || ' Unauthorized payment blocked. Legal action within 24 hours. Call your bank. http://192.168.4.7/login'
    WHEN 6 THEN 'Click below to go to the site. ' || text
    WHEN 7 THEN text || ' see www.example.com/a bit.ly/abc http://h:abc/ tinyurl.com/x https://chase.com/ http://10.0.0.1/login/verify?session=1'
    WHEN 8 THEN 'tap'
    WHEN 9 THEN '   '
    ELSE text END AS message,
  CASE (conv_id + turn) % 5
    WHEN 0 THEN ''
    WHEN 1 THEN '' || (10000 + conv_id % 80000)
    WHEN 2 THEN '+' || (12025550000 + conv_id)
    WHEN 3 THEN 'ACME-' || turn
    ELSE '' || (1000000 + conv_id) END AS sender
FROM {conversations}
"""

VIEWS["v_mail"] = """
SELECT doc_id AS id,
  CASE doc_id % 7
    WHEN 0 THEN 'Alice <alice@example.com>'
    WHEN 1 THEN 'Bank <b@mailinator.com>'
    WHEN 2 THEN 'b@y.org'
    WHEN 3 THEN ''
    WHEN 4 THEN 'no address here'
    WHEN 5 THEN 'X <x@Mail.RU>'
    ELSE 'Team <team@corp.co.uk>' END AS sender,
  'user' || doc_id || '@example.net' AS recipient,
  CASE doc_id % 6
    WHEN 0 THEN 'Hello'
    WHEN 1 THEN 'Security alert'
    WHEN 2 THEN ''
    WHEN 3 THEN 'Last chance'
    WHEN 4 THEN 'Quarterly report ' || doc_id
    ELSE 'Account notice: action required' END AS subject,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Mon, 01 Jan 2024 00:00:00 +0000' END AS date,
  CASE doc_id % 5
    WHEN 0 THEN ''
    WHEN 1 THEN 'c@evil.tk'
    WHEN 2 THEN 'b@y.org'
    WHEN 3 THEN 'nobody'
    ELSE 'Alice <alice@example.com>' END AS reply_to,
  CASE doc_id % 8
    WHEN 0 THEN 'mx.example; spf=pass; dkim=pass'
    WHEN 1 THEN 'mx.example; SPF=fail; DKIM=fail'
    WHEN 2 THEN 'spf=softfail dkim=pass'
    WHEN 3 THEN ''
    WHEN 4 THEN 'spf=none dkim=none'
    WHEN 5 THEN 'spf=pass spf=fail'
    ELSE 'spf=pass; dkim=fail' END AS auth_results,
  CASE doc_id % 9
    WHEN 8 THEN ''
    ELSE text || CASE doc_id % 10
      WHEN 1 THEN ' Dear customer, your account has been suspended. Click here to verify your account immediately. http://g00gle-account.tk/verify?redirect=1'
      WHEN 2 THEN ' https://www.google.com/'
      WHEN 3 THEN ' You have won! Update your billing within 24 hours'
      WHEN 4 THEN ' www.example.com/a, (http://a.example.com/1) http://a.example.com/2 http://a.example.com/3 http://a.example.com/4 http://a.example.com/5 http://a.example.com/6 http://a.example.com/7 http://a.example.com/8 http://a.example.com/9 http://user@paypa1.com:8080/secure/login/update?token=a http://a.example.com/1'
      WHEN 5 THEN ' Send your password. http://h:abc/ https://bit.ly/x1'
      WHEN 6 THEN ' We have detected unusual activity'
      ELSE '' END END AS body_text,
  CASE WHEN doc_id % 3 = 0 THEN '<p>' || text || '</p><a href="https://chase.com/' || doc_id || '">here</a>' ELSE '' END AS body_html,
  CASE doc_id % 5 WHEN 1 THEN 'http://192.168.4.7/login https://example.com/b' ELSE '' END AS links_text,
  CASE doc_id % 11
    WHEN 1 THEN 'invoice.EXE'
    WHEN 2 THEN 'r.pdf'
    WHEN 3 THEN 'a.tar.gz;b.js;c.Scr'
    WHEN 4 THEN 'notes.txt;x.json'
    ELSE '' END AS files
FROM {documents}
"""

VIEWS["v_parts"] = """
SELECT doc_id AS id, 0 AS ord, 'text/plain' AS content_type, '' AS disposition, '' AS filename, text
FROM {documents} WHERE doc_id % 6 <> 5
UNION ALL
SELECT doc_id, 1, 'text/html', 'inline', '', '<p>' || text || '</p>'
FROM {documents} WHERE doc_id % 3 = 0
UNION ALL
SELECT doc_id, 2, 'text/plain', 'attachment; filename=a.txt',
  CASE WHEN doc_id % 8 = 2 THEN '' ELSE 'a' || doc_id || '.txt' END, 'attached text'
FROM {documents} WHERE doc_id % 4 = 2
UNION ALL
SELECT doc_id, 3, 'text/plain', '', '', 'Second body of ' || doc_id || ': ' || source
FROM {documents} WHERE doc_id % 5 = 1
UNION ALL
SELECT doc_id, 4, 'application/pdf', 'attachment', 'scan.pdf', ''
FROM {documents} WHERE doc_id % 7 = 3
"""

VIEWS["v_scans"] = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'email' ELSE 'sms' END AS scan_type,
  'summary of ' || o_custkey AS scan_summary,
  CAST((o_orderkey * 37) % 1001 AS DOUBLE) / 10 AS risk_score,
  CASE WHEN (o_orderkey * 37) % 1001 >= 660 THEN 'PHISHING'
       WHEN (o_orderkey * 37) % 1001 >= 310 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict,
  o_orderdate AS created_at
FROM {orders}
"""

VIEWS["v_nav"] = """
SELECT e.event_id AS id, e.user_id AS tab, e.ts,
  CASE WHEN e.event_type = 'signup' THEN 'allow' ELSE 'nav' END AS kind,
  CASE e.event_id % 29
    WHEN 1 THEN 'chrome://settings'
    WHEN 2 THEN 'http://localhost:5000/url'
    WHEN 3 THEN 'https://example.com/?to=127.0.0.1'
    WHEN 4 THEN 'http://h:abc/'
    WHEN 5 THEN 'http://g00gle-account.tk/verify?redirect=1'
    WHEN 6 THEN 'http://10.0.0.1/login/verify?session=1&next=/a@b'
    ELSE p.url END AS url
FROM {events} e CROSS JOIN (SELECT max(page_id) + 1 AS n FROM {pages}) c
JOIN {pages} p ON p.page_id = CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE e.event_id % c.n END
"""

VIEWS["v_corpus"] = """
SELECT 0 AS src_ord, d.doc_id AS id,
  d.text || CASE WHEN l.toxic = 1 THEN ' verify account password urgent prize'
                 WHEN d.doc_id % 4 = 0 THEN ' verify meeting notes'
                 ELSE ' team meeting lunch schedule' END AS text,
  CAST(l.toxic AS INT) AS label
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id
"""

VIEWS["v_answers"] = """
SELECT page_id AS id, CASE page_id % 5
  WHEN 1 THEN 'SCORE: ' || (page_id % 140) || chr(10) || 'VERDICT: PHISHING' || chr(10) || 'ANALYSIS: Looks bad. ' || url
  WHEN 2 THEN 'score: 12' || chr(10) || 'verdict: safe' || chr(10) || 'analysis:   fine page  '
  WHEN 3 THEN '**SCORE:** 40 SCORE: 41 VERDICT: MAYBE'
  ELSE 'No structured text for ' || url END AS answer
FROM {pages} WHERE page_id % 5 <> 0
"""

VIEWS["v_probs"] = """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
  CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007 AS p_nb,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 2000 + CASE WHEN o_orderstatus = 'F' THEN 0.4 ELSE 0.0 END AS p_second
FROM {orders}
"""

TABLES = {name: [t for t in (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
) if "{" + t + "}" in text] for name, text in VIEWS.items()}


def cte(name: str) -> str:
    """The view as a common table expression over the plainly named tables."""
    text = VIEWS[name]
    for table in TABLES[name]:
        text = text.replace("{" + table + "}", table)
    return f"{name} AS ({text})"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
