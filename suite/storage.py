"""History, source, sink and stream queries with their SQL checks."""

from pyspark.sql import functions as F

from riskspark.functions.staging import staging_path
from riskspark.functions.text import clean_text, collapse_ws
from riskspark.operators import history, sampling, textmodel, trees
from riskspark.operators.ensemble import predict_batch
from riskspark.plans.scans import score_urls
from riskspark.sources import maildir, readers, writers
from riskspark.streaming import navigation
from suite import training
from suite.registry import query
from suite.training import MODEL, clean_sql
from suite.urls import url_ctes
from suite.views import cte

SCANS = cte("v_scans")
TIME = "yyyy-MM-dd HH:mm:ss"
TIME_SQL = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"

# -- history ------------------------------------------------------------------


def listing(df):
    return df.withColumn("created_at", F.date_format("created_at", TIME))


ROWS = f"SELECT id, scan_type, scan_summary, risk_score, verdict, {TIME_SQL} AS created_at FROM (SELECT * FROM v_scans ORDER BY v_scans.created_at DESC, id DESC"


@query(
    "history_stats",
    f"""WITH {SCANS} SELECT count(*) AS total_scans, count(*) FILTER (verdict = 'PHISHING') AS phishing_caught,
    count(*) FILTER (verdict = 'SUSPICIOUS') AS suspicious_count, count(*) FILTER (verdict = 'SAFE') AS safe_count FROM v_scans""",
)
def _(t):
    return history.stats(t.view("v_scans"))


@query("history_page", f"WITH {SCANS} {ROWS} LIMIT 20 OFFSET 40)")
def _(t):
    return listing(history.history_page(t.view("v_scans"), 3, 20))


@query("history_deep_page", f"WITH {SCANS} {ROWS} LIMIT 20 OFFSET 13980)")
def _(t):
    return listing(history.history_page(t.view("v_scans"), 700, 20))


@query("history_page_info", f"WITH {SCANS} SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM v_scans")
def _(t):
    return history.page_info(t.view("v_scans"))


@query(
    "history_next_page",
    f"WITH {SCANS} SELECT id, verdict FROM (SELECT * FROM v_scans WHERE created_at < TIMESTAMP '1997-01-01' OR (created_at = TIMESTAMP '1997-01-01' AND id < 500) ORDER BY created_at DESC, id DESC LIMIT 20)",
)
def _(t):
    at = F.lit("1997-01-01").cast(t.view("v_scans").schema["created_at"].dataType)
    return history.history_after(t.view("v_scans"), at, 500).select("id", "verdict")


@query("history_recent", f"WITH {SCANS} {ROWS} LIMIT 5)")
def _(t):
    return listing(history.recent(t.view("v_scans")))


@query("history_verdict_share", f"WITH {SCANS} SELECT verdict, count(*) AS n FROM v_scans GROUP BY 1")
def _(t):
    return history.verdict_share(t.view("v_scans"))


@query(
    "history_weekly_activity",
    f"WITH {SCANS} SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week_start, count(*) AS n FROM v_scans GROUP BY 1",
)
def _(t):
    df = history.weekly_activity(t.view("v_scans"))
    return df.withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd"))


def stored(t):
    """URL scans appended to a fresh history and read back."""
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("id").cast("int"))
    scans = score_urls(t.view("v_urls")).filter("error IS NULL").withColumn("created_at", start)
    path = staging_path(t.spark, "history")
    writers.append_scans(scans, path)
    return t.spark.read.parquet(path)


STORED = """SELECT id, 'url' AS scan_type, left(CASE WHEN host <> '' THEN host ELSE left(url, 50) END, 255) AS scan_summary,
  ((rule_score + ml_score) / 2.0)::DOUBLE AS risk_score,
  CASE WHEN rule_score + ml_score >= 132 THEN 'PHISHING' WHEN rule_score + ml_score >= 62 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict"""


@query("sink_scan_history", f"WITH {cte('v_urls')}, {url_ctes('v_urls')} {STORED} FROM s WHERE error IS NULL")
def _(t):
    return stored(t).select("id", "scan_type", "scan_summary", "risk_score", "verdict")


@query(
    "history_records",
    f"""WITH {cte('v_urls')}, {url_ctes('v_urls')} {STORED}, rule_score::DOUBLE AS rule_based, checks,
    strftime(TIMESTAMP '2024-01-01' + to_minutes(id), '%Y-%m-%dT%H:%M:%S') AS created_at FROM s WHERE error IS NULL""",
)
def _(t):
    return history.to_records(stored(t)).select(
        "id", "scan_type", "scan_summary", "risk_score", "verdict",
        "details.layer_scores.rule_based", "details.checks", "created_at",
    )


# -- sources --------------------------------------------------------------------


def written(t, df, name, fmt="csv", **options):
    path = staging_path(t.spark, name)
    df.write.options(**options).format(fmt).save(path)
    return path


KINDS = "CASE page_id % 5 WHEN 0 THEN 'benign' WHEN 1 THEN 'phishing' WHEN 2 THEN 'malware' WHEN 3 THEN 'defacement' ELSE 'other' END"


@query(
    "source_labeled_urls",
    "SELECT url, (page_id % 5 IN (1, 2, 3))::BIGINT AS label FROM pages",
)
def _(t):
    df = t.table("pages").selectExpr("url", f"{KINDS} AS type")
    return readers.read_labeled_urls(t.spark, written(t, df, "urls", header=True, escape='"'))


@query("source_phish_urls", "SELECT url, 1::BIGINT AS label FROM pages")
def _(t):
    df = t.table("pages").selectExpr("page_id AS phish_id", "url", "'yes' AS verified")
    return readers.read_phish_urls(t.spark, written(t, df, "phish", header=True, escape='"'))


@query("source_top_sites", "SELECT url, 0::BIGINT AS label FROM pages WHERE page_id % 7 <> 3")
def _(t):
    line = "CASE WHEN page_id % 7 = 3 THEN 'broken line, ' || url || ',x,y' ELSE page_id || ',' || url END AS value"
    return readers.read_top_sites(t.spark, written(t, t.table("pages").selectExpr(line), "sites", "text"))


@query(
    "source_arff",
    "SELECT (page_id % 3) - 1.0::DOUBLE AS having_ip, length(html)::DOUBLE AS page_size, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b c' END AS kind, (page_id % 4 = 0)::BIGINT AS \"Result\" FROM pages",
)
def _(t):
    head = [
        "% website features", "@relation phishing", "@attribute having_ip { -1,0,1 }",
        "@attribute page_size numeric", "@attribute kind {a,'b c'}", "@attribute Result { -1,1 }", "", "@data",
    ]
    lines = t.spark.createDataFrame([(h,) for h in head], "value string").coalesce(1)
    body = t.table("pages").selectExpr(
        "concat_ws(',', page_id % 3 - 1, length(html), if(page_id % 2 = 0, 'a', \"'b c'\"), if(page_id % 4 = 0, -1, 1)) AS value"
    )
    return readers.read_arff(t.spark, written(t, lines.union(body), "arff", "text"))


@query(
    "source_text_corpus",
    f"""SELECT 0::BIGINT AS src_ord, Body AS text, ({training.COERCED})::BIGINT AS label FROM ({training.LABELED_SQL})
    UNION ALL SELECT 1, text, 1 FROM conversations""",
)
def _(t):
    main = written(t, training.labeled(t).select("Body", "Class"), "main", header=True, escape='"')
    extra = written(t, t.table("conversations").select("text"), "extra", header=True, escape='"')
    specs = [{"path": main, "multi_line": True}, {"path": extra, "default_label": 1, "multi_line": True}]
    return readers.read_text_corpus(t.spark, specs).select("src_ord", "text", "label")


@query(
    "source_sms_tsv",
    "SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, (turn % 2)::BIGINT AS label FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''",
)
def _(t):
    label = F.when(F.col("turn") % 2 == 1, "spam").otherwise("ham")
    line = F.concat(label, F.lit("\t"), collapse_ws(F.col("text"))).alias("value")
    df = t.table("conversations").filter(collapse_ws(F.col("text")) != "").select(line)
    return readers.read_sms_tsv(t.spark, written(t, df, "sms", "text"))


# Raw messages: one plain part, one html part, or several parts with an attachment.
RAW_MAIL = """SELECT 'mail/' || doc_id || '.eml' AS path, CAST(
  'From: Sender <s' || doc_id || '@example.com>' || chr(10) || 'To: user@example.net' || chr(10)
  || CASE WHEN doc_id % 4 = 1 THEN 'Reply-To: other@evil.tk' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 = 2 THEN 'Authentication-Results: mx; spf=pass dkim=fail' || chr(10) ELSE '' END
  || 'Subject: Message ' || doc_id || chr(10) || 'MIME-Version: 1.0' || chr(10)
  || CASE doc_id % 3
    WHEN 0 THEN 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10) || text
    WHEN 1 THEN 'Content-Type: text/html; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10) || '<p>' || text || '</p> https://example.com/' || doc_id
    ELSE 'Content-Type: multipart/mixed; boundary=zzsplitzz' || chr(10) || chr(10)
      || '--zzsplitzz' || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(10) || 'Content-Transfer-Encoding: 8bit' || chr(10) || chr(10) || text || chr(10)
      || '--zzsplitzz' || chr(10) || 'Content-Type: application/octet-stream' || chr(10) || 'Content-Disposition: attachment; filename="run' || doc_id || '.exe"' || chr(10) || chr(10) || 'AAAA' || chr(10)
      || '--zzsplitzz--' || chr(10) END AS BINARY) AS content
FROM {documents}"""


def raw_mail(t):
    return t.spark.sql(RAW_MAIL, documents=t.table("documents"))


@query(
    "source_mail_messages",
    """SELECT 'mail/' || doc_id || '.eml' AS path, 'Sender <s' || doc_id || '@example.com>' AS sender, 'Message ' || doc_id AS subject,
      CASE WHEN doc_id % 4 = 1 THEN 'other@evil.tk' ELSE '' END AS reply_to,
      CASE WHEN doc_id % 5 = 2 THEN 'pass' ELSE 'unknown' END AS spf_status, CASE WHEN doc_id % 5 = 2 THEN 'fail' ELSE 'unknown' END AS dkim_status,
      CASE WHEN doc_id % 3 = 1 THEN '' ELSE text END AS body_text,
      CASE WHEN doc_id % 3 = 1 THEN '<p>' || text || '</p> https://example.com/' || doc_id ELSE '' END AS body_html,
      CASE WHEN doc_id % 3 = 2 THEN 'run' || doc_id || '.exe' ELSE '' END AS attachments,
      len(regexp_extract_all(CASE WHEN doc_id % 3 = 1 THEN text || '</p> https://example.com/' || doc_id ELSE text END, 'https?://[^\\s<>"'']+|www\\.[^\\s<>"'']+'))::BIGINT AS n_links
    FROM documents""",
)
def _(t):
    df = maildir.mail_rows(maildir.parse_mail(raw_mail(t)))
    return df.select(
        "path", "sender", "subject", "reply_to", "spf_status", "dkim_status", "body_text",
        "body_html", "attachments", F.size("links").alias("n_links"),
    )


@query(
    "source_mail_corpus_text",
    """SELECT 'mail/' || doc_id || '.eml' AS path, regexp_replace('subject: Message ' || doc_id || chr(10) || 'from: Sender <s' || doc_id || '@example.com>' || chr(10) || 'to: user@example.net' || chr(10) || chr(10)
      || CASE WHEN doc_id % 3 = 1 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END, '\\s+$', '') AS text FROM documents""",
)
def _(t):
    return maildir.corpus_text(maildir.parse_mail(raw_mail(t))).select("path", "text")


# -- sinks ----------------------------------------------------------------------

CORPUS = f"""WITH {cte("v_corpus")}, c AS (SELECT id, {clean_sql("text")} AS text, label FROM v_corpus),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn, count(*) OVER () AS n FROM c)"""


@query(
    "sink_corpus_splits",
    f"{CORPUS} SELECT text, label::VARCHAR AS label, CASE WHEN rn <= floor(0.7::DOUBLE * n) THEN 'train' WHEN rn <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM r",
)
def _(t):
    df = t.view("v_corpus").withColumn("text", clean_text(F.col("text")))
    path = staging_path(t.spark, "splits")
    writers.write_splits(sampling.assign_split(df), path)
    return t.spark.read.options(header=True, escape='"').csv(path)


@query(
    "sink_report",
    f"""WITH {MODEL}, r AS (SELECT pr.id, (pr.id % 83) / 83.0::DOUBLE AS second_proba, p AS naive_bayes_proba, substr(v_corpus.text, 1, 100) AS text_snippet
      FROM pr JOIN v_corpus ON v_corpus.id = pr.id)
    SELECT id, text_snippet, round(second_proba, 6)::DOUBLE AS second_proba, round(naive_bayes_proba, 6)::DOUBLE AS naive_bayes_proba, round(0.7 * second_proba + 0.3 * naive_bayes_proba, 6)::DOUBLE AS final_proba,
    CASE WHEN 0.7 * second_proba + 0.3 * naive_bayes_proba >= 0.61 THEN 'Phishing' ELSE 'Legitimate' END AS prediction FROM r""",
)
def _(t):
    df = t.view("v_corpus").withColumn("p2", (F.col("id") % 83) / F.lit(83.0))
    path = staging_path(t.spark, "report")
    writers.write_report(predict_batch(df, training.fitted(t), "p2"), path)
    back = t.spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    numbers = [F.round(F.col(c).cast("double"), 6).alias(c) for c in ("second_proba", "naive_bayes_proba", "final_proba")]
    return back.select(F.col("id").cast("long"), "text_snippet", *numbers, "prediction")


@query("sink_nb_model", f"WITH {MODEL} SELECT id, round(p, 6)::DOUBLE AS p_nb FROM pr")
def _(t):
    path = staging_path(t.spark, "nb")
    writers.save_nb(t.spark, training.fitted(t), path)
    df = textmodel.predict_nb(writers.load_nb(t.spark, path), t.view("v_corpus"))
    return df.select("id", F.round("p_nb", 6).alias("p_nb"))


@query("sink_tree_model")
def _(t):
    df, model = training.boosted(t)
    path = staging_path(t.spark, "trees")
    writers.save_trees(model, path)
    scored = trees.predict_trees(df, writers.load_trees(path))
    return scored.select("id", F.round("probability", 6).alias("probability"))


@query("sink_metrics", training.BY_SPLIT)
def _(t):
    report = training.by_split(t)
    path = staging_path(t.spark, "metrics")
    writers.write_metrics(report, path)
    return training.rounded(t.spark.read.schema(report.schema).json(path))


# -- streams ----------------------------------------------------------------------

NAV = cte("v_nav")
OPEN = """nav AS (SELECT * FROM v_nav WHERE (starts_with(url, 'http://') OR starts_with(url, 'https://'))
  AND NOT starts_with(url, 'http://localhost:5000') AND NOT contains(url, 'localhost') AND NOT contains(url, '127.0.0.1'))"""
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
SCORED = f"u AS (SELECT DISTINCT url FROM nav), {url_ctes('u', '0 AS one')}, z AS (SELECT url, error, ((rule_score + ml_score) / 2.0)::DOUBLE AS risk FROM s)"


def nav_stream(t):
    """The navigation view as a stream over files written for it."""
    nav = t.view("v_nav").withColumn("ts", F.col("ts").cast("timestamp"))
    path = written(t, nav, "nav", "parquet")
    return t.spark.readStream.schema(nav.schema).parquet(path)


def drained(t, stream, name):
    """Run a stream over all available input and read what it wrote."""
    out, state = staging_path(t.spark, name), staging_path(t.spark, f"{name}-state")
    run = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
    )
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query("nav_scannable", f"WITH {NAV}, {OPEN} SELECT id, url FROM nav")
def _(t):
    return drained(t, navigation.scannable(nav_stream(t)).select("id", "url"), "scannable")


CACHE = f"""WITH RECURSIVE {NAV}, {OPEN}, ev AS (SELECT DISTINCT url, ts FROM nav),
due AS (SELECT url, ts, min(ts) OVER (PARTITION BY url ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM ev),
sc AS (SELECT url, min(ts) AS ts FROM ev GROUP BY url UNION ALL SELECT due.url, due.nxt FROM sc JOIN due ON due.url = sc.url AND due.ts = sc.ts WHERE due.nxt IS NOT NULL)"""


@query("nav_result_cache", f"{CACHE} SELECT url, {STAMP} AS ts FROM sc")
def _(t):
    out, state = staging_path(t.spark, "cache"), staging_path(t.spark, "cache-state")
    navigation.cache_stream(navigation.scannable(nav_stream(t)), out, state).awaitTermination()
    df = t.spark.read.schema("url string, ts timestamp").parquet(f"{out}/due").drop("batch")
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "nav_shared_scans",
    f"""WITH {NAV}, {OPEN}, {SCORED} SELECT nav.id, CASE WHEN error IS NULL THEN risk ELSE 0 END AS risk_score FROM nav JOIN z USING (url)""",
)
def _(t):
    out, state = staging_path(t.spark, "shared"), staging_path(t.spark, "shared-state")

    def write(batch, number):
        scored = navigation.score_batch(batch).select("id", "risk_score")
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = navigation.scannable(nav_stream(t))
    run = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return t.spark.read.parquet(out).select("id", "risk_score")


@query(
    "nav_allow_once",
    f"""WITH {NAV}, o AS (SELECT *, lag(kind) OVER w AS before, lag(ts) OVER w AS allowed_at FROM v_nav WINDOW w AS (PARTITION BY url ORDER BY ts, kind, id)),
    al AS (SELECT DISTINCT url, ts FROM v_nav WHERE kind = 'allow'),
    tm AS (SELECT o.id, min(al.ts) AS first_timer FROM o JOIN al ON al.url = o.url AND al.ts <= o.allowed_at AND al.ts > o.allowed_at - INTERVAL 5 MINUTE
      WHERE o.kind = 'nav' AND o.before = 'allow' GROUP BY o.id)
    SELECT o.id, o.url, strftime(o.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, coalesce(first_timer + INTERVAL 5 MINUTE > o.ts, false) AS allowed FROM o LEFT JOIN tm ON tm.id = o.id WHERE o.kind = 'nav'""",
)
def _(t):
    out, state = staging_path(t.spark, "allowed"), staging_path(t.spark, "allowed-state")
    navigation.permission_stream(nav_stream(t), out, state).awaitTermination()
    df = t.spark.read.schema("id long, url string, ts timestamp, allowed boolean").parquet(f"{out}/allowed").drop("batch")
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "nav_actions",
    f"""WITH {NAV}, {OPEN}, {SCORED} SELECT nav.id, CASE WHEN error IS NOT NULL THEN 'allow' WHEN risk >= 70 THEN 'block' WHEN risk >= 31 THEN 'warn' ELSE 'allow' END AS action,
      CASE WHEN error IS NOT NULL THEN '!' ELSE risk::VARCHAR END AS badge FROM nav JOIN z USING (url)""",
)
def _(t):
    scored = navigation.score_stream(navigation.scannable(nav_stream(t)))
    return drained(t, scored.select("id", "action", "badge"), "actions")


@query(
    "nav_history",
    f"""{CACHE}, {SCORED} SELECT 'url' AS scan_type, strftime(ts, '%Y-%m-%d') AS created_date, {STAMP} AS created_at, CASE WHEN error IS NULL THEN risk ELSE 0 END AS risk_score,
    CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN risk >= 66 THEN 'PHISHING' WHEN risk >= 31 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict FROM sc JOIN z USING (url)""",
)
def _(t):
    out, state = staging_path(t.spark, "scans"), staging_path(t.spark, "scans-state")
    navigation.scan_stream(nav_stream(t), out, state).awaitTermination()
    return writers.read_history(t.spark, f"{out}/history").select(
        "scan_type", F.date_format("created_date", "yyyy-MM-dd").alias("created_date"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), "risk_score", "verdict",
    )


@query(
    "nav_live_counts",
    f"""WITH {NAV}, {OPEN}, {SCORED} SELECT CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN risk >= 66 THEN 'PHISHING' WHEN risk >= 31 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS verdict, count(*) AS n
    FROM nav JOIN z USING (url) GROUP BY 1""",
)
def _(t):
    out, state = staging_path(t.spark, "counts"), staging_path(t.spark, "counts-state")
    scored = navigation.score_stream(navigation.scannable(nav_stream(t)))
    navigation.sink_counts(scored, out, state).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


JOB = CACHE[: CACHE.index("ev AS")].rstrip() + """ o AS (SELECT *, lag(kind) OVER w AS before, lag(ts) OVER w AS allowed_at FROM nav WINDOW w AS (PARTITION BY url ORDER BY ts, kind, id)),
    al AS (SELECT DISTINCT url, ts FROM nav WHERE kind = 'allow'),
    tm AS (SELECT o.id, min(al.ts) AS first_timer FROM o JOIN al ON al.url = o.url AND al.ts <= o.allowed_at AND al.ts > o.allowed_at - INTERVAL 5 MINUTE
      WHERE o.kind = 'nav' AND o.before = 'allow' GROUP BY o.id),
    dn AS (SELECT o.id, o.url, o.ts, coalesce(first_timer + INTERVAL 5 MINUTE > o.ts, false) AS allowed FROM o LEFT JOIN tm ON tm.id = o.id WHERE o.kind = 'nav'),
    ev AS (SELECT DISTINCT url, ts FROM dn WHERE NOT allowed),
""" + CACHE[CACHE.index("due AS") :]


@query(
    "nav_job",
    f"""{JOB}, {SCORED}, pick AS (SELECT dn.id, dn.url, CASE WHEN allowed THEN 'allowed'
      WHEN sc.url IS NOT NULL AND row_number() OVER (PARTITION BY dn.url, dn.ts, allowed ORDER BY dn.id) = 1 THEN 'scan' ELSE 'cached' END AS source
      FROM dn LEFT JOIN sc ON sc.url = dn.url AND sc.ts = dn.ts)
    SELECT id, source, CASE WHEN source = 'allowed' OR error IS NOT NULL THEN 'allow' WHEN risk >= 70 THEN 'block' WHEN risk >= 31 THEN 'warn' ELSE 'allow' END AS action,
      CASE WHEN source = 'allowed' THEN '⚠' WHEN error IS NOT NULL THEN '!' ELSE risk::VARCHAR END AS badge,
      CASE WHEN source = 'scan' THEN CASE WHEN error IS NULL THEN risk ELSE 0 END END::DOUBLE AS stored_score,
      CASE WHEN source = 'scan' THEN CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN risk >= 66 THEN 'PHISHING' WHEN risk >= 31 THEN 'SUSPICIOUS' ELSE 'SAFE' END END AS stored_verdict
    FROM pick JOIN z USING (url)""",
)
def _(t):
    out, state = staging_path(t.spark, "job"), staging_path(t.spark, "job-state")
    navigation.navigation_job(nav_stream(t), out, state).awaitTermination()
    stored = writers.read_history(t.spark, f"{out}/history").select(
        F.col("id").alias("scan"), F.col("risk_score").alias("stored_score"), F.col("verdict").alias("stored_verdict")
    )
    acted = t.spark.read.parquet(f"{out}/actions")
    acted = acted.withColumn("scan", F.when(F.col("source") == "scan", F.xxhash64("url", "ts")))
    return acted.join(stored, "scan", "left").select("id", "source", "action", "badge", "stored_score", "stored_verdict")
