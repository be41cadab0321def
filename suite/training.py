"""Corpus, text-model, evaluation and tree queries with their SQL checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.functions import scoring, text
from riskspark.functions.staging import stage, staging_path
from riskspark.operators import corpus, ensemble, metrics, sampling, textmodel, trees, urls
from riskspark.plans import training as plans
from riskspark.plans.corpus import build_mail_corpus, build_text_corpus, build_url_corpus
from riskspark.plans.scans import score_urls
from suite.registry import query
from suite.views import cte, listed

# -- corpus -----------------------------------------------------------------

# The label spellings that the coercion rule has to tell apart.
SPELLINGS = [
    "1", "0", "Phishing", "legit", "SPAM", "ham", " yes ", "false", "0.7", "0.5", "nan", "unknown",
]
SPELLED = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SPELLINGS)) + " END"
LABELED = f"SELECT doc_id AS id, text AS Body, lang, {SPELLED} AS Class FROM {{documents}}"
LABELED_SQL = LABELED.replace("{documents}", "documents")
COERCED = f"""CASE WHEN list_contains({listed(lexicon.POSITIVE_LABELS)}, trim(lower(Class))) THEN 1
  WHEN list_contains({listed(lexicon.NEGATIVE_LABELS)}, trim(lower(Class))) THEN 0
  WHEN try_cast(Class AS DOUBLE) > 0.5 AND NOT isnan(try_cast(Class AS DOUBLE)) THEN 1 ELSE 0 END"""


def labeled(t):
    return t.spark.sql(LABELED, documents=t.table("documents"))


@query("corpus_columns", f"SELECT Body AS text, Class AS label FROM ({LABELED_SQL})")
def _(t):
    return corpus.normalize_columns(labeled(t).drop("id"))


@query("corpus_labels", f"SELECT id, ({COERCED})::BIGINT AS label FROM ({LABELED_SQL})")
def _(t):
    df = corpus.label_as_int(labeled(t), "Class")
    return df.select("id", F.col("Class").alias("label"))


def clean_sql(col: str) -> str:
    # The references that the tables hold, and a few more, written out.
    html = f"regexp_replace({col}, '(?s)<!--.*?-->|<[!?][^>]*>|</?[A-Za-z][^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        html = f"replace({html}, '{name}', '{char}')"
    out = f"lower(CASE WHEN contains({col}, '<') AND contains({col}, '>') THEN {html} ELSE {col} END)"
    out = f"regexp_replace({out}, '\\s+', ' ', 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9\\s.,!?\\-_:;/@#$%&*()\\[\\]{{}}''\"]+', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(
    "corpus_clean_text",
    f"""SELECT 'document' AS kind, doc_id AS id, {clean_sql("text")} AS cleaned FROM documents
    UNION ALL SELECT 'page', page_id, {clean_sql("html")} FROM pages""",
)
def _(t):
    docs = t.table("documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.clean_text(F.col("text")).alias("cleaned")
    )
    pages = t.table("pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.clean_text(F.col("html")).alias("cleaned")
    )
    return docs.unionByName(pages)


@query(
    "corpus_collapse_whitespace",
    "SELECT doc_id AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM documents",
)
def _(t):
    return t.table("documents").select(
        F.col("doc_id").alias("id"), text.collapse_ws(F.col("text")).alias("collapsed")
    )


SPARSE = "SELECT doc_id AS id, CASE doc_id % 9 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE text END AS text, CASE doc_id % 10 WHEN 3 THEN NULL ELSE doc_id % 2 END AS label FROM {documents}"


@query(
    "corpus_drop_empty",
    f"SELECT id, text, label FROM ({SPARSE.replace('{documents}', 'documents')}) WHERE text <> '' AND label IS NOT NULL",
)
def _(t):
    return corpus.drop_empty(t.spark.sql(SPARSE, documents=t.table("documents")))


# A third of this view is copies of one text; the first copy decides the label.
COPIES = "SELECT doc_id AS row_ord, CASE WHEN doc_id % 3 = 1 THEN 'same text' ELSE text END AS text, doc_id % 2 AS label, doc_id % 4 AS src_ord FROM {documents}"


@query(
    "corpus_dedupe_first",
    f"""SELECT text, label, src_ord, row_ord FROM ({COPIES.replace('{documents}', 'documents')})
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY src_ord, row_ord) = 1""",
)
def _(t):
    df = t.spark.sql(COPIES, documents=t.table("documents"))
    return corpus.dedupe_first(df, "text", ["src_ord", "row_ord"])


@query(
    "corpus_union",
    """SELECT doc_id AS id, text, 0::BIGINT AS label FROM documents
    UNION ALL SELECT conv_id * 1000 + turn, text, 1::BIGINT FROM conversations""",
)
def _(t):
    docs = t.table("documents").select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("label"))
    turns = t.table("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.lit(1).alias("label")
    )
    return corpus.union_all([docs, turns])


@query(
    "corpus_union_missing_columns",
    """SELECT doc_id AS id, n_chars, NULL::BIGINT AS turn FROM documents
    UNION ALL SELECT conv_id * 1000 + turn, NULL, turn FROM conversations""",
)
def _(t):
    docs = t.table("documents").select(F.col("doc_id").alias("id"), "n_chars")
    turns = t.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn")
    return corpus.union_all([docs, turns], allow_missing=True)


EVENT_SQL = "SELECT event_id AS id, event_type AS label FROM events"


MAILS_SQL = """SELECT lpad(doc_id::VARCHAR, 9, '0') || '.eml' AS path, CASE WHEN doc_id % 4 = 1 THEN '  \t' ELSE text END AS text, doc_id % 3 % 2 AS label FROM documents"""


@query(
    "corpus_build_mail",
    f"""WITH m AS ({MAILS_SQL}), c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || path), path) <= 300),
    w AS (SELECT path, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text, label FROM c),
    d AS (SELECT * FROM w WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY label, path) = 1),
    r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || path), path) AS rn, count(*) OVER () AS n FROM d)
    SELECT path, label, md5(text) AS digest, CASE WHEN rn <= floor(0.7::DOUBLE * n) THEN 'train' WHEN rn <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def _(t):
    mails = t.table("documents").select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".eml")).alias("path"),
        F.when(F.col("doc_id") % 4 == 1, "  \t").otherwise(F.col("text")).alias("text"),
        (F.col("doc_id") % 3 % 2).alias("label"),
    )
    built = build_mail_corpus(mails, 300)
    path = staging_path(t.spark, "mail-corpus")
    built.write.partitionBy("split").parquet(path)
    return t.spark.read.parquet(path).select("path", "label", F.md5("text").alias("digest"), "split")


def event_rows(t):
    return t.table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"))


@query(
    "corpus_cap_per_class",
    f"SELECT id, label FROM ({EVENT_SQL}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) <= 1000",
)
def _(t):
    return sampling.cap_per_class(event_rows(t), 1000)


def split_sql(fractions, names, over="") -> str:
    limits, terms = [], []
    for f, n in zip(fractions, names):
        terms.append(f"floor({f}::DOUBLE * n)")
        limits.append(f"WHEN rn <= {' + '.join(terms)} THEN '{n}'")
    return f"""SELECT id, label, CASE {' '.join(limits)} ELSE '{names[-1]}' END AS split FROM (
      SELECT *, row_number() OVER ({over} ORDER BY md5('42:' || id), id) AS rn, count(*) OVER ({over}) AS n FROM ({EVENT_SQL}))"""


@query("corpus_split", split_sql((0.70, 0.15), ("train", "val", "test")))
def _(t):
    return sampling.assign_split(event_rows(t))


@query("corpus_split_two_way", split_sql((0.85,), ("train", "test")))
def _(t):
    return sampling.assign_split(event_rows(t), (0.85,), ("train", "test"))


@query("corpus_split_stratified", split_sql((0.80,), ("train", "test"), "PARTITION BY label"))
def _(t):
    return sampling.assign_split(event_rows(t), (0.80,), ("train", "test"), stratify="label")


@query("corpus_class_counts", "SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1".replace("toxic AS", "toxic::BIGINT AS"))
def _(t):
    return corpus.class_counts(t.table("labels").withColumnRenamed("toxic", "label"))


@query(
    "corpus_take_split",
    f"SELECT id, label FROM ({split_sql((0.70, 0.15), ('train', 'val', 'test'))}) WHERE split = 'val'",
)
def _(t):
    return sampling.take_split(sampling.assign_split(event_rows(t)), "val").select("id", "label")


BUILT = f"""WITH {cte("v_corpus")},
c AS (SELECT src_ord, id, label, {clean_sql("text")} AS text FROM v_corpus),
u AS (SELECT text, label FROM c WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY src_ord, id) = 1)"""


@query(
    "corpus_build",
    f"{BUILT} SELECT text, label::BIGINT AS label FROM u QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || text), text) <= 60",
)
def _(t):
    return build_text_corpus(t.view("v_corpus"), ["src_ord", "id"], max_per_class=60)


# A third of the rows are one url; every copy is a row of its own.
COPIED = "SELECT CASE WHEN event_id % 3 = 0 THEN 'http://hot.example.com/' ELSE 'http://' || event_type || '.example.com/' || event_id % 500 END AS url, user_id % 2 AS label FROM {events}"


@query(
    "corpus_build_urls",
    f"""WITH r AS (SELECT url, label, url || '#' || (row_number() OVER (PARTITION BY url, label) - 1) AS row FROM ({COPIED.replace('{events}', 'events')}))
    SELECT url, label FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row), row) <= 3000""",
)
def _(t):
    return build_url_corpus([t.spark.sql(COPIED, events=t.table("events"))], max_per_class=3000)


# -- text model ---------------------------------------------------------------

FEATURES, MIN_DF = 50_000, 2
STOP = listed(lexicon.STOP_WORDS)


def model_sql(train: str = "true") -> dict[str, str]:
    """CTE chains of the text model, fitted on the rows for which `train` holds."""
    tokens = f"""{cte("v_corpus")},
r0 AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn, count(*) OVER () AS n FROM v_corpus),
w0 AS (SELECT id, label, {train} AS tr, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM r0),
w1 AS (SELECT id, label, tr, [x FOR x IN w IF NOT list_contains({STOP}, x)] AS w FROM w0),
tk AS (SELECT id, label, tr, list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS tokens FROM w1)"""
    vocab = f"""{tokens},
dt AS (SELECT id, label, tr, term, count(*) AS tf FROM (SELECT id, label, tr, unnest(tokens) AS term FROM tk) GROUP BY ALL),
vc AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM dt WHERE tr GROUP BY term HAVING count(*) >= {MIN_DF} ORDER BY cf DESC, term LIMIT {FEATURES}),
nd AS (SELECT count(*) AS n FROM w0 WHERE tr),
vi AS (SELECT term, cf, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM vc, nd)"""
    weights = f"""{vocab},
x0 AS (SELECT id, label, tr, term, tf * idf AS x FROM dt JOIN vi USING (term)),
x AS (SELECT id, label, tr, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM x0)"""
    model = f"""{weights},
sums AS (SELECT label, term, sum(weight) AS s FROM x WHERE tr GROUP BY ALL),
grid AS (SELECT c.label, vi.term, coalesce(s, 0) + 1 AS s FROM vi CROSS JOIN (VALUES (0), (1)) c(label) LEFT JOIN sums ON sums.label = c.label AND sums.term = vi.term),
lp AS (SELECT label, term, ln(s) - ln(sum(s) OVER (PARTITION BY label)) AS l FROM grid),
nb AS (SELECT term, max(l) FILTER (label = 0) AS logp0, max(l) FILTER (label = 1) AS logp1 FROM lp GROUP BY term),
pri AS (SELECT ln(count(*) FILTER (label = 1)::DOUBLE / count(*)) - ln(count(*) FILTER (label = 0)::DOUBLE / count(*)) AS d FROM w0 WHERE tr),
mg AS (SELECT w0.id, w0.label, any_value(d) + coalesce(sum(weight * (logp1 - logp0)), 0) AS m FROM w0 CROSS JOIN pri LEFT JOIN x ON x.id = w0.id LEFT JOIN nb ON nb.term = x.term GROUP BY w0.id, w0.label),
pr AS (SELECT id, label, 1 / (1 + exp(-m)) AS p FROM mg)"""
    return {"tokens": tokens, "vocab": vocab, "weights": weights, "model": model}


TOKENS, VOCAB, WEIGHTS, MODEL = model_sql().values()


@query(
    "text_tokens",
    f"WITH {TOKENS} SELECT id, len(tokens)::BIGINT AS n, md5(array_to_string(tokens, ';')) AS digest FROM tk",
)
def _(t):
    df = textmodel.tokenize(t.view("v_corpus"))
    return df.select("id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", ";")).alias("digest"))


@query("text_vocabulary", f"WITH {VOCAB} SELECT term, cf, df FROM vc")
def _(t):
    return textmodel.corpus_vocabulary(t.view("v_corpus"), max_features=FEATURES, min_df=MIN_DF)


@query("text_tfidf", f"WITH {WEIGHTS} SELECT id, term, round(weight, 6)::DOUBLE AS weight FROM x")
def _(t):
    df = t.view("v_corpus")
    vocab = textmodel.fit_vocabulary(df, max_features=FEATURES, min_df=MIN_DF)
    return textmodel.tfidf(df, vocab).withColumn("weight", F.round("weight", 6))


def fitted(t):
    return textmodel.fit_nb(t.view("v_corpus"), max_features=FEATURES, min_df=MIN_DF)


@query(
    "text_nb_fit",
    f"WITH {MODEL} SELECT nb.term, vi.df, round(idf, 6)::DOUBLE AS idf, round(logp0, 6)::DOUBLE AS logp0, round(logp1, 6)::DOUBLE AS logp1 FROM nb JOIN vi USING (term)",
)
def _(t):
    df = textmodel.nb_terms(t.spark, fitted(t))
    return df.select("term", "df", *[F.round(c, 6).alias(c) for c in ("idf", "logp0", "logp1")])


@query("text_nb_predict", f"WITH {MODEL} SELECT id, round(p, 6)::DOUBLE AS p_nb FROM pr")
def _(t):
    df = textmodel.predict_nb(fitted(t), t.view("v_corpus"))
    return df.select("id", F.round("p_nb", 6).alias("p_nb"))


@query(
    "text_top_terms",
    f"""WITH {MODEL}, d AS (SELECT term, logp1 - logp0 AS d FROM nb),
    a AS (SELECT 'phishing' AS side, term, d AS strength FROM d ORDER BY round(d, 12) DESC, term LIMIT 5),
    b AS (SELECT 'legitimate' AS side, term, -d AS strength FROM d ORDER BY round(-d, 12) DESC, term LIMIT 5)
    SELECT side, term, round(strength, 6)::DOUBLE AS strength FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def _(t):
    df = textmodel.top_terms(t.spark, fitted(t), 5)
    return df.withColumn("strength", F.round("strength", 6))


@query(
    "text_explain",
    f"""WITH {MODEL} SELECT id, place, term, round(c, 6)::DOUBLE AS contribution FROM (
      SELECT id, term, c, row_number() OVER (PARTITION BY id ORDER BY round(abs(c), 12) DESC, term) AS place
      FROM (SELECT id, term, weight * (logp1 - logp0) AS c FROM x JOIN nb USING (term))) WHERE place <= 3""",
)
def _(t):
    df = textmodel.explain_nb(fitted(t), t.view("v_corpus"), 3)
    return df.withColumn("contribution", F.round("contribution", 6))


@query(
    "text_batch_report",
    f"""WITH {MODEL}, r AS (SELECT pr.id, left(text, 100) AS text_snippet, (pr.id % 83) / 83.0::DOUBLE AS second_proba, p AS naive_bayes_proba FROM pr JOIN v_corpus USING (id))
    SELECT id, text_snippet, round(second_proba, 6)::DOUBLE AS second_proba, round(naive_bayes_proba, 6)::DOUBLE AS naive_bayes_proba,
      round(0.7 * second_proba + 0.3 * naive_bayes_proba, 6)::DOUBLE AS final_proba,
      CASE WHEN 0.7 * second_proba + 0.3 * naive_bayes_proba >= 0.61 THEN 'Phishing' ELSE 'Legitimate' END AS prediction FROM r""",
)
def _(t):
    df = t.view("v_corpus").withColumn("p2", (F.col("id") % 83) / F.lit(83.0))
    report = ensemble.predict_batch(df, fitted(t), "p2")
    names = ["second_proba", "naive_bayes_proba", "final_proba"]
    return report.withColumns({n: F.round(n, 6) for n in names})


# -- ensembles and metrics ------------------------------------------------------

PROBS = cte("v_probs")


def _table(t, col):
    return t.view("v_probs").select("id", F.col(col).alias("p"))


@query(
    "ensemble_weighted",
    f"WITH {PROBS} SELECT id, round(0.7::DOUBLE * p_second + 0.3::DOUBLE * p_nb, 6)::DOUBLE AS p FROM v_probs",
)
def _(t):
    df = ensemble.combine_tables(_table(t, "p_second"), _table(t, "p_nb"))
    return df.withColumn("p", F.round("p", 6))


@query(
    "ensemble_soft",
    f"WITH {PROBS} SELECT id, round((p_second + p_nb) / 2.0::DOUBLE, 6)::DOUBLE AS p FROM v_probs",
)
def _(t):
    df = ensemble.combine_tables(_table(t, "p_second"), _table(t, "p_nb"), mode="soft")
    return df.withColumn("p", F.round("p", 6))


@query(
    "ensemble_labels",
    f"""WITH {PROBS} SELECT id, CASE WHEN p_nb >= 0.61 THEN 'Phishing' ELSE 'Legitimate' END AS name,
      (p_nb >= 0.4)::BIGINT AS label_at FROM v_probs""",
)
def _(t):
    p = F.col("p_nb")
    return t.view("v_probs").select(
        "id", scoring.binary_name(p).alias("name"), scoring.binary_label(p, 0.4).alias("label_at")
    )


def _second_scorer():
    def score(texts):
        import numpy as np

        return np.array([min(len(str(x)), 1000) / 1000.0 for x in texts])

    return score


@query("second_model_scored", "SELECT doc_id AS id, least(length(text), 1000) / 1000.0::DOUBLE AS p_second FROM documents")
def _(t):
    df = t.table("documents").select(F.col("doc_id").alias("id"), "text")
    return ensemble.with_second_model(df, scorer=_second_scorer).select("id", "p_second")


def judged(t):
    return t.view("v_probs").withColumn("pred", scoring.binary_label(F.col("p_second"), 0.5))


COUNTS = f"""{PROBS}, j AS (SELECT *, p_second >= 0.5 AS pred FROM v_probs),
k AS (SELECT (count(*) FILTER (label = 1 AND pred))::DOUBLE AS tp, (count(*) FILTER (label = 0 AND pred))::DOUBLE AS fp,
  (count(*) FILTER (label = 1 AND NOT pred))::DOUBLE AS fn, (count(*) FILTER (label = 0 AND NOT pred))::DOUBLE AS tn FROM j)"""


@query(
    "metrics_binary",
    f"WITH {COUNTS} SELECT round((tp + tn) / (tp + tn + fp + fn), 6)::DOUBLE AS accuracy, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / (tp + fn), 6)::DOUBLE AS recall, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM k",
)
def _(t):
    df = metrics.binary_metrics(judged(t))
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query(
    "metrics_confusion",
    f"WITH {COUNTS} SELECT 0::BIGINT AS label, tn::BIGINT AS pred_0, fp::BIGINT AS pred_1 FROM k UNION ALL SELECT 1, fn::BIGINT, tp::BIGINT FROM k",
)
def _(t):
    return metrics.confusion(judged(t))


REPORT = f"""WITH {COUNTS}, s AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0,
  tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tn + fp AS n0, tp + fn AS n1, (tp + tn) / (tp + tn + fp + fn) AS a FROM k),
u AS (SELECT '0' AS class, p0 AS p, r0 AS r, f0 AS f, n0 AS n FROM s UNION ALL SELECT '1', p1, r1, f1, n1 FROM s UNION ALL SELECT 'accuracy', a, a, a, n0 + n1 FROM s
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM s
  UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1), (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM s)"""


@query(
    "metrics_class_report",
    f"{REPORT} SELECT class, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f, 6)::DOUBLE AS f1, n::BIGINT AS support FROM u",
)
def _(t):
    df = metrics.class_report(judged(t))
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def auc_sql(score: str) -> str:
    return f"""(SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))
      FROM (SELECT label, avg(rn) OVER (PARTITION BY {score}) AS r FROM (SELECT label, {score}, row_number() OVER (ORDER BY {score}) AS rn FROM v_probs)))"""


@query("metrics_roc_auc", f"WITH {PROBS} SELECT round({auc_sql('p_second')}, 6)::DOUBLE AS roc_auc")
def _(t):
    df = metrics.roc_auc(t.view("v_probs"), score="p_second")
    return df.withColumn("roc_auc", F.round("roc_auc", 6))


MODELS = {"naive_bayes": "p_nb", "second": "p_second", "hybrid": "p_hybrid"}


@query(
    "metrics_compare_models",
    f"WITH {PROBS.replace(' FROM orders', ' FROM orders').replace('v_probs AS (', 'v_base AS (')}, v_probs AS (SELECT *, 0.7 * p_second + 0.3 * p_nb AS p_hybrid FROM v_base), "
    + ", ".join(
        f"""{m} AS (SELECT '{m}' AS model, count(*) FILTER (({c} >= 0.5)::INT = label)::DOUBLE / count(*) AS accuracy,
        count(*) FILTER ({c} >= 0.5 AND label = 1)::DOUBLE / count(*) FILTER ({c} >= 0.5) AS precision,
        count(*) FILTER ({c} >= 0.5 AND label = 1)::DOUBLE / count(*) FILTER (label = 1) AS recall, any_value({auc_sql(c)}) AS roc_auc FROM v_probs)"""
        for m, c in MODELS.items()
    )
    + ", al AS ("
    + " UNION ALL ".join(f"SELECT * FROM {m}" for m in MODELS)
    + """) SELECT model, round(accuracy, 6)::DOUBLE AS accuracy, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall,
      round(2 * precision * recall / (precision + recall), 6)::DOUBLE AS f1, round(roc_auc, 6)::DOUBLE AS roc_auc FROM al""",
)
def _(t):
    blend = scoring.combine_probs(F.col("p_second"), F.col("p_nb"))
    df = metrics.compare_models(t.view("v_probs").withColumn("p_hybrid", blend), MODELS)
    return df.select("model", *[F.round(c, 6).alias(c) for c in df.columns if c != "model"])


SPLIT = "CASE id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"
BY_SPLIT = f"""WITH {PROBS}, st AS (SELECT {SPLIT} AS split, label, m.model, m.p FROM
    (SELECT *, unnest([{{'model': 'naive_bayes', 'p': p_nb}}, {{'model': 'second', 'p': p_second}}, {{'model': 'hybrid', 'p': 0.7 * p_second + 0.3 * p_nb}}]) AS m FROM v_probs)),
  rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY split, model, p) - 1) / 2.0 AS r FROM st WINDOW w AS (PARTITION BY split, model ORDER BY p)),
  k AS (SELECT split, model, count(*) FILTER (label = 1 AND p >= 0.5) AS tp, count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
    count(*) FILTER (label = 1 AND p < 0.5) AS fn, count(*) FILTER (label = 0 AND p < 0.5) AS tn, sum(r) FILTER (label = 1) AS rs FROM rk GROUP BY ALL)
SELECT split, model, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6)::DOUBLE AS accuracy, round(tp / (tp + fp), 6)::DOUBLE AS precision,
  round(tp / (tp + fn), 6)::DOUBLE AS recall, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1,
  round((rs - (tp + fn) * (tp + fn + 1) / 2.0) / ((tp + fn)::DOUBLE * (fp + tn)), 6)::DOUBLE AS roc_auc FROM k"""


def by_split(t):
    blend = scoring.combine_probs(F.col("p_second"), F.col("p_nb"))
    rows = t.view("v_probs").withColumns({"p_hybrid": blend, "split": F.expr(SPLIT)})
    return metrics.evaluate_splits(rows, MODELS)


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


@query("metrics_by_split", BY_SPLIT)
def _(t):
    return rounded(by_split(t))


SPLIT_MODEL = model_sql("rn <= floor(0.7::DOUBLE * n)")["model"]
VALIDATION = "rn > floor(0.7::DOUBLE * n) AND rn <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n)"


@query(
    "train_text_evaluation",
    f"""WITH {SPLIT_MODEL}, v AS (SELECT pr.* FROM pr JOIN r0 USING (id) WHERE {VALIDATION}),
    rk AS (SELECT label, p, avg(rn) OVER (PARTITION BY p) AS r FROM (SELECT label, round(p, 12) AS p, row_number() OVER (ORDER BY round(p, 12)) AS rn FROM v)),
    au AS (SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM rk),
    c AS (SELECT (count(*) FILTER (label = 1 AND p >= 0.5))::DOUBLE AS tp, (count(*) FILTER (label = 0 AND p >= 0.5))::DOUBLE AS fp, (count(*) FILTER (label = 1 AND p < 0.5))::DOUBLE AS fn, count(*) AS n,
      (count(*) FILTER ((p >= 0.5)::INT = label))::DOUBLE AS ok FROM v)
    SELECT 'naive_bayes' AS model, round(ok / n, 6)::DOUBLE AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6)::DOUBLE AS precision,
      round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6)::DOUBLE AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1,
      round(auc, 6)::DOUBLE AS roc_auc FROM c, au""",
)
def _(t):
    corpus_rows = t.view("v_corpus")
    _, df = plans.train_text_model(corpus_rows, max_features=FEATURES, min_df=MIN_DF)
    return df.select("model", *[F.round(c, 6).alias(c) for c in df.columns if c != "model"])


# -- trees: SQL knows the held-out rows and the rules that a score keeps ------------


def url_training(t):
    """Pages as labelled URLs: the decorated hosts of the page view count as malicious."""
    bad = F.col("id") % 32 >= 10
    return t.view("v_urls").withColumn("label", F.when(bad, 1).otherwise(0))


def held_out_sql(fraction: float) -> str:
    """The labels follow from the decorated hosts, so a sound model tells nearly all."""
    return f"""WITH {cte("v_urls")}, r AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn, count(*) OVER () AS n FROM v_urls)
    SELECT id, (id % 32 >= 10)::INTEGER::BIGINT AS label, true AS within, true AS agrees, true AS accurate FROM r WHERE rn > floor({fraction}::DOUBLE * n)"""


def kept_rules(scored):
    """The probability lies in 0..1, the prediction is the likelier class, and 17 in 20 are right."""
    p = F.col("probability")
    right = F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("right")
    return scored.crossJoin(F.broadcast(scored.agg(right))).select(  # one row
        "id", "label", p.between(0, 1).alias("within"),
        (F.col("prediction") == (p > 0.5).cast("int")).alias("agrees"), (F.col("right") >= 0.85).alias("accurate"),
    )


def shown_scores(scored):
    return scored.select("id", "label", F.round("probability", 6).alias("probability"), "prediction")


def grown(t):
    """The test rows scored by a forest of 100 trees of depth 20 on written features."""
    table = stage(urls.url_lexical14(url_training(t)), "features")
    df = sampling.assign_split(table, (0.8,), ("train", "test"))
    model = trees.fit_forest(sampling.take_split(df, "train"), lexicon.LEXICAL_FEATURES)
    return stage(trees.predict_trees(sampling.take_split(df, "test"), model), "scored")


@query("trees_forest", held_out_sql(0.8))
def _(t):
    return kept_rules(grown(t))


@query("trees_forest_scores")
def _(t):
    return shown_scores(grown(t))


def combined_sources(t):
    basic = urls.url_basic10(url_training(t)).drop("url")
    website = t.table("pages").select(
        F.col("page_id").alias("id"),
        F.when(F.length("html") > 3000, 1).otherwise(-1).alias("page_size"),
        F.when(F.col("html").contains("<nav>"), 1).otherwise(-1).alias("has_nav"),
        F.when(F.col("url").contains("spam"), 1).otherwise(0).alias("label"),
    )
    return [basic, website.withColumn("id", -F.col("id") - 1)]


@query("trees_forest_combined_sources")
def _(t):
    sources = combined_sources(t)
    model, _, _ = plans.train_combined_forest(sources)
    df = sampling.assign_split(corpus.union_all(sources, allow_missing=True), (0.8,), ("train", "test"), stratify="label")
    return shown_scores(trees.predict_trees(sampling.take_split(df, "test"), model, fill=-1))


@query("train_combined_forest")
def _(t):
    _, _, report = plans.train_combined_forest(combined_sources(t))
    return report


def boosted(t):
    """At most 300 rounds of depth 15, ended by a held-back tenth of the train rows."""
    table = stage(urls.url_model_features(url_training(t)), "features")
    df = sampling.assign_split(table, (0.85,), ("train", "test"))
    return df, trees.fit_gbt(trees.hold_back(sampling.take_split(df, "train")), held_back="held_back")


def boosted_scores(t):
    df, model = boosted(t)
    return stage(trees.predict_trees(sampling.take_split(df, "test"), model), "scored")


@query("trees_boosting", held_out_sql(0.85))
def _(t):
    return kept_rules(boosted_scores(t))


@query("trees_boosting_scores")
def _(t):
    return shown_scores(boosted_scores(t))


@query(
    "trees_importances",
    f"SELECT unnest({listed(lexicon.MODEL_FEATURES)}) AS feature, true AS within, true AS sum_is_one",
)
def _(t):
    df = trees.importances(t.spark, boosted(t)[1])
    total = F.sum("importance").over(Window.partitionBy())  # one row per feature
    return df.select("feature", F.col("importance").between(0, 1).alias("within"), (F.round(total, 9) == 1).alias("sum_is_one"))


@query("trees_importance_values")
def _(t):
    return trees.importances(t.spark, boosted(t)[1]).withColumn("importance", F.round("importance", 6))


@query("url_model_score")
def _(t):
    _, model = boosted(t)
    return score_urls(t.view("v_urls"), model=model).select(
        "id", "risk_score", "verdict", F.round("ml_probability", 6).alias("ml_probability")
    )


@query("train_url_models")
def _(t):
    _, forest = plans.train_url_forest(url_training(t))
    _, boosting = plans.train_url_boosting(url_training(t), early_stop=True)
    return forest.withColumn("job", F.lit("forest")).unionByName(
        boosting.withColumn("job", F.lit("boosting"))
    )
