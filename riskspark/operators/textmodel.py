"""TF-IDF with multinomial naive Bayes, as tables of terms.

The model is a table (term, df, idf and a log-probability per class). A document's terms leave it as
(document, term, count) rows, meet the model in a join that is broadcast only after its rows were
counted, and are summed per document, map-side first: what is shuffled is a row per document. Texts are
tokenized once per use; nothing that grows with the vocabulary or the corpus reaches the driver.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.staging import hold, spread, stage
from riskspark.functions.text import ngrams, words

BANDS_PER_DOUBLING = 8
BROADCAST_TERMS = 200_000  # model rows that are broadcast; more are joined by term


@dataclass
class Vocabulary:
    """`terms` (term, df, idf) is a written table; `n` documents were counted."""

    terms: DataFrame
    n: int
    ngram_range: tuple[int, int] = (1, 2)
    stop_words: list[str] | None = None


@dataclass
class NbModel:
    """`terms` (term, df, idf, logp0, logp1) is a written table; `log_prior` is per class."""

    terms: DataFrame
    log_prior: tuple[float, float]
    n: int
    ngram_range: tuple[int, int] = (1, 2)
    stop_words: list[str] | None = None


def tokenize(df: DataFrame, col="text", ngram_range=(1, 2), stop_words=None) -> DataFrame:
    """Add `tokens`. The word list is its own column, so that it is built only once."""
    worded = df.withColumn("_words", words(F.col(col), stop_words))
    return worded.withColumn("tokens", ngrams(F.col("_words"), *ngram_range)).drop("_words")


def with_counts(tokenized: DataFrame) -> DataFrame:
    """Replace `tokens` by `terms`, an array of (term, tf) with each distinct token once.

    Tokens are sorted within their document; a count is the distance between the starts of two
    neighbouring runs. Each step is held: it is computed once, whatever is filtered later.
    """
    ordered = hold(tokenized.withColumn("_s", F.array_sort("tokens")).drop("tokens"), "_s")
    starts = F.filter(
        F.transform("_s", lambda x, i: F.when((i == 0) | (F.get("_s", i - 1) != x), i)), lambda i: i.isNotNull()
    )
    placed = hold(ordered.withColumn("_at", starts), "_at")
    ends = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.size("_s")))
    runs = F.zip_with("_at", ends, lambda i, j: F.struct(F.get("_s", i).alias("term"), (j - i).cast("long").alias("tf")))
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return placed.withColumn("terms", F.when(F.size("_s") > 0, runs).otherwise(none)).drop("_s", "_at")


def term_counts(counted: DataFrame) -> DataFrame:
    """(term, cf, df): occurrences and documents per term."""
    return counted.select(F.inline("terms")).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def vocabulary(tokenized: DataFrame, max_features=50_000, min_df=2) -> DataFrame:
    """(term, cf, df): the `max_features` most frequent terms with df >= min_df; ties in term order."""
    return _most_frequent(with_counts(tokenized.select("tokens")), max_features, min_df)


def _most_frequent(with_terms: DataFrame, max_features: int, min_df: int) -> DataFrame:
    counted = stage(term_counts(with_terms).filter(F.col("df") >= min_df), "terms")
    # Logarithmic bands of the count (a few hundred at most) show how far down the top
    # reaches, so that the final ordering sees little more than the kept terms.
    band = F.floor(F.log2("cf") * BANDS_PER_DOUBLING)
    bands = counted.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()
    left, lowest = max_features, None
    for row in sorted(bands, reverse=True):
        lowest = row["band"]
        left -= row["n"]
        if left <= 0:
            break
    if lowest is None:
        return counted
    kept = counted.filter(band >= lowest)
    return kept if left >= 0 else kept.orderBy(F.desc("cf"), "term").limit(max_features)


def _counted(df: DataFrame, keep: list[str], col: str, ngram_range, stop_words) -> DataFrame:
    """The written table (_doc, the named columns, terms) of every row: tokenized once, for several passes."""
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{col}`").alias("_text"))
    rows = spread(stage(rows.withColumn("_doc", F.monotonically_increasing_id()), "documents"), "_doc")
    return stage(with_counts(tokenize(rows, "_text", ngram_range, stop_words)).drop("_text"), "counted")


def _vocabulary_of(counted: DataFrame, n: int, max_features, ngram_range, min_df, stop_words) -> Vocabulary:
    kept = _most_frequent(counted, max_features, min_df)
    idf = (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")
    return Vocabulary(stage(kept.select("term", "df", idf), "vocabulary"), n, tuple(ngram_range), stop_words)


def corpus_vocabulary(
    df: DataFrame, col="text", max_features=50_000, ngram_range=(1, 2), min_df=2, stop_words=None
) -> DataFrame:
    """(term, cf, df) of a text column, as `vocabulary` gives them; the texts are written and spread first."""
    return _most_frequent(_counted(df, [], col, ngram_range, stop_words), max_features, min_df)


def fit_vocabulary(
    df: DataFrame, col="text", max_features=50_000, ngram_range=(1, 2), min_df=2, stop_words=None
) -> Vocabulary:
    counted = _counted(df, [], col, ngram_range, stop_words)
    return _vocabulary_of(counted, counted.count(), max_features, ngram_range, min_df, stop_words)


def _met(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Join (.., term, tf) with the model; a model of many terms is joined by term instead of broadcast."""
    return pairs.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term")


def _weighed(counted: DataFrame, keep: list[str], terms: DataFrame, *others: str) -> DataFrame:
    """(the named columns, ws) per document with a known term: term, L2-normalised weight w and `others`."""
    pairs = counted.select("_doc", *keep, F.inline("terms"))
    met = _met(pairs, terms.select("term", "idf", *others)).withColumn("x", F.col("tf") * F.col("idf"))
    whole = met.groupBy("_doc", *keep).agg(
        F.collect_list(F.struct("term", "x", *others)).alias("ws"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")
    )
    unit = F.transform("ws", lambda e: F.struct(e["term"].alias("term"), (e["x"] / F.col("norm")).alias("w"), *[e[c].alias(c) for c in others]))
    return whole.select(*keep, unit.alias("ws"))


def tfidf(df: DataFrame, vocab: Vocabulary, id_col="id", col="text") -> DataFrame:
    """(id, term, weight) rows of the non-zero weights."""
    counted = _counted(df, [id_col], col, vocab.ngram_range, vocab.stop_words)
    rows = _weighed(counted, [id_col], vocab.terms).select(id_col, F.inline("ws"))
    return rows.withColumnRenamed("w", "weight")


def fit_nb(
    df: DataFrame, col="text", label="label", max_features=50_000, ngram_range=(1, 2),
    min_df=2, stop_words=None, alpha=1.0,
) -> NbModel:
    """Multinomial naive Bayes on TF-IDF weights with an unsmoothed class prior."""
    counted = _counted(df, [label], col, ngram_range, stop_words)
    docs = {r[label]: r["count"] for r in counted.groupBy(label).count().collect()}
    n = sum(docs.values())
    vocab = _vocabulary_of(counted, n, max_features, ngram_range, min_df, stop_words)
    size = vocab.terms.count()
    if not size:
        raise ValueError("No term reaches min_df; the vocabulary is empty.")
    if set(docs) != {0, 1}:
        raise ValueError("Training needs both classes, 0 and 1.")
    each = _weighed(counted, [label], vocab.terms).select(label, F.inline("ws"))
    of_class = [F.sum(F.when(F.col(label) == c, F.col("w")).otherwise(0.0)).alias(f"s{c}") for c in (0, 1)]
    sums = stage(vocab.terms.join(each.groupBy("term").agg(*of_class), "term"), "sums")
    total = sums.agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1")).first()
    logs = [(F.log(F.col(f"s{c}") + alpha) - F.log(F.lit(total[f"s{c}"] + alpha * size))).alias(f"logp{c}") for c in (0, 1)]
    terms = sums.select("term", "df", "idf", *logs)
    priors = tuple(math.log(docs[c] / n) for c in (0, 1))
    return NbModel(terms, priors, n, tuple(ngram_range), stop_words)


def predict_nb(model: NbModel, df: DataFrame, col="text", out="p_nb") -> DataFrame:
    """Add the probability of class 1. Texts without a known term get the prior."""
    docs = stage(df.withColumn("_doc", F.monotonically_increasing_id()), "documents")
    texts = spread(docs.select("_doc", F.col(f"`{col}`").alias("_text")), "_doc")
    pairs = with_counts(tokenize(texts, "_text", model.ngram_range, model.stop_words)).select("_doc", F.inline("terms"))
    met = _met(pairs, model.terms.select("term", "idf", (F.col("logp1") - F.col("logp0")).alias("d")))
    x = F.col("tf") * F.col("idf")
    sums = met.groupBy("_doc").agg(F.sum(x * F.col("d")).alias("_sum"), F.sqrt(F.sum(x * x)).alias("_norm"))
    margin = F.lit(model.log_prior[1] - model.log_prior[0]) + F.coalesce(F.col("_sum") / F.col("_norm"), F.lit(0.0))
    return docs.join(sums, "_doc", "left").select(*df.columns, (1 / (1 + F.exp(-margin))).alias(out))


def nb_terms(spark: SparkSession, model: NbModel) -> DataFrame:
    """The model as a table: term, idf and log-probability per class."""
    return model.terms.select("term", "df", "idf", "logp0", "logp1")


def nb_prior(spark: SparkSession, model: NbModel) -> DataFrame:
    rows = [(c, p, model.n) for c, p in enumerate(model.log_prior)]
    return spark.createDataFrame(rows, "class int, log_prior double, n long")


def top_terms(spark: SparkSession, model: NbModel, k=20) -> DataFrame:
    """(side, term, strength): the k most indicative terms of each class."""
    terms = nb_terms(spark, model).withColumn("d", F.col("logp1") - F.col("logp0"))
    sides = []
    for side, strength in (("phishing", F.col("d")), ("legitimate", -F.col("d"))):
        best = terms.select(F.lit(side).alias("side"), "term", strength.alias("strength"))
        sides.append(best.orderBy(F.desc(F.round("strength", 12)), "term").limit(k))
    return sides[0].unionByName(sides[1])


def explain_nb(model: NbModel, df: DataFrame, k=10, id_col="id", col="text") -> DataFrame:
    """(id, place, term, contribution): the k strongest terms per message, by size."""
    counted = _counted(df, [id_col], col, model.ngram_range, model.stop_words)
    whole = _weighed(counted, [id_col], model.terms, "logp0", "logp1")
    part = lambda e: e["w"] * (e["logp1"] - e["logp0"])
    ordered = F.array_sort(
        F.transform(
            "ws",
            lambda e: F.struct((-F.abs(F.round(part(e), 12))).alias("size"), e["term"].alias("term"), part(e).alias("contribution")),
        )
    )
    best = whole.select(id_col, F.posexplode(F.slice(ordered, 1, k)).alias("pos", "e"))
    return best.select(id_col, (F.col("pos") + 1).alias("place"), "e.term", "e.contribution")
