"""Corpus jobs: labelled text or URLs in, a clean, balanced, split training table out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.staging import hold
from riskspark.functions.text import clean_text, collapse_ws
from riskspark.operators import corpus, sampling

BLOCK = 10_000  # copies of one url that are numbered together


def build_text_corpus(df: DataFrame, order: list[str], max_per_class=30_000, seed=42) -> DataFrame:
    """Clean, drop empty, keep the first of equal texts, cap per class: (text, label).

    `df`: text, label and the `order` columns of the input.
    """
    given = df.dropna(subset=["text", "label"])
    cleaned = hold(given.withColumn("text", clean_text(F.col("text"))), "text")
    unique = corpus.dedupe_first(
        corpus.drop_empty(cleaned).select("text", "label", *order), "text", order
    ).select("text", "label")
    if max_per_class is None:
        return unique
    return sampling.cap_per_class(unique, max_per_class, "label", "text", seed)


def build_url_corpus(sources: list[DataFrame], max_per_class=100_000, seed=42) -> DataFrame:
    """Sources of (url, label) in one table, at most `max_per_class` rows of each class.

    Copies of a url are kept, as rows of their own. They are counted first and numbered
    from the count, in blocks, so that neither a hot url nor the file layout matters.
    """
    rows = corpus.union_all(sources).dropna(subset=["url"])
    counted = rows.groupBy("url", "label").agg(F.count("*").alias("n"))
    last = F.col("n") - 1
    blocks = counted.select(
        "url", "label", "n", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(BLOCK))).alias("at")
    )
    copies = F.sequence(F.col("at"), F.least(F.col("at") + (BLOCK - 1), last))
    numbered = (
        blocks.repartition(F.col("url"), F.col("label"), F.col("at"))
        .select("url", "label", F.explode(copies).alias("copy"))
        .select("url", "label", F.concat_ws("#", "url", "copy").alias("row"))
    )
    capped = sampling.cap_per_class(numbered, max_per_class, "label", "row", seed)
    return capped.drop("row")


def build_mail_corpus(mails: DataFrame, max_per_class=None, seed=42) -> DataFrame:
    """Parsed mails (path, text, label) as (path, text, label, split) for training.

    At most `max_per_class` mails of each class are taken, before anything is dropped; whitespace is
    collapsed, empty texts go, and of equal texts the first stays, safe mail before phishing and then by
    path. 70/15/15 is split over what is left. `writers.write_splits` stores it.
    """
    if max_per_class is not None:
        mails = sampling.cap_per_class(mails, max_per_class, "label", "path", seed)
    cleaned = hold(mails.select("path", collapse_ws(F.col("text")).alias("text"), "label"), "text")
    unique = corpus.dedupe_first(corpus.drop_empty(cleaned), "text", ["label", "path"])
    return sampling.assign_split(unique, key="path", seed=seed)
