"""Combining model probabilities and batch prediction reports."""

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskspark.functions import scoring
from riskspark.operators import textmodel

SNIPPET = 100  # characters of text shown in a report
BATCH = 16  # texts handed to a batch scorer at once


def combine_tables(a: DataFrame, b: DataFrame, key="id", mode="weighted", weights=(0.7, 0.3)):
    """Ensemble of two probability tables (key, p); raises when their keys differ."""
    left, right = a.select(key, F.col("p").alias("pa")), b.select(key, F.col("p").alias("pb"))
    combined = scoring.combine_probs(F.col("pa"), F.col("pb"), mode, weights)
    uneven = F.col("pa").isNull() | F.col("pb").isNull()
    message = F.raise_error(F.lit("Shape mismatch: the tables do not cover the same rows."))
    checked = F.when(uneven, message.cast("double")).otherwise(combined)
    return left.join(right, key, "full").select(key, checked.alias("p"))


def one_probability(probs: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key of a table of probabilities: complete rows first, then the greatest values."""
    given = [F.col(c).isNotNull() for c in columns]
    whole = given[0]
    for g in given[1:]:
        whole = whole & g
    best = F.max(F.struct(whole.alias("_whole"), *columns)).alias("_best")
    return probs.groupBy(key).agg(best).select(key, *[F.col("_best").getField(c).alias(c) for c in columns])


def label_binary(df: DataFrame, p="p") -> DataFrame:
    return df.withColumn("prediction", scoring.binary_name(F.col(p)))


def with_second_model(df: DataFrame, probs: DataFrame | None = None, scorer=None, key="id", text="text"):
    """Add p_second from a table (key, p), or from a batch scoring function of the text.

    Several rows of the table for one key are reduced, so no record is multiplied.
    `scorer` is a loader for `predict_batch_udf`: called once per worker, it returns a
    function from a batch of texts to an array of probabilities.
    """
    if probs is not None:
        return df.join(one_probability(probs, key, "p").withColumnRenamed("p", "p_second"), key, "left")
    score = predict_batch_udf(scorer, return_type=DoubleType(), batch_size=BATCH)
    return df.withColumn("p_second", score(F.col(text)))


def predict_batch(df: DataFrame, nb, second=None, text="text", mode="weighted", weights=(0.7, 0.3)):
    """Report rows for every text: both probabilities, the blend and its label.

    `second` names a probability column; without it the naive Bayes model decides alone.
    Rows without text are dropped.
    """
    # Cut before the scores are joined, so that whole texts do not move with them.
    cut = df.dropna(subset=[text]).withColumn("_snippet", F.substr(text, F.lit(1), F.lit(SNIPPET)))
    scored = textmodel.predict_nb(nb, cut, text, "naive_bayes_proba")
    other = F.col(second) if second else F.col("naive_bayes_proba")
    final = scoring.combine_probs(other, F.col("naive_bayes_proba"), mode, weights)
    keys = [c for c in ("id", "path") if c in df.columns]
    return scored.select(
        *keys,
        F.col("_snippet").alias("text_snippet"),
        other.alias("second_proba"),
        "naive_bayes_proba",
        final.alias("final_proba"),
        scoring.binary_name(final).alias("prediction"),
    )
