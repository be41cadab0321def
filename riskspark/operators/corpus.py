"""Corpus preparation: column guess, cleaning, dedupe, union, class counts."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import lexicon
from riskspark.functions.text import coerce_label


def guess_columns(df: DataFrame, text_col=None, label_col=None) -> tuple[str, str | None]:
    """Names of the text and label columns; the label may be missing."""
    by_name = {c.lower(): c for c in df.columns}
    text_col = text_col or next((by_name[c] for c in lexicon.TEXT_COLUMNS if c in by_name), None)
    if text_col is None:
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not strings:
            raise ValueError("Could not infer the text column; pass text_col.")
        text_col = strings[0]
    label_col = label_col or next(
        (by_name[c] for c in lexicon.LABEL_COLUMNS if c in by_name), None
    )
    return text_col, label_col


def normalize_columns(df: DataFrame, text_col=None, label_col=None) -> DataFrame:
    """Rename the guessed or given columns to `text` and `label`; keep no others."""
    text_col, label_col = guess_columns(df, text_col, label_col)
    columns = [F.col(f"`{text_col}`").cast("string").alias("text")]
    if label_col is not None:
        columns.append(F.col(f"`{label_col}`").alias("label"))
    return df.select(*columns)


def label_as_int(df: DataFrame, col: str = "label") -> DataFrame:
    """Coerce a bool, numeric or string label column to 0/1."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.BooleanType):
        value = F.col(col).cast("int")
    elif isinstance(kind, T.NumericType):
        number = F.col(col).cast("double")
        value = F.when(~F.isnan(number) & (number > 0.5), 1).otherwise(0)
    else:
        value = coerce_label(F.coalesce(F.col(col), F.lit("")))
    return df.withColumn(col, value)


def drop_empty(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["text", "label"]).filter(F.length("text") > 0)


def dedupe_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first in the given order.

    Copies collapse in the map-side aggregation, so a text that makes up a third of the table
    reaches the shuffle as one row per task. Rows are grouped by a 256-bit digest, and the key's
    text is carried once per group, so what is sorted and compared is short.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    digest = F.sha2(F.col(key).cast("string"), 256)
    return (
        df.groupBy(digest.alias("_digest"))
        .agg(first, F.first(key).alias("_key"))
        .select(*[F.col("_key").alias(c) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns])
    )


def union_all(dfs: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))
