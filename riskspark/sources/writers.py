"""Sinks: scan history, corpora, reports, models, metrics."""

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators.scans import SUMMARY_LIMIT
from riskspark.operators.textmodel import NbModel, nb_prior, nb_terms


def stored_scans(df: DataFrame) -> DataFrame:
    """Scan records as stored: cut summary, details as JSON text, creation time."""
    created = F.col("created_at") if "created_at" in df.columns else F.current_timestamp()
    return df.select(
        "id",
        F.substr("scan_summary", F.lit(1), F.lit(SUMMARY_LIMIT)).alias("scan_summary"),
        "risk_score",
        "verdict",
        F.to_json("details").alias("details_json"),
        created.alias("created_at"),
        "scan_type",
    )


HISTORY = (
    "id long, scan_summary string, risk_score double, verdict string, details_json string, created_at timestamp, "
    "run string, scan_type string, created_date date"
)


def write_history(df: DataFrame, path: str, run: str) -> None:
    """The stored scans of one run, below run=/scan_type=/created_date= of the history.

    A run that is repeated after a lost executor or driver replaces its own output.
    """
    stored = stored_scans(df).withColumns({"id": F.col("id").cast("long"), "created_date": F.to_date("created_at")})
    stored.write.mode("overwrite").partitionBy("scan_type", "created_date").parquet(f"{path}/run={run}")


def append_scans(df: DataFrame, path: str) -> None:
    write_history(df, path, f"job-{uuid.uuid4().hex}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The whole history of batch jobs and streams; filters on type and date skip folders."""
    return spark.read.schema(HISTORY).parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Text, label and split as CSV, one folder per split."""
    df.select("text", "label", "split").write.partitionBy("split").options(
        header=True, escape='"'
    ).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """All columns as CSV; blanks at the ends of a text stay."""
    df.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON line per model and split."""
    df.write.json(path)


def save_nb(spark: SparkSession, model: NbModel, path: str) -> None:
    """The model as two tables; settings ride along as columns of the prior table."""
    nb_terms(spark, model).write.parquet(f"{path}/terms")
    settings = {
        "ngram_low": F.lit(model.ngram_range[0]),
        "ngram_high": F.lit(model.ngram_range[1]),
        "stop_words": F.lit(None if model.stop_words is None else " ".join(model.stop_words)).cast("string"),
    }
    nb_prior(spark, model).withColumns(settings).write.parquet(f"{path}/prior")


def load_nb(spark: SparkSession, path: str) -> NbModel:
    """The terms stay a table; only the two rows of the classes are read here."""
    prior = {r["class"]: r for r in spark.read.parquet(f"{path}/prior").collect()}
    first, words = prior[0], prior[0]["stop_words"]
    return NbModel(
        spark.read.parquet(f"{path}/terms"),
        (prior[0]["log_prior"], prior[1]["log_prior"]),
        first["n"],
        (first["ngram_low"], first["ngram_high"]),
        None if words is None else words.split(),
    )


def save_trees(model: PipelineModel, path: str) -> None:
    """The pipeline holds the ordered feature names in its assembler."""
    model.write().overwrite().save(path)


def load_trees(path: str) -> PipelineModel:
    return PipelineModel.load(path)
