"""Readers for labelled URL, text, SMS and attribute-relation files."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.operators.corpus import guess_columns, label_as_int, union_all


def _csv(spark, path, **options) -> DataFrame:
    return spark.read.options(header=True, escape='"', **options).csv(path)


def read_labeled_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, label) from a CSV with `url,type`: malicious types are 1."""
    malicious = F.col("type").isin(lexicon.MALICIOUS_TYPES)
    label = F.when(malicious, 1).otherwise(0)
    return _csv(spark, path).select("url", label.alias("label"))


def read_phish_urls(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path).select("url", F.lit(1).alias("label"))


def read_top_sites(spark: SparkSession, path: str) -> DataFrame:
    """(url, label 0) from a headerless CSV of rank and site.

    The rank is not read as a number: blank and worded ranks are as good as others. Only lines with
    more fields than two are skipped; a line of one field has no site.
    """
    raw = spark.read.schema("rank string, url string, extra string").csv(path)
    good = F.col("extra").isNull() & F.col("url").isNotNull()
    return raw.filter(good).select("url", F.lit(0).alias("label"))


def read_arff(spark: SparkSession, path: str, label: str = "Result") -> DataFrame:
    """Attribute-relation file: columns from `@attribute` lines, label -1 becomes 1, else 0.

    The header, one line per column, is read up to `@data`; the driver holds as many names as the
    table has columns.
    """
    lines = spark.read.text(path).withColumn("line", F.trim("value"))
    numbered = lines.withColumn("at", F.monotonically_increasing_id())
    data = numbered.filter(F.lower("line").startswith("@data")).agg(F.min("at")).first()[0]
    head = numbered.filter(F.lower("line").startswith("@attribute"))
    rows = (head if data is None else head.filter(F.col("at") < data)).orderBy("at").select("line").collect()
    columns = [_attribute(r["line"]) for r in rows]
    columns = list(dict.fromkeys(columns))
    body = lines.filter(~F.substr("line", F.lit(1), F.lit(1)).isin("@", "%") & (F.col("line") != ""))
    schema = ", ".join(f"`{name}` string" for name, _ in columns)
    parsed = body.select(F.from_csv("line", schema, {"quote": "'"}).alias("r"))
    out = []
    for name, numeric in columns:
        value = F.trim(F.col(f"r.`{name}`"))
        if name == label:
            value = F.when(value.try_cast("double") == -1, 1).otherwise(0)
        elif numeric:
            value = value.try_cast("double")
        out.append(value.alias(name))
    return parsed.select(*out)


def _attribute(line: str) -> tuple[str, bool]:
    """Name of an attribute and whether its values are numbers."""
    name, kind = re.match(r"@attribute\s+('[^']*'|\S+)\s+(.*)", line, re.I | re.S).groups()
    kind = kind.strip()
    if kind.startswith("{"):
        values = kind.strip("{} ").split(",")
        return name.strip("'"), all(re.fullmatch(r"\s*[-+]?\d+(\.\d+)?\s*", v) for v in values)
    return name.strip("'"), kind.lower() in ("numeric", "real", "integer")


def read_text_corpus(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """(text, label, src_ord, path, row_ord) from one CSV source per spec, in given order.

    Spec keys: path; optional text_col, label_col, default_label and multi_line. Files
    are split over tasks, unless multi_line is set: quoted line breaks need it, and it reads a file in one task.
    The last three columns give the input order that `dedupe_first` needs.
    """
    return union_all([_read_spec(spark, i, spec) for i, spec in enumerate(specs)])


def _read_spec(spark: SparkSession, place: int, spec: dict) -> DataFrame:
    raw = _csv(spark, spec["path"], multiLine=spec.get("multi_line", False))
    text, label = guess_columns(raw, spec.get("text_col"), spec.get("label_col"))
    default = spec.get("default_label")
    if label is None and default is None:
        raise ValueError(f"No label column and no default label: {spec['path']}")
    value = F.lit(str(int(default))) if label is None else F.col(f"`{label}`")
    start = F.col("_metadata.file_block_start").alias("start")
    return label_as_int(
        raw.select(
            F.col(f"`{text}`").cast("string").alias("text"),
            value.alias("label"),
            F.lit(place).alias("src_ord"),
            F.col("_metadata.file_path").alias("path"),
            F.struct(start, F.monotonically_increasing_id().alias("row")).alias("row_ord"),
        )
    )


def read_sms_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) from tab-separated `ham|spam` lines; quotes are literal."""
    raw = (
        spark.read.schema("label string, text string")
        .options(sep="\t", quote="")
        .csv(path)
    )
    return label_as_int(raw).select("text", "label")


def read_suffix_list(spark: SparkSession, path: str) -> list[str]:
    """Public-suffix rules from the published list file, private section left out.

    The list is one file; it is read as one value, so the order of its lines is the file's.
    """
    (content,) = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    public = content.partition("// ===BEGIN PRIVATE DOMAINS===")[0]
    lines = [line.strip() for line in public.splitlines()]
    return [line.split()[0] for line in lines if line and not line.startswith("//")]
