"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters of lower-cased text in `BUCKETS` hashed places,
summed per task before they are shuffled as (language, place, count). The log-probabilities form
a matrix of languages x places, broadcast for scoring: 256 KB a language at float32, and the
number of languages is checked. A text is scored over all its n-grams, as the sparse vector of its
distinct places and their counts against the matrix.

The training sample is bounded: the first `SAMPLE` labelled rows of each language in hash order.
Only text and language of rows outside the held-out fold are read for it.

Defined cases: a null text or one without a letter is `und` with score 0; ties go to the smaller
language code; rows with a null language are scored but not learnt; without any training row every
text is `und`; equal rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from riskspark.llm.common import register, table

BUCKETS = 1 << 16
SAMPLE = 4000
SMOOTHING = 0.5
MOST_LANGUAGES = 1000  # 256 MB of matrix
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def places(text: str) -> np.ndarray:
    """Hashed places of all n-grams of one to three characters, each run of other signs one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == 0:
        return np.zeros(0, np.uint32)
    points = np.where(points <= 64, np.uint32(32), points)
    padded = np.concatenate((np.array([32], np.uint32), points, np.array([32], np.uint32)))
    one = padded * MIX[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * MIX[1] + padded[1:] * MIX[2]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * MIX[0] + padded[2:] * MIX[1]
    found = np.concatenate((one[1:-1], two, three))
    return (found ^ (found >> np.uint32(16))) & np.uint32(BUCKETS - 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def count_places(rows: DataFrame) -> DataFrame:
    """lang, place, count over rows of (lang, text); every task adds up before it emits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    place, n = np.unique(places(text), return_counts=True)
                    total[place] += n
        for lang, total in sums.items():
            place = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(place), pa.string()), pa.array(place, pa.int32()), pa.array(total[place])],
                names=["lang", "place", "n"],
            )

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, place int, n long")
    return counted.groupBy("lang", "place").agg(F.sum("n").alias("n"))


def training_sample(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(lang, text) of at most `bound` rows a language, in hash order; texts move only when chosen."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(True)))
    # A hash cut keeps slightly more than the bound; only those rows are ranked.
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{len(counts)} languages; the matrix is built for at most {MOST_LANGUAGES}")
    if not counts:
        return known.select("lang", "text")
    order = F.xxhash64("doc_id", F.octet_length("text"), F.lit(11))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (bound + 6 * bound**0.5) / n))])
    part = (F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))) <= share[F.col("lang")]
    first = W.Window.partitionBy("lang").orderBy("h", "doc_id", F.octet_length("text"))
    near = known.filter(part).select("lang", "text", "doc_id", order.alias("h"))
    return near.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= bound).select("lang", "text")


def fit(docs: DataFrame, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix of log-probabilities (places x languages)."""
    found = count_places(training_sample(docs)).toPandas()  # at most languages x places rows
    langs = sorted(found["lang"].unique().tolist())
    counts = np.full((BUCKETS, len(langs)), smoothing)
    counts[found["place"], found["lang"].map({g: i for i, g in enumerate(langs)}).astype(int)] += found["n"]
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32) if langs else counts


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior under equal priors) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        for batch in batches:
            picked, scores = [], []
            for text in batch.column("text").to_pylist():
                if not names or not has_letter(text):
                    picked.append("und")
                    scores.append(0.0)
                    continue
                counts = np.bincount(places(text), minlength=0)
                place = np.flatnonzero(counts)
                total = counts[place].astype(np.float64) @ weights[place].astype(np.float64)
                best = int(np.argmax(total))
                picked.append(names[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(picked, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


@register("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return predict(docs, *fit(docs))
