"""The pipeline's near-dedup stage against brute force, and all stages on odd tables."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def corpus():
    """Groups of a base and copies with some changed words, chains included, and exact copies."""
    rng, rows = random.Random(11), []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 300))]
        for _ in range(6):
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**9)}"
            rows.append(" ".join(words))
    return rows


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(4)
    prints = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(root)) and 25 < len(kept) < len(texts)


VOWELS = random.Random(5)
NAMES = ["".join(VOWELS.choice("bdfglmnprst") + VOWELS.choice("aeiou") for _ in range(3)) for _ in range(240)]
CLEAN = "\n".join("The " + " ".join(NAMES[i : i + 12]) + " was seen by harbours." for i in range(0, 240, 12))


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None, None)],
    [(1, CLEAN, "en", "a", len(CLEAN))] * 3 + [(None, CLEAN.replace("harbours", "ports"), None, None, None), (2, "", "", "", 0), (3, (CLEAN + chr(10)) * 40, None, "a", None)],
])
def test_odd_tables(spark, tmp_path, rows):
    extra = {"uid": F.lit(1), "fp": F.lit("x"), "size": F.lit(0.5), "row": F.lit(None).cast("string"), "key": F.lit(7)}
    spark.createDataFrame(rows, DOCS).withColumns(extra).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == any(r[1] and len(r[1].split()) >= 50 for r in rows)
