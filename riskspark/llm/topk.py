"""Exact top-k search with multi-resolution segment statistics.

Vectors become whole numbers floor(256 x). For a cut into segments of equal length m, a vector keeps
the mean and the deviation of each segment. By Cauchy-Schwarz within segments,

    <q, x>  <=  sum over segments of  m mean(q) mean(x) + m dev(q) dev(x),

that is, a lower bound of the distance |q|^2 + |x|^2 - 2 <q, x>. It tightens from one segment to many.
Candidates go through the bounds coarse to fine against the query's k-th best score so far, and only
survivors are scored exactly.

Queries and candidates meet in blocks: each task holds one block of queries and one of candidates and
answers with the best k of each query, so memory is bounded by the two block sizes.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; a shorter
vector counts as padded with zeros; an empty one scores 0; rows with a null id are candidates for
no one; rows of the query's id are its own, and of several such rows the smallest vector asks; equal scores go
to the smaller id; scores must fit a long; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from riskspark.llm.common import register, table, write_shared

K = 5
LEVELS = (1, 4, 16)
QUERY_BLOCK = 2048
ROW_BLOCK = 8192
STEP = 512  # candidates between two updates of the k-th best scores
RESULT = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean and the deviation, scaled so that a dot product is the bound."""
    width = -(-rows.shape[1] // segments)
    padded = np.pad(rows, ((0, 0), (0, width * segments - rows.shape[1])))
    parts = padded.reshape(len(rows), segments, width)
    mean = parts.mean(axis=2)
    spread = np.sqrt(np.maximum(0.0, (parts**2).mean(axis=2) - mean**2))
    return np.concatenate((mean, spread), axis=1) * np.sqrt(width)


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best_of_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of this block for every query of this block, exactly."""
    width = max(1, max((len(v) for part in (queries["v"], rows["v"]) for v in part), default=1))
    q, x = matrix(queries["v"], width), matrix(rows["v"], width)
    query_ids, ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
    # Heavy vectors first: they raise the k-th best score early.
    order = np.lexsort((ids, -(x.astype(float) ** 2).sum(axis=1)))
    x, ids = x[order], ids[order]
    largest = float(max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)))
    exact = np.float64 if largest * largest * width < 2.0**52 else np.int64
    qe, xe = q.astype(exact), x.astype(exact)
    q_stats = [statistics(q.astype(float), s) for s in LEVELS]
    x_stats = [statistics(x.astype(float), s) for s in LEVELS]
    top = np.full((len(q), k), -np.inf)  # best scores so far, unordered
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), STEP):
        part = slice(at, at + STEP)
        need = top.min(axis=1) if k else np.full(len(q), np.inf)
        open_ = query_ids[:, None] != ids[None, part]
        for q_level, x_level in zip(q_stats, x_stats):
            alive = open_.any(axis=1)
            if not alive.any():
                break
            bound = q_level[alive] @ x_level[part].T
            slack = 1.0 + 1e-9 * np.abs(bound)  # covers rounding of the statistics
            open_[alive] &= bound + slack >= need[alive, None]
        i, j = np.nonzero(open_)
        if not len(i):
            continue
        score = np.einsum("ij,ij->i", qe[i], xe[at + j])
        found.append((i, at + j, score.astype(np.int64)))
        dense = np.full((len(q), min(STEP, len(x) - at)), -np.inf)
        dense[i, j] = score
        top = -np.partition(-np.concatenate((top, dense), axis=1), k - 1, axis=1)[:, :k]
    if not found:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    i, j, score = (np.concatenate([f[c] for f in found]) for c in range(3))
    frame = pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[j], "score": score})
    frame = frame[score >= top.min(axis=1)[i]]
    return frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def top_k(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query (both: vec_id, v)."""
    n_queries, n_rows = queries.count(), rows.count()
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    row_blocks = max(1, -(-n_rows // ROW_BLOCK))
    own, part = F.xxhash64("vec_id", F.lit(3)), F.xxhash64("vec_id", F.lit(4))

    def every(n: int) -> F.Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("long")))

    asked = queries.select("vec_id", "v", F.pmod(own, F.lit(query_blocks)).alias("qb"), every(row_blocks).alias("rb"))
    given = rows.select("vec_id", "v", every(query_blocks).alias("qb"), F.pmod(part, F.lit(row_blocks)).alias("rb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return best_of_block(left, right, k)

    near = asked.groupBy("qb", "rb").cogroup(given.groupBy("qb", "rb")).applyInPandas(meet, RESULT)
    best = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@register("op4_exact_top_k", ORACLE)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rows = write_shared(usable(table(spark, folder, "embeddings")), "vectors")
    queries = rows.filter("vec_id % 50 = 0").groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(queries, rows)
