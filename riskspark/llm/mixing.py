"""Mixing sources to target weights with Sainte-Lague quotas of equal-token blocks.

1. A source's target is its weighted share of the budget, at most `most` times its own words; what
   is cut off is shared again by weight.
2. The budget is a number of blocks of `block` words. Sources get blocks by highest quotients
   target / (2k + 1); a source's blocks go to its shards by the same rule on the shards' words; what a shard cannot
   give is dealt again among the others.
3. Within a shard, a source's documents stand in seeded hash order. Its blocks are taken from the
   front of that line, which goes round at most `most` times; the words a document gives are the
   overlap of its place in the line with the blocks taken.

The seeded hash is cut into slices, and a source's shards are runs of slices. Their number grows with
the square root of the source's own words, so both the documents of a shard and the shards of a source
stay small next to the source, and a source of few words is not cut into shards smaller than a document.

Defined cases: a null text has size 0 and gives nothing; a null source is a source of its own, the
last; ids may be null or repeat (equal records are interchangeable); without any word every target
is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from riskspark.llm.common import WORD, register, table, write_shared

BLOCK = 64
SEED = 17
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2


def targets(sizes: list[int], weights: list[int], budget: float, most: int = MOST) -> list[float]:
    """Shares of `budget` by weight, none above `most` times its size; the excess is reshared."""
    goal, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in full or free:
            goal[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left = max(0.0, left - sum(goal[i] for i in full))
        free -= full
    return goal


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1), at most `most` each; ties to the earlier entry.

    A divisor finds nearly all seats at once; only the last ones are dealt one by one.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def dealt(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5).astype(np.int64), most)

    low, high = votes[votes > 0].min() / (2 * seats + 2), 2 * votes.max() + 1
    low = min(low, votes.sum() / (4 * seats + 4))
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if dealt(middle).sum() > seats else (low, middle)
    got = dealt(high)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("size"), *keep)


def source_table(rows: DataFrame, block: int) -> pd.DataFrame:
    """One line per source: words, target and blocks. A summary, as long as the list of sources."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["source_size"]) for r in found]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))], BUDGET * sum(sizes))
    seats = round(sum(goal) / block)
    most = np.array([math.ceil(MOST * s / block) for s in sizes], np.int64)
    quota = sainte_lague(np.array(goal), seats, most) if found else []
    return pd.DataFrame(
        {
            "source": pd.Series([r["source"] for r in found], dtype=object),
            "source_size": pd.Series(sizes, dtype="int64"),
            "target": pd.Series(goal, dtype="float64"),
            "blocks": pd.Series(quota, dtype="int64"),
        }
    )


def shard_count(words: int) -> int:
    """Both the words of a shard and the shards grow with the square root of the words."""
    return max(1, math.isqrt(words // 4096))


def dealt_words(words: np.ndarray, blocks: int, block: int) -> np.ndarray:
    """Words that each shard gives when its source deals `blocks` blocks by the shards' words.

    A shard gives at most `MOST` times its words. What a last block lacks there is dealt again as
    further blocks, until less than a block is missing or every shard gives all it can.
    """
    most, seats = -(-MOST * words // block), blocks
    while True:
        quota = sainte_lague(words, seats, most)
        whole = np.minimum(quota * block, MOST * words)
        short = int(blocks * block - whole.sum())
        if short < block or (quota == most).all():
            return whole
        seats = int(quota.sum()) + short // block


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, the `keep` columns, and a document's place.

    `start` and `line_words` place it in its line, `whole` is the words the line gives in all, and
    `round0`, `round1` are the words that the document gives in each round.
    """
    spark = docs.sparkSession
    # A pair of 64-bit hashes orders the line; the first also picks the shard.
    ordered = sized(docs, keep).withColumns(
        {"h": F.xxhash64(F.lit(seed), "doc_id", "source"), "g": F.xxhash64(F.lit(seed + 1), "doc_id", "size")}
    )
    rows = write_shared(ordered, "sized")
    sources = source_table(rows, block)
    slices = shard_count(int(sources["source_size"].sum()))
    shape = "source string, source_size long, target double, blocks long"
    per_source = spark.createDataFrame([tuple(r) for r in sources.itertuples(index=False)], shape)

    rows = rows.withColumn("slice", F.pmod("h", F.lit(slices)))
    cells = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    same = cells["source"].eqNullSafe(per_source["source"])
    cells = cells.join(per_source, same).drop(per_source["source"])

    def deal(cell: pd.DataFrame) -> pd.DataFrame:
        count = shard_count(int(cell["source_size"].iloc[0]))
        shard = (cell["slice"] * count // slices).astype("int64")
        line = cell["words"].groupby(shard).sum()
        whole = pd.Series(dealt_words(line.to_numpy(), int(cell["blocks"].iloc[0]), block), index=line.index)
        cell = cell.assign(shard=shard, line_words=shard.map(line), whole=shard.map(whole))
        return cell.drop(columns="words")

    # One group holds the slices of one source, never its documents.
    kinds = [(n, k) for n, k in cells.dtypes if n != "words"]
    kinds += [(n, "long") for n in ("shard", "line_words", "whole")]
    cells = cells.groupBy("source").applyInPandas(deal, ", ".join(f"{n} {k}" for n, k in kinds))
    keyed = rows.join(
        cells.withColumnsRenamed({"source": "cell_source", "slice": "cell_slice"}),
        F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("slice") == F.col("cell_slice")),
    )
    line = W.Window.partitionBy("source", "shard").orderBy("g", "doc_id", "size")
    before = line.rowsBetween(W.Window.unboundedPreceding, -1)
    placed = keyed.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))

    def overlap(words):
        return F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("start")))

    rounds = [overlap(F.col("whole") - k * F.col("line_words")) for k in range(MOST)]
    named = {f"round{k}": r.cast("long") for k, r in enumerate(rounds)}
    return placed.withColumns(named).withColumn("taken", sum((F.col(c) for c in named), F.lit(0)).cast("long"))


def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """The beginning of a text up to its n-th word; null for a null text."""

    def cut(t, k):
        ends = [m.end() for _, m in zip(range(int(k)), re.finditer(WORD, t))]
        return t[: ends[-1]] if ends else ""

    return pd.Series([None if t is None else cut(t, k) for t, k in zip(text, n)], dtype=object)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each round that takes words of a document, cut to those words."""
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = write_shared(docs.select(packed, F.monotonically_increasing_id().alias("uid")), "marked")
    plain = marked.select("uid", *[F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "text")])
    rounds = F.array(*[F.col(f"round{k}") for k in range(MOST)])
    given = mix(plain, keep=("uid",)).select("uid", "size", F.explode(rounds).alias("words")).filter("words > 0")
    joined = marked.join(given, "uid")
    whole = F.col("words") == F.col("size")
    part = F.pandas_udf(first_words, T.StringType())(F.when(~whole, F.col("row.text")), "words")
    joined = joined.withColumn("given", F.when(whole, F.col("row.text")).otherwise(part))
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out["text"] = F.col("given")
    if "n_chars" in out:
        out["n_chars"] = F.length("given").cast("long")
    return joined.select(*[column.alias(c) for c, column in out.items()])


@register("op9_mixing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
