"""Exact, reproducible caps and splits without sorting or shuffling the table.

Rows are ordered by md5(seed:key), ties by key; `key` must identify a row. The rank
limits of a group become limit values of that hash in two light passes:

1. count rows per (group, hash prefix); a running sum over at most 65,536 prefixes per
   group tells which prefix holds each wanted rank;
2. rank only the rows under those few prefixes (about one row in 65,536 per limit) and
   read off the limit value.

The final table is then a comparison of each row's hash with the limits of its group. The input is
computed once: it is written with its hashes, and both passes read the hashes alone. Limits stay
tables: they are broadcast if they have few rows, and joined otherwise, with the same result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.staging import stage

PREFIX = 4  # hex digits of the hash prefix
BROADCAST_ROWS = 10_000  # limit rows that are broadcast


def hash_order(key: Column, seed) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _few(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has at most `bound` rows."""
    return F.broadcast(df) if df.count() <= bound else df


def _limits(keyed: DataFrame, ranks) -> DataFrame:
    """(_g, _limit0, _limit1, ...): per group the (hash, key) of each rank over the size n.

    `keyed` has _group, _h and _key. A rank of zero has no limit.
    """
    keyed = keyed.withColumn("_prefix", F.substr("_h", F.lit(1), F.lit(PREFIX)))
    counts = keyed.groupBy("_group", "_prefix").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("_group")
    ordered = whole.orderBy("_prefix")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank")) for i, r in enumerate(ranks)])
    before = F.col("upto") - F.col("c")
    targets = (
        counts.withColumns({"n": F.sum("c").over(whole), "upto": F.sum("c").over(so_far)})
        .withColumn("w", F.explode(wanted))
        .filter((F.col("w.rank") > before) & (F.col("w.rank") <= F.col("upto")))
        .select(F.col("_group").alias("g"), F.col("_prefix").alias("p"), "w.i", (F.col("w.rank") - before).alias("place"))
    )
    targets = stage(targets, "ranks")
    same = F.col("_group").eqNullSafe(F.col("g")) & (F.col("_prefix") == F.col("p"))
    near = keyed.join(_few(targets), same, "left_semi")
    by_prefix = Window.partitionBy("_group", "_prefix").orderBy("_h", "_key")
    ranked = near.withColumn("_place", F.row_number().over(by_prefix))
    found = ranked.join(_few(targets), same & (F.col("_place") == F.col("place")))
    at = F.struct("_h", "_key")
    limits = [F.max(F.when(F.col("i") == i, at)).alias(f"_limit{i}") for i in range(len(ranks))]
    return stage(found.groupBy(F.col("_group").alias("_g")).agg(*limits), "limits")


def _with_limits(df, group: Column | None, key, seed, ranks):
    """Rows with their own place `_at` and the limits of their group; names to drop later.

    The input is computed once and written with its places; the passes for the limits read those only.
    """
    of = F.lit(0) if group is None else group
    at = F.struct(hash_order(F.col(key), seed).alias("_h"), F.col(key).alias("_key"))
    marked = stage(df.withColumns({"_group": of, "_at": at}), "placed")
    limits = _limits(marked.select("_group", "_at._h", "_at._key"), ranks)
    if group is None:  # one row of limits
        only = limits.head()
        constants = {}
        for name, kind in limits.dtypes[1:]:
            at = only and only[name]
            value = F.struct(F.lit(at["_h"]), F.lit(at["_key"])) if at else F.lit(None)
            constants[name] = value.cast(kind)
        joined = marked.withColumns(constants)
    else:
        joined = marked.join(_few(limits), F.col("_group").eqNullSafe(F.col("_g")), "left")
    return joined, [c for c in joined.columns if c not in df.columns]


def cap_per_class(df: DataFrame, k: int, label="label", key="id", seed=42) -> DataFrame:
    """At most `k` rows per class: the first k in hash order."""
    ranks = [F.least(F.lit(k), F.col("n"))]
    joined, extra = _with_limits(df, F.col(label), key, seed, ranks)
    return joined.filter(F.col("_at") <= F.col("_limit0")).drop(*extra)


def assign_split(
    df: DataFrame,
    fractions=(0.70, 0.15),
    names=("train", "val", "test"),
    key="id",
    seed=42,
    stratify=None,
) -> DataFrame:
    """Add `split`: the first floor(f*n) rows in hash order per fraction, then the rest."""
    group = F.col(stratify) if stratify else None
    ranks, total = [], F.lit(0).cast("long")
    for f in fractions:
        # Binary fractions such as 0.7 sit just below their decimal; the floor is exact.
        total = total + F.floor(F.col("n") * F.lit(f)).cast("long")
        ranks.append(total)
    joined, extra = _with_limits(df, group, key, seed, ranks)
    name = F.lit(names[len(fractions)])
    for i in range(len(fractions) - 1, -1, -1):
        within = F.coalesce(F.col("_at") <= F.col(f"_limit{i}"), F.lit(False))
        name = F.when(within, names[i]).otherwise(name)
    return joined.withColumn("split", name).drop(*extra)


def hash_ordered(df: DataFrame, key="id", seed=42) -> DataFrame:
    """Whole table in hash order: a range-partitioned sort, the seeded shuffle."""
    return df.orderBy(hash_order(F.col(key), seed), key)


def take_split(df: DataFrame, name: str) -> DataFrame:
    """Rows of a prepared split; the whole table when none was prepared."""
    return df.filter(F.col("split") == name) if "split" in df.columns else df
