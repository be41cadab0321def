"""Evaluation of binary predictions: one conditional-aggregate pass, and exact AUC."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions import scoring


def _counts(label: str, pred: str) -> list[Column]:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return [
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def _class_scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)


def binary_metrics(df: DataFrame, label="label", pred="pred", by=(), counts=False) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; zero where undefined. Null labels take no part.

    `counts` adds the confusion matrix as tp, fp, fn, tn.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, f1 = _class_scores(tp, fp, fn)
    return df.groupBy(*by).agg(*_counts(label, pred)).select(
        *by,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        *([tp, fp, fn, tn] if counts else []),
    )


def confusion(df: DataFrame, label="label", pred="pred") -> DataFrame:
    """2x2 matrix: one row per true label with the counts of both predictions."""
    rows = F.array(
        F.struct(F.lit(0).alias("label"), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")),
        F.struct(F.lit(1).alias("label"), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")),
    )
    return df.agg(*_counts(label, pred)).select(F.inline(rows))


def class_report(df: DataFrame, label="label", pred="pred") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one, zero = _class_scores(tp, fp, fn), _class_scores(tn, fn, fp)
    n1, n0 = tp + fn, tn + fp
    n = n0 + n1
    correct = _ratio(tp + tn, n)

    def row(name, values, support):
        p, r, f = values
        return F.struct(
            F.lit(name).alias("class"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            support.alias("support"),
        )

    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    weighted = [_ratio(a * n0 + b * n1, n) for a, b in zip(zero, one)]
    rows = [
        row("0", zero, n0),
        row("1", one, n1),
        row("accuracy", [correct] * 3, n),
        row("macro avg", macro, n),
        row("weighted avg", weighted, n),
    ]
    return df.agg(*_counts(label, pred)).select(F.inline(F.array(*rows)))


def in_ranges(tied: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    """Add `bucket`, ascending in `s` within each `by` group: the range partition of the row.

    The boundaries come from a sample of the rows' own (by, s), so partitions are about even wherever
    the scores lie. Without `buckets` the session's number of partitions counts.
    """
    keys = [*by, "s"]
    dealt = tied.repartitionByRange(buckets, *keys) if buckets else tied.repartitionByRange(*keys)
    return dealt.withColumn("bucket", F.spark_partition_id())


def roc_auc(df: DataFrame, label="label", score="p", by=(), buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve with ties; NaN when only one class is present.

    Rows whose label is null, or whose score is null or NaN, have no place in the order and take no
    part. Equal scores collapse first. Distinct scores are ranked within range partitions, and only
    the partitions' totals are summed in order.
    """
    by = list(by)
    value = F.col(score).cast("double")
    data = df.select(*by, F.col(label).alias("y"), value.alias("s"))
    data = data.filter(F.col("y").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    tied = data.groupBy(*by, "s").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    tied = in_ranges(tied, by, buckets)
    inside = Window.partitionBy(*by, "bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    per_bucket = (
        tied.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
        .groupBy(*by, "bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    )
    group = by or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return (
        per_bucket.withColumn("won", F.col("won") + F.col("pos") * before)
        .groupBy(*by)
        .agg(F.coalesce(F.try_divide(F.sum("won"), pairs), F.lit(float("nan"))).alias("roc_auc"))
    )


def compare_models(df: DataFrame, models: dict[str, str], label="label", threshold=0.5, by=(), counts=False):
    """Metrics of several probability columns of one table, one row per model and `by` group."""
    by = list(by)
    stacked = df.select(
        *by,
        F.col(label).alias("label"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("model"), F.col(col).cast("double").alias("p"))
                    for name, col in models.items()
                ]
            )
        ).alias("m"),
    ).select(*by, "label", "m.model", "m.p")
    judged = stacked.withColumn("pred", scoring.binary_label(F.col("p"), threshold))
    keys = [*by, "model"]
    areas = roc_auc(stacked, by=keys)
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    joined = binary_metrics(judged, by=keys, counts=counts).alias("m").join(areas.alias("a"), same, "left")
    return joined.select("m.*", F.coalesce("a.roc_auc", F.lit(float("nan"))).alias("roc_auc"))


def evaluate_splits(df: DataFrame, models: dict[str, str], split="split", label="label", threshold=0.5):
    """The evaluation report: per split and model the five metrics and the confusion matrix."""
    return compare_models(df, models, label, threshold, by=[split], counts=True)
