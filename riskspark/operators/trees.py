"""Tree models on URL features, trained and applied with `pyspark.ml`."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark import lexicon
from riskspark.functions.staging import staging_root
from riskspark.operators import urls

# Fixed value: probability ceiling for well-known domains.
WELL_KNOWN_CAP = 0.05


def _fit(df, features, classifier, fill, others=()) -> PipelineModel:
    numbers = df.select("label", *others, *[F.col(c).cast("double").alias(c) for c in features])
    stages = [VectorAssembler(inputCols=list(features), outputCol="features"), classifier]
    if fill == "median":
        names = [f"{c}_filled" for c in features]
        stages[0] = VectorAssembler(inputCols=names, outputCol="features")
        stages.insert(0, Imputer(inputCols=list(features), outputCols=names, strategy="median"))
    elif fill is not None:
        numbers = numbers.fillna(fill, subset=list(features))
    return Pipeline(stages=stages).fit(numbers)


def fit_forest(df: DataFrame, features, trees=100, depth=20, seed=42, fill=None) -> PipelineModel:
    """Random forest on numeric columns. `fill`: a constant or 'median' for absent values.

    Fitting passes over its input once per level: hand in written features.
    """
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", **_resumable(df))
    return _fit(df, features, forest, fill)


def fit_gbt(df: DataFrame, features=None, rounds=300, rate=0.1, depth=15, seed=42, held_back=None) -> PipelineModel:
    """Gradient boosting. All `rounds` are made, unless `held_back` names a boolean column: its rows are
    left out of fitting, and rounds end when the error on them no longer falls."""
    features = features or lexicon.MODEL_FEATURES
    boosted = GBTClassifier(
        maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, labelCol="label", **_resumable(df)
    )
    if held_back:
        boosted.setValidationIndicatorCol(held_back)
    return _fit(df, features, boosted, None, [held_back] if held_back else [])


def _resumable(df: DataFrame) -> dict:
    """Each row's node is kept from level to level, and saved every ten trees against lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(staging_root(df.sparkSession))
    return {"cacheNodeIds": True, "checkpointInterval": 10}


def hold_back(df: DataFrame, key="id", share=0.1, out="held_back") -> DataFrame:
    """Mark about `share` of the rows by a hash of `key`."""
    return df.withColumn(out, F.pmod(F.xxhash64(F.lit("held back"), F.col(key)), F.lit(1000)) < int(1000 * share))


def feature_names(model: PipelineModel) -> list[str]:
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [n.removesuffix("_filled") for n in assembler.getInputCols()]


def predict_trees(df: DataFrame, model: PipelineModel, fill=None) -> DataFrame:
    """Add `probability` of class 1 and `prediction`; other model columns are dropped."""
    names = feature_names(model)
    numbers = df.withColumns({c: F.col(c).cast("double") for c in names})
    if fill is not None:
        numbers = numbers.fillna(fill, subset=names)
    scored = model.transform(numbers)
    p = vector_to_array("probability")[1]
    return scored.select(*df.columns, p.alias("probability"), F.col("prediction").cast("int"))


def apply_url_model(df: DataFrame, model: PipelineModel, suffixes=None) -> DataFrame:
    """Replace ml_score and ml_probability by the model's, capped on well-known domains.

    A row without a probability keeps its heuristic score.
    """
    rule_columns = [c for c in df.columns if c not in lexicon.MODEL_FEATURES]
    flagged = urls.flag_well_known(df.select(*rule_columns), "url", suffixes)
    featured = urls.url_model_features(flagged, "url", suffixes)
    scored = predict_trees(featured, model)
    p = F.when(F.col("well_known"), F.least("probability", F.lit(WELL_KNOWN_CAP))).otherwise(
        F.col("probability")
    )
    return scored.withColumn("_p", p).withColumns(
        {
            "ml_score": F.coalesce((F.col("_p") * 100).cast("int"), F.col("ml_score")),
            "ml_probability": F.coalesce("_p", "ml_probability"),
        }
    ).select(*rule_columns)


def importances(spark, model: PipelineModel) -> DataFrame:
    """Feature importances as rows, largest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(feature_names(model), values))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
