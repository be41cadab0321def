"""Training jobs: corpus in, fitted model and held-out metrics out."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from riskspark import lexicon
from riskspark.functions.staging import stage
from riskspark.operators import corpus, metrics, sampling, textmodel, trees, urls


def train_text_model(corpus: DataFrame, key="id", seed=42, threshold=0.5, **options):
    """Naive Bayes fitted on the train rows; one row of metrics on the validation rows.

    A prepared `split` column is used, else 70/15/15. `options` go to `fit_nb`.
    """
    df = corpus if "split" in corpus.columns else sampling.assign_split(corpus, key=key, seed=seed)
    model = textmodel.fit_nb(sampling.take_split(df, "train"), **options)
    held = textmodel.predict_nb(model, sampling.take_split(df, "val"))
    return model, _report(held, "naive_bayes", "p_nb", threshold)


def _report(df: DataFrame, name: str, p: str, threshold: float) -> DataFrame:
    return metrics.compare_models(df, {name: p}, threshold=threshold)


def train_url_forest(rows: DataFrame, key="id", seed=42, suffixes=None, **options):
    """Random forest on the 14 lexical features, 80/20; (model, metrics of the test rows)."""
    featured = urls.url_lexical14(rows, "url", suffixes)
    names = lexicon.LEXICAL_FEATURES
    return _train(featured, names, 0.80, key, seed, lambda df: trees.fit_forest(df, names, seed=seed, **options))


def train_url_boosting(rows: DataFrame, key="id", seed=42, suffixes=None, early_stop=False, **options):
    """Gradient boosting on the 20 model features, 85/15; (model, metrics of the test rows).

    With `early_stop`, a tenth of the train rows decides after which round to end.
    """
    featured = urls.url_model_features(rows, "url", suffixes)
    names = lexicon.MODEL_FEATURES

    def fit(df: DataFrame) -> PipelineModel:
        held = {"held_back": "held_back"} if early_stop else {}
        return trees.fit_gbt(trees.hold_back(df, key) if early_stop else df, names, seed=seed, **held, **options)

    return _train(featured, names, 0.85, key, seed, fit)


def train_combined_forest(sources: list[DataFrame], key="id", seed=42, absent=-1, trees_=200, depth=25):
    """Random forest over tables of different numeric columns with a label, 80/20 by class.

    Columns that a source lacks are `absent`. (model, metrics of the test rows, report per class).
    """
    both = corpus.union_all(sources, allow_missing=True)
    names = [c for c in both.columns if c not in (key, "label")]
    table = stage(both.select(key, "label", *names), "features")
    df = sampling.assign_split(table, (0.80,), ("train", "test"), key, seed, stratify="label")
    model = trees.fit_forest(sampling.take_split(df, "train"), names, trees_, depth, seed, fill=absent)
    scored = stage(trees.predict_trees(sampling.take_split(df, "test"), model, fill=absent), "scored")
    return model, _report(scored, "trees", "probability", 0.5), metrics.class_report(scored, "label", "prediction")


def _train(featured, names, fraction, key, seed, fit) -> tuple[PipelineModel, DataFrame]:
    # Tree fitting passes over its input many times: features are computed and written once.
    table = stage(featured.select(key, "label", *names), "features")
    df = sampling.assign_split(table, (fraction,), ("train", "test"), key, seed)
    model = fit(sampling.take_split(df, "train"))
    scored = trees.predict_trees(sampling.take_split(df, "test"), model)
    return model, _report(scored, "trees", "probability", 0.5)
