"""Training, time-ordered cross-validation, search and importances.

Boosted trees come from :mod:`panelcast.plans.boosting`: the feature table is
built once, stored with its folds, and all folds and the final model grow
together over its blocks.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.plans import validation as val
from panelcast.plans.boosting import Binning, BoostedModel, BoostParams, boost, predictor
from panelcast.plans.features import build_features
from panelcast.plans.search import random_search  # noqa: F401
from panelcast.session import stored
from panelcast.sources.io import scratch_table_path
from panelcast.spec import BOOSTING_PARAMS, FeatureConfig, SeriesSpec

log = logging.getLogger(__name__)


@dataclass
class TrainConfig:
    """Boosting settings, the reference's by default: up to ``max_iter`` trees;
    a fold keeps the trees up to its lowest error on the validation rows,
    looking ``patience`` trees beyond it."""

    n_splits: int = 5
    max_iter: int = BOOSTING_PARAMS["n_estimators"]
    step_size: float = BOOSTING_PARAMS["learning_rate"]
    num_leaves: int = BOOSTING_PARAMS["num_leaves"]
    lambda_l1: float = BOOSTING_PARAMS["lambda_l1"]
    lambda_l2: float = BOOSTING_PARAMS["lambda_l2"]
    row_share: float = BOOSTING_PARAMS["bagging_fraction"]
    row_share_every: int = BOOSTING_PARAMS["bagging_freq"]
    feature_share: float = BOOSTING_PARAMS["feature_fraction"]
    seed: int = BOOSTING_PARAMS["seed"]
    patience: int = BOOSTING_PARAMS["early_stopping_rounds"]
    retrain_on_full: bool = True
    categorical: list[str] = field(default_factory=lambda: list(FeatureConfig().categorical))

    def boosting(self) -> BoostParams:
        return BoostParams(rounds=self.max_iter, step=self.step_size, leaves=self.num_leaves, l1=self.lambda_l1, l2=self.lambda_l2,
                           row_share=self.row_share, row_share_every=self.row_share_every, feature_share=self.feature_share,
                           patience=self.patience, seed=self.seed)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back (lineage cut)."""
    path = scratch_table_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def feature_table(df: DataFrame, spec: SeriesSpec, cfg: FeatureConfig):
    """Features (E16) + feature list (B11) + null drop."""
    feats = build_features(df, spec, cfg)
    names = cfg.feature_names(spec, available=feats.columns)
    clean = feats.na.drop(subset=names + [spec.value_col])
    return clean, names


def _indexed(col: str) -> str:
    return f"{col}__idx"


def make_pipeline(features, categorical, estimator, scale: bool = False) -> Pipeline:
    """Categorical encoding (L1: ``StringIndexer`` fitted once, unseen values
    kept) + assembler (+ optional scaler, L11) + estimator."""
    cats = [c for c in categorical if c in features]
    stages = [StringIndexer(inputCol=c, outputCol=_indexed(c), handleInvalid="keep",
                            stringOrderType="alphabetAsc") for c in cats]
    inputs = [_indexed(c) if c in cats else c for c in features]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features_raw" if scale else "features",
                                  handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True))
    stages.append(estimator)
    return Pipeline(stages=stages)


@dataclass
class TrainResult:
    model: BoostedModel
    features: list[str]
    cv_metrics: DataFrame
    oof: DataFrame
    scores: dict
    fold_models: dict[int, BoostedModel]


def _blank_model(names: list[str], categorical: list[str]) -> BoostedModel:
    return BoostedModel(Binning(names, {f: [] for f in names if f not in categorical}, {f: [] for f in names if f in categorical}), 0.0, [])


def train_pipeline(spark: SparkSession, df: DataFrame, spec: SeriesSpec = SeriesSpec(),
                   cfg: FeatureConfig = FeatureConfig(), tcfg: TrainConfig = TrainConfig(),
                   model_dir: str | None = None) -> TrainResult:
    """Full training flow (L9): features -> list -> null drop -> date order ->
    time-series CV with early stopping (L3) -> out-of-fold predictions (L4) ->
    per-fold/average metrics (L8) -> model of all rows (L10) -> save.

    Categories (L1) are coded inside the model; unseen ones have a code of
    their own.  Folds without rows are skipped.  Without any complete row
    (series shorter than the longest look-back) there is nothing to learn: no
    folds, and a model without trees that predicts 0."""
    keys, d, t = list(spec.keys), spec.order_col, spec.value_col
    table, names = feature_table(df, spec, cfg)
    if not names:
        raise ValueError("no features available")
    # the folds read the table twice (rows by date, then rows): the features are worked out once
    table = stored(table.select(*dict.fromkeys([*keys, d, t, *names])), "features")
    folded = val.time_series_folds(table.withColumn(t, F.col(t).cast("double")), [d] + keys, tcfg.n_splits)
    folded = stored(folded.select(*dict.fromkeys([*keys, d, t, *names, "row_index", "val_fold"])), "folds")
    if folded.isEmpty():
        log.warning("no complete rows to learn from: the model predicts 0")
        models = {0: _blank_model(names, tcfg.categorical)}
    else:
        models = boost(folded, names, tcfg.categorical, t, "row_index", "val_fold", tcfg.boosting(), whole=tcfg.retrain_on_full)
    folds = {i: m for i, m in models.items() if i}
    predicted = predictor(spark, folds)(F.col("val_fold")) if folds else F.lit(None).cast("double")
    oof = stored(folded.where("val_fold is not null").select(
        *keys, d, "row_index", F.col("val_fold").alias("fold"), t, predicted.alias("prediction")), "oof")
    cv = stored(val.fold_metrics(oof, t, "prediction", "fold"), "cv")
    avg = cv.where("fold = 0").select("mae", "rmse", "smape").first().asDict()
    final = folds[max(folds)] if folds and not tcfg.retrain_on_full else models[0]
    if model_dir:
        from panelcast.sources.models import save_model

        save_model(spark, final, model_dir, avg, names)
    return TrainResult(final, names, cv, oof, avg, folds)


def model_input_columns(model: BoostedModel | PipelineModel) -> list[str]:
    """Names the model expects (K3), mapped back from indexed columns."""
    if isinstance(model, BoostedModel):
        return list(model.features)
    for st in model.stages:
        if isinstance(st, VectorAssembler) or type(st).__name__ == "VectorAssembler":
            return [c[:-5] if c.endswith("__idx") else c for c in st.getInputCols()]
    raise ValueError("model has no assembler stage")


def top_importances(spark: SparkSession, model: BoostedModel, n: int = 20) -> DataFrame:
    """Top-n feature importances of a boosted model (L16): shares of its splits."""
    names, imp = model.features, model.importances()
    df = spark.createDataFrame(list(zip(names, [float(v) for v in imp])), "feature STRING, importance DOUBLE")
    return df.orderBy(F.col("importance").desc(), "feature").limit(n)


def rf_importance(spark: SparkSession, df: DataFrame, target: str, features, num_trees: int = 100, seed: int = 42) -> DataFrame:
    """Random-forest importances (L15): mean-filled features and target, at
    least 10 rows, trees of unlimited depth, sorted descending; otherwise an
    empty frame."""
    from panelcast.operators.impute import mean_fill
    from panelcast.plans import forest

    cols = list(features) + [target]
    filled = mean_fill(df.select(*cols), cols)
    if filled.limit(10).count() < 10:
        return spark.createDataFrame([], "feature STRING, importance DOUBLE")
    return forest.importances(filled, list(features), target, num_trees, seed).orderBy(F.col("importance").desc(), "feature")


def ensemble_predict(results: dict, df: DataFrame, weights: dict | None = None) -> DataFrame:
    """Weighted ensemble of the best models (L14): chained ``transform``s on
    the same rows, one prediction column per model."""
    out = df
    cols = []
    for name, res in results.items():
        col = f"pred_{name}"
        out = res["best_model"].transform(out).withColumnRenamed("prediction", col)
        out = out.drop("features", "features_raw")
        cols.append(col)
    w = {f"pred_{k}": v for k, v in weights.items()} if weights else None
    return val.weighted_ensemble(out, cols, w)
