"""Catalog: model training, search, importances, persistence and forecasts
(L1, L3, L4, L8-L13, L15, L16, A8-A10, K3-K5).  Rows-only checks: model
fits have no SQL equivalent; ``tests/test_boosting.py`` compares them with
plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import windows as win
from panelcast.plans import forecast as fc
from panelcast.plans import training as tr
from panelcast.plans.catalog import KEYS, float_cols, register, round_cols
from panelcast.plans.sqlgen import r6
from panelcast.session import stored
from panelcast.sources import models as reg
from panelcast.sources.io import scratch_table_path
from panelcast.sources.tables import DAILY_SALES_SQL, daily_sales, with_sql
from panelcast.spec import FeatureConfig, SeriesSpec

_TRAINED: dict = {}


def _session_key(spark):
    """Unique per running context (an object id can be reused after a stop)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001  (sessions without a local context)
        return id(spark)


def _r(df):
    return round_cols(df, float_cols(df))


#: Trees that the queries grow at most (the library's default is 1000): folds reach their patience before, the
#: model of all rows stops here.  README gives seconds and errors by tree.
QUERY_TREES = 100


def trained(spark, sf):
    """Train once per scale factor and session; later queries reuse the result."""
    key = (_session_key(spark), sf)
    if key not in _TRAINED:
        model_dir = scratch_table_path(spark, "models")
        res = tr.train_pipeline(spark, daily_sales(spark, sf), SeriesSpec(), FeatureConfig(),
                                tr.TrainConfig(max_iter=QUERY_TREES), model_dir=model_dir)
        _TRAINED[key] = (res, model_dir)
    return _TRAINED[key]


@register("train_cv_metrics")
def train_cv_metrics(spark, sf):
    """Boosted trees (absolute loss, early stopping) on the
    default features, 5 time-ordered folds, per-fold and average metrics."""
    res, _ = trained(spark, sf)
    return _r(res.cv_metrics)


@register("oof_predictions")
def oof_predictions(spark, sf):
    """L4: out-of-fold predictions of the CV loop."""
    res, _ = trained(spark, sf)
    return _r(res.oof)


_OOF_ROWS_SQL = with_sql(DAILY_SALES_SQL) + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY store, item ORDER BY date) AS rn FROM daily_sales),
kept AS (SELECT store, item, date, sales, row_number() OVER (ORDER BY date, store, item) - 1 AS row_index, count(*) OVER () AS n
         FROM placed WHERE rn > 728),
folds AS (SELECT *, n // 6 AS size FROM kept)
SELECT store, item, date, row_index, CAST((row_index - (n - 5 * size)) // size + 1 AS INTEGER) AS fold, CAST(sales AS DOUBLE) AS sales
FROM folds WHERE row_index >= n - 5 * size"""


@register("oof_rows", _OOF_ROWS_SQL)
def oof_rows(spark, sf):
    """L2/L4: which rows the out-of-fold predictions cover, with their folds
    (the longest look-back is a lag of 728 rows)."""
    res, _ = trained(spark, sf)
    return res.oof.where("prediction is not null").select("store", "item", "date", "row_index", "fold", "sales")


@register("model_registry")
def model_registry(spark, sf):
    """The trained model saved with a timestamped name, registry
    listed newest first."""
    _, model_dir = trained(spark, sf)
    return _r(reg.list_models(spark, model_dir).drop("created_at"))


@register("forecast_90d")
def forecast_90d(spark, sf):
    """Load the saved model and forecast the next 90 days of every
    series (round half-even, clip 0, integer)."""
    res, model_dir = trained(spark, sf)
    model = reg.load_model(reg.latest_model_path(spark, model_dir))
    return fc.forecast(model, daily_sales(spark, sf), SeriesSpec(), FeatureConfig(), 90,
                       input_cols=tr.model_input_columns(model))


_FORECAST_SPAN_SQL = with_sql(DAILY_SALES_SQL) + """
SELECT store, item, 90 AS days, CAST(max(date) + INTERVAL 1 DAY AS DATE) AS first_day, CAST(max(date) + INTERVAL 90 DAY AS DATE) AS last_day,
       90 AS not_negative
FROM daily_sales GROUP BY store, item"""


@register("forecast_span", _FORECAST_SPAN_SQL)
def forecast_span(spark, sf):
    """K1/K4: days, span and non-negative whole values of every series' forecast."""
    return forecast_90d(spark, sf).groupBy("store", "item").agg(
        F.count_distinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.count_if(F.col("forecast") >= 0).alias("not_negative"))


@register("history_and_forecast")
def history_and_forecast(spark, sf):
    """K5: last 365 history rows and the forecast of every series with a kind column."""
    res, _ = trained(spark, sf)
    f = fc.forecast(res.model, daily_sales(spark, sf), SeriesSpec(), FeatureConfig(), 90,
                    input_cols=tr.model_input_columns(res.model))
    return fc.history_and_forecast(daily_sales(spark, sf), f, SeriesSpec())


@register("top_importances")
def top_importances(spark, sf):
    """Top-20 importances of the trained model."""
    res, _ = trained(spark, sf)
    return _r(tr.top_importances(spark, res.model, 20))


IMP_FEATURES = ["sales_lag_7", "sales_lag_28", "sales_roll_mean_7d", "sales_roll_std_7d", "dayofweek", "month",
                "dayofyear", "is_holiday"]


def _imp_frame(spark, sf):
    from panelcast.functions import calendar as cal

    f = cal.date_features(daily_sales(spark, sf), "date")
    f = win.lag_features(f, KEYS, "date", "sales", [7, 28])
    f = win.shifted_rolling(f, KEYS, "date", "sales", [7], ["mean", "std"])
    return f.withColumn("sales", F.col("sales").cast("double"))


@register("rf_importance")
def rf_importance(spark, sf):
    """Random-forest importances (100 trees, seed 42) on mean-filled features."""
    return _r(tr.rf_importance(spark, _imp_frame(spark, sf), "sales", IMP_FEATURES))


_SEARCHED: dict = {}


def searched(spark, sf):
    """One seeded search per scale factor and session (two model families)."""
    key = (_session_key(spark), sf)
    if key not in _SEARCHED:
        f = tr.materialize(spark, _imp_frame(spark, sf).na.drop(subset=IMP_FEATURES), "search_input")
        grids = {"linear": {"reg": [0.0, 0.01, 0.1, 0.3, 1.0, 3.0], "l1_share": [0.0, 0.25, 0.5, 0.75, 1.0]},
                 "tree": {"leaves": [4, 8, 16, 31, 64], "min_rows": [1, 5, 20, 50, 100]}}
        results, cv = tr.random_search(spark, f, IMP_FEATURES, "sales", {"linear": "elastic_net", "tree": "tree"}, grids, ["date", "store", "item"])
        _SEARCHED[key] = (results, cv, f)
    return _SEARCHED[key]


@register("random_search_cv")
def random_search_cv(spark, sf):
    """Scaler + estimator pipelines, seeded random search over
    parameter grids with time-series CV scored by MAE; CV table (rank 1 = best)."""
    _, cv, _ = searched(spark, sf)
    return _r(cv)


_LINEAR_SQL = with_sql(DAILY_SALES_SQL) + f""",
lagged AS (SELECT store, item, date, CAST(sales AS DOUBLE) AS y, CAST(lag(sales, 7) OVER (PARTITION BY store, item ORDER BY date) AS DOUBLE) AS x
           FROM daily_sales),
kept AS (SELECT *, row_number() OVER (ORDER BY date, store, item) - 1 AS i, count(*) OVER () AS n FROM lagged WHERE x IS NOT NULL),
fold AS (SELECT unnest(range(1, 6)) AS fold),
fits AS (SELECT fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM fold, kept WHERE i < n - (6 - fold) * (n // 6) GROUP BY fold)
SELECT CAST(f.fold AS INTEGER) AS fold, {r6('f.slope')} AS slope, {r6('f.intercept')} AS intercept,
  {r6('avg(abs(k.y - (f.intercept + f.slope * k.x)))')} AS mae
FROM fits f JOIN kept k ON (k.i - (k.n - 5 * (k.n // 6))) >= (f.fold - 1) * (k.n // 6) AND (k.i - (k.n - 5 * (k.n // 6))) < f.fold * (k.n // 6)
GROUP BY f.fold, f.slope, f.intercept"""


@register("linear_fold_fits", _LINEAR_SQL)
def linear_fold_fits(spark, sf):
    """The search's linear part without penalty, one feature: fits of
    all folds from the blocks' Gram matrices, errors on the rows they validate."""
    from panelcast.plans import search
    from panelcast.plans import validation as val

    f = win.lag_features(daily_sales(spark, sf), KEYS, "date", "sales", [7]).na.drop(subset=["sales_lag_7"])
    rows = stored(val.time_series_folds(f, ["date", *KEYS], 5).select("sales", "sales_lag_7", "val_fold"), "linear-folds")
    centre, grams = search.block_grams(rows, ["sales_lag_7"], "sales", "val_fold")
    folds = [b for b in sorted(grams) if b]
    train = search.training_grams(grams, folds)
    fits = {b: [search.elastic_net(train[b], centre, 0.0, 0.0)] for b in folds}
    errors = search.linear_errors(rows, ["sales_lag_7"], "sales", "val_fold", fits)
    out = [(b, float(fits[b][0][0][0]), fits[b][0][1], errors[b][0]) for b in folds]
    return _r(spark.createDataFrame(out, "fold INT, slope DOUBLE, intercept DOUBLE, mae DOUBLE"))


@register("search_best_metrics")
def search_best_metrics(spark, sf):
    """Best parameters and in-sample MAE, RMSE, MAPE of each model family."""
    import json

    results, _, _ = searched(spark, sf)
    rows = [(name, json.dumps(r["best_params"], sort_keys=True), r["MAE"], r["RMSE"], r["MAPE"])
            for name, r in results.items()]
    return _r(spark.createDataFrame(rows, "model STRING, best_params STRING, mae DOUBLE, rmse DOUBLE, mape DOUBLE"))


@register("model_ensemble")
def model_ensemble(spark, sf):
    """Equal-weight ensemble of the best models, predictions aligned
    by chained transforms on the same rows, with its error metrics."""
    from panelcast.plans import validation as val

    results, _, f = searched(spark, sf)
    ens = tr.ensemble_predict(results, f)
    cols = ["ensemble"] + [f"pred_{n}" for n in results]
    rows = [val.metrics(ens, "sales", c).select(F.lit(c).alias("prediction"), "mae", "rmse", "smape", "mape", "n")
            for c in cols]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return _r(out)
